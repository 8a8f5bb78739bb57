"""Extraction, stored models, folds with a refit, and the commands that use them."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import __main__ as cli
from millrace.functions import text as T
from millrace.operators import extraction, fusion, learning, mining, screening, vectors

OLD = "class A {\n  void one(int x) {\n    a.add(x);\n  }\n  public int two() {\n    return 1;\n  }\n}"
NEW = OLD.replace("a.add(x);", "a.put(x);")
CANDIDATES = "repo string, commit_hash string, parent_hash string, changed_java_files array<string>, all_categories array<string>, all_parents array<string>, is_multi_fault boolean, confidence string, pr_number string, pr_url string, pr_title string"


@pytest.fixture(scope="module")
def commits(spark):
    found = [("r", "c1", "p1", ["F.java", "G.java", "H.java"], ["memory.leak"], ["memory"], False, "low", "7", "u", "t"), ("r", "c2", "", [], [], [], False, "low", None, None, None)]
    contents = [("r", "p1", "F.java", OLD), ("r", "c1", "F.java", NEW), ("r", "c1", "G.java", NEW), ("r", "p1", "H.java", OLD), ("r", "c1", "H.java", NEW)]
    diffs = [("r", "c1", "F.java", "--- a/F.java\n+++ b/F.java\n@@ -3 +3 @@\n-x\n+y"), ("r", "c1", "G.java", "@@ -3 +3 @@"), ("r", "c1", "H.java", "no hunks")]
    return spark.createDataFrame(found, CANDIDATES), spark.createDataFrame(contents, "repo string, revision string, file_path string, content string"), spark.createDataFrame(diffs, "repo string, commit_hash string, file_path string, diff string")


def test_pairs_of_a_commit(commits):
    rows = extraction.method_pairs(*commits).collect()
    assert [(r.file_path, r.method_name, r.before_line_start, r.before_line_end) for r in rows] == [("F.java", "one", 2, 4)]  # G has no old side, H no hunks
    r = rows[0]
    assert r.before_source.strip().startswith("void one") and "put" in r.after_source and r.pr_details.startswith("PR #7")
    assert extraction.report(extraction.method_pairs(*commits), 5).first() == (1, 0, 1)


def test_hunks_of_no_lines_and_without_counts(spark):
    d = spark.createDataFrame([("@@ -2,0 +3,2 @@\n@@ -5 +6,0 @@ x",)], "diff string")
    assert d.select(T.hunks(F.col("diff")).alias("h")).first().h == [(2, 0, 3, 2), (5, 1, 6, 0)]
    m = spark.createDataFrame([("c", "f", "s", 2, 2, "a")], "commit_hash string, file_path string, signature string, start_line int, end_line int, source string")
    n = m.withColumn("source", F.lit("b"))
    for old, count, hit in ((2, 0, 0), (2, 1, 1), (1, 2, 1), (3, 1, 0)):
        h = spark.createDataFrame([("c", "f", old, count, 90, 1)], "commit_hash string, file_path string, old_start int, old_count int, new_start int, new_count int")
        assert fusion.matched_methods(m, n, h, ("commit_hash", "file_path")).count() == hit


def test_modified_files_only(spark):
    diff = "--- a/A.java\n+++ b/A.java\n@@ -1 +1 @@\n--- /dev/null\n+++ b/B.java\n--- a/C.txt\n+++ b/C.txt"
    d = spark.createDataFrame([("p", diff), (None, diff), ("p", None)], "parent_hash string, diff string")
    assert [r.changed_java_files for r in extraction.changed_files(d).collect()] == [["A.java"], [], []]


def test_declaration_far_into_a_line(spark):
    far = "+ /* " + "x" * 5000 + " */ public int late(int y) {"
    long = "+ " + "word " * 20_000 + "\n+ int near(int y) {" + " " * 20_000 + "\n+a(b) foo (c) x bar(d"
    d = spark.createDataFrame([(far,), (long,), ("+int m(int x) {\n+  call(x)\n+public int n(",), ("@@ -1 +1 @@ int a(b) c d (",)], "diff string")
    got = [r[0] for r in d.select(T.changed_methods(F.col("diff"))).collect()]
    assert got == [["late"], ["bar", "near"], ["n"], ["d"]]  # what stands before a name needs a modifier or a blank before it
    assert spark.createDataFrame([("  foo(x);\nint bar (y) z.baz(q) List<A> m(",)], "code string").select(T.declared(F.col("code"))).first()[0] == ["foo", "bar", "m"]


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) + (i % 4)], i % 4, i % 3, i % 10 != 0) for i in range(240)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int, in_train boolean").persist()


def test_blocks_of_any_size_give_the_same_neighbours(vecs):
    rows = vecs.collect()
    m, ids, project = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows]), np.array([r.project for r in rows])
    for size in (1, 1000, 1 << 25):
        for apart in (False, True):
            got = {}
            for r in vectors.top_k(vecs, vecs, 3, apart=apart, block_bytes=64 * size if size < 1 << 20 else size).collect() if size > 1 or not apart else []:
                got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour))
            for i, v in got.items():
                s = m @ m[i]
                s[project == project[i]] = -np.inf if apart else s[project == project[i]]
                assert [n for _, n in sorted(v)] == list(ids[np.lexsort((ids, -s))[:3]])
            assert not got or len(got) == 240


def test_folds_equal_separate_plans(vecs):
    near = vectors.top_k(vecs, vecs, 5, by_project=True)
    for project in range(3):
        one = vectors.top_k(vecs, vecs.filter(F.col("project") != project), 5).select("vec_id", "neighbour")
        merged = near.filter(F.col("p_") != project).drop("rank")
        from pyspark.sql import Window as W

        merged = merged.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("sim"), "neighbour"))).filter("rank <= 5").select("vec_id", "neighbour")
        assert sorted(one.collect()) == sorted(merged.collect())
    folds = learning.leave_one_project_out(vecs, "logistic").orderBy("project").collect()
    assert [(r.project, r.n_train, r.n_test) for r in folds] == [(0, 160, 80), (1, 160, 80), (2, 160, 80)] and all(r.f1 > 0.3 and 0.5 < r.macro_auc <= 1 for r in folds)
    row = learning.average(learning.leave_one_project_out(vecs, "logistic")).first()
    assert abs(row.f1 - sum(r.f1 for r in folds) / 3) < 1e-3 and row.f1_lo <= row.f1 <= row.f1_hi


def test_a_stored_model_says_the_same(vecs, tmp_path):
    rows = vecs.withColumnRenamed("embedding", "features")
    model = learning.fit("forest", rows, trees=5)
    learning.save(model, f"{tmp_path}/m")
    learning.save(model, f"{tmp_path}/m")  # again: replaced
    a, b = (sorted((r.vec_id, r.predicted) for r in learning.apply(x, rows).collect()) for x in (model, learning.load(f"{tmp_path}/m")))
    assert a == b


def test_commands(spark, vecs, commits, tmp_path):
    found, contents, diffs = commits
    doc = {"candidates": [json.loads(x) for x in found.drop("pr_url", "pr_title").toJSON().collect()]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    contents.write.parquet(f"{tmp_path}/contents")
    diffs.write.parquet(f"{tmp_path}/diffs")
    assert cli.main(["extract", "--candidates", f"{tmp_path}/c.json", "--contents", f"{tmp_path}/contents", "--diffs", f"{tmp_path}/diffs", "--output", f"{tmp_path}/x"]) == 0
    assert spark.read.json(f"{tmp_path}/x/metadata").first().total_pairs == 1
    vecs.select("vec_id", "embedding", F.col("label4").alias("label")).write.parquet(f"{tmp_path}/v")
    assert cli.main(["classify", "--embeddings", f"{tmp_path}/v", "--clf", "logistic", "--lopo", "--model-out", f"{tmp_path}/model", "--output", f"{tmp_path}/y"]) == 0
    assert spark.read.json(f"{tmp_path}/y/projects").count() == 6 and spark.read.json(f"{tmp_path}/y/average").count() == 1
    (tmp_path / "d").mkdir()
    body = "int m(int x) {\n  return x;\n}"
    (tmp_path / "d" / "a.diff").write_text("--- a/A.java\n+++ b/A.java\n@@ -1 +1,3 @@\n" + "\n".join("+  " + x for x in body.split("\n")))
    code = "\n".join("  " + x for x in body.split("\n"))
    spark.createDataFrame([(code, [3.0] * 8)], "code string, embedding array<double>").write.parquet(f"{tmp_path}/enc")
    assert cli.main(["screen", "--diff", f"{tmp_path}/d", "--model", f"{tmp_path}/model", "--vectors", f"{tmp_path}/enc", "--output", f"{tmp_path}/z"]) == 0
    r = spark.read.json(f"{tmp_path}/z/methods").first()
    assert (r.method, r.verdict) == ("m", "SAFE") and r.confidence > 0
    spark.createDataFrame([("java:S2095", 2), ("x", 3)], "rule string, label int").write.parquet(f"{tmp_path}/f")
    assert cli.main(["baselines", "--embeddings", f"{tmp_path}/v", "--findings", f"{tmp_path}/f", "--output", f"{tmp_path}/b"]) == 0
    assert {x.baseline: x.f1 for x in spark.read.json(f"{tmp_path}/b/baselines").collect()}["analyser"] == 1.0


def test_unknown_projects_are_named(spark):
    d = spark.createDataFrame([("a",), ("b",)], "project string")
    with pytest.warns(UserWarning, match="no project z"):
        assert mining.allowed(d, ["a", "z"]).count() == 1
    assert screening.NAMES[3] == "SAFE" and random.Random(1)
