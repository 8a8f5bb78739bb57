"""Classifiers, exact splits, word vectors, folds in parallel, and verdicts on a stream of diffs."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from millrace import __main__ as cli
from millrace.functions import text as T
from millrace.operators import learning, vectors
from millrace.streaming import screen


@pytest.fixture(scope="module")
def rings(spark):
    """Four classes that no plane parts: by distance from the middle and sign."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(320):
        label = i % 4
        angle, r = rng.uniform(0, 2 * np.pi), (0.5 if label % 2 else 2.0) + rng.normal(scale=0.1)
        rows.append((i, [float(r * np.cos(angle)), float(r * np.sin(angle)), float((label // 2) * 2 - 1)], label))
    return spark.createDataFrame(rows, "vec_id long, features array<double>, label4 int").persist()


@pytest.mark.parametrize("name,how", [("forest", {"trees": 30}), ("boosted", {"rounds": 8}), ("kernel", {"size": 200, "rounds": 25}), ("mlp", {})])
def test_classifiers_part_rings_that_planes_cannot(rings, tmp_path, name, how):
    train, test = rings.filter("vec_id >= 80"), rings.filter("vec_id < 80")
    model = learning.fit(name, train, **how)
    told = learning.apply(model, test, 0.0).collect()
    assert np.mean([r.predicted == r.label4 for r in told]) > 0.9
    assert all(len(r.probability) == 4 and abs(sum(r.probability) - 1) < 1e-6 for r in told)
    learning.save(model, f"{tmp_path}/m")
    again = learning.apply(learning.load(f"{tmp_path}/m"), test, 0.0).collect()
    assert [(r.vec_id, r.predicted) for r in again] == [(r.vec_id, r.predicted) for r in told]


def test_logistic_is_a_plane(rings):
    told = learning.predict("logistic", rings, rings, 0.0).collect()
    assert 0.3 < np.mean([r.predicted == r.label4 for r in told]) < 0.8


def test_a_class_that_training_lacks(rings):
    for name, how in (("boosted", {"rounds": 3}), ("forest", {"trees": 5})):
        told = learning.predict(name, rings.filter("label4 < 3"), rings.filter("label4 = 3"), **how).collect()
        assert all(len(r.probability) == 4 and r.probability[3] < 1e-6 for r in told)


def test_own_classifiers(rings):
    @learning.classifier("own")
    def build(train, width, rows, seed):
        return LogisticRegression(labelCol="label4", maxIter=5)

    try:
        assert {r.classifier for r in learning.compare(rings, rings, ("own", "logistic")).collect()} == {"own", "logistic"}
    finally:
        del learning.BUILDERS["own"]
    with pytest.raises(ValueError, match="no classifier own"):
        learning.fit("own", rings)


@pytest.mark.parametrize("few", [5, 10_000])
@pytest.mark.parametrize("n,ratio", [(0, 0.9), (1, 0.9), (10, 0.9), (997, 0.9), (997, 0.0), (997, 1.0), (2000, 0.333)])
def test_exact_split(spark, monkeypatch, n, ratio, few):
    monkeypatch.setattr(vectors, "FEW", few)
    got = {r.vec_id: r.in_train for r in vectors.exact_split(spark.range(n).withColumnRenamed("id", "vec_id"), ratio).collect()}
    order = sorted(range(n), key=lambda i: (hashlib.sha256(f"42:{i}".encode()).hexdigest(), i))
    assert {i for i, t in got.items() if t} == set(order[: int(n * ratio)]) and len(got) == n


def test_word_vectors_tell_words_apart(spark):
    rng = np.random.default_rng(2)
    kinds = [["lock", "unlock", "wait"], ["put", "cache", "map"], ["open", "close", "stream"], ["plus", "minus", "times"]]
    rows = [(i, [str(rng.choice(kinds[i % 4])) for _ in range(12)], i % 4) for i in range(120)] + [(500, [], 3), (501, None, 3), (502, ["unknown"], 3)]
    d = spark.createDataFrame(rows, "vec_id long, tokens array<string>, label4 int").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).withColumn("in_train", F.col("vec_id") < 100)
    v = learning.word_vectors(d, size=16, rounds=10).persist()
    assert all(r.features == [0.0] * 16 for r in v.filter("vec_id >= 500").collect())
    m = vectors.detection_metrics(learning.predict("forest", v.filter("in_train"), v.filter("vec_id BETWEEN 100 AND 119"), trees=20), "label4", "predicted").first()
    assert m.f1 > 0.9


def test_forest_folds_equal_separate_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 2 * (i % 4)], i % 4, i % 3, True) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int, in_train boolean")
    folds = {r.project: r for r in learning.leave_one_project_out(v, "forest", trees=10).collect()}
    assert sorted(folds) == [0, 1, 2] and not spark.sparkContext._jsc.getPersistentRDDs().size() > 40
    for project in folds:
        others = v.filter(F.col("project") != project)
        near = vectors.top_k(v, others)
        m = vectors.feature_vector(v, vectors.retrieval_features(near))
        told = learning.predict("forest", m.filter(F.col("project") != project), m.filter(F.col("project") == project), trees=10)
        one = vectors.detection_metrics(told, "label4", "predicted").first()
        assert (one.tp, one.fp, one.fn) == (folds[project].tp, folds[project].fp, folds[project].fn)


def test_verdicts_once_each(spark, tmp_path):
    rows = [(i, [1.0 if i % 2 else -1.0, float(i % 5)], 0 if i % 2 else 3, 0, True) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int, in_train boolean")
    m = vectors.feature_vector(v, vectors.retrieval_features(vectors.top_k(v, v)))
    learning.save(learning.fit("forest", m, trees=5), f"{tmp_path}/model")
    v.write.parquet(f"{tmp_path}/model-index")
    body = lambda n: f"  int {n}(int x) {{\n    return x;\n  }}"
    encoded = [(body("bad"), [1.0, 2.0]), (body("good"), [-1.0, 2.0])]
    spark.createDataFrame(encoded, "code string, embedding array<double>").write.parquet(f"{tmp_path}/encoded")
    source, sink, marks = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/marks"
    source.mkdir()

    def arrive(name, *methods):
        (source / name).write_text("--- a/A.java\n+++ b/A.java\n@@ -1 +1,3 @@\n" + "\n".join("+" + x for n in methods for x in body(n).split("\n")))

    def run():
        screen.verdict_stream(spark, str(source), sink, marks, f"{tmp_path}/model", f"{tmp_path}/encoded", most=1).awaitTermination()
        return sorted((r.file_name, r.method, r.verdict, r.label_name) for r in screen.read_verdicts(spark, sink).collect())

    arrive("1.diff", "bad", "good")
    first = run()
    assert first == [("1.diff", "bad", "FAULT", "LOCK_CONTENTION"), ("1.diff", "good", "SAFE", "SAFE")]
    assert run() == first
    arrive("2.diff", "bad")
    arrive("3.diff", "other")
    every = run()
    assert every == [*first, ("2.diff", "bad", "FAULT", "LOCK_CONTENTION"), ("3.diff", "other", "SAFE", "SAFE")]
    for f in Path(f"{marks}/commits").glob("*2*"):  # lost between the write and the mark
        f.unlink()
    assert run() == every


def test_baselines_take_other_vectors_and_code(spark, tmp_path):
    rows = [(i, [float(i % 4 == k) + 0.01 * (i % 7) for k in range(4)], i % 4) for i in range(80)]
    for name in ("v", "other"):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}")
    words = ["synchronized lock.lock()", "cache.put(x)", "new FileInputStream(f)", "return x"]
    spark.createDataFrame([(f"void m{i}() {{ {words[i % 4]}; }}", i % 4) for i in range(80)], "source string, label int").write.parquet(f"{tmp_path}/code")
    assert cli.main(["baselines", "--embeddings", f"{tmp_path}/v", "--extra-embeddings", f"{tmp_path}/other", "--code", f"{tmp_path}/code", "--output", f"{tmp_path}/b"]) == 0
    got = {r.baseline: r for r in spark.read.json(f"{tmp_path}/b/baselines").collect()}
    assert set(got) == {"vectors, forest without retrieval", "other, forest without retrieval", "retrieval votes", "patterns", "word vectors, forest"}
    assert got["other, forest without retrieval"].f1 == got["vectors, forest without retrieval"].f1 == 1.0 and got["word vectors, forest"].f1 > 0.5
    assert T.MODIFIERS[0] == "public"


def test_search_passes_over_groups_and_equals_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 6)) * 8
    rows = [(i, [float(x) for x in middles[i % 12] + rng.normal(scale=0.2, size=6)], i % 4, 0) for i in range(900)]
    rows += [(2000 + i, rows[i][1], 1, 0) for i in range(30)]  # ties
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int")
    items, asked = v.filter("vec_id % 10 != 0"), v.filter("vec_id % 10 = 0")
    vectors.write_index(items, f"{tmp_path}/index", block_bytes=2400)
    near, told = vectors.search(asked, f"{tmp_path}/index", 7, block_bytes=1200)
    want = sorted((r.vec_id, r["rank"], r.neighbour) for r in vectors.top_k(asked, items, 7).collect())
    assert sorted((r.vec_id, r["rank"], r.neighbour) for r in near.collect()) == want
    assert told["met"] < 0.6 * told["pairs"], told


@pytest.mark.parametrize("n_items,n_asked", [(0, 3), (3, 0), (3, 3)])
def test_search_of_few(spark, tmp_path, n_items, n_asked):
    v = spark.createDataFrame([(i, [float(i), 1.0], 0, 0) for i in range(10)], "vec_id long, embedding array<double>, label4 int, project int")
    vectors.write_index(v.filter(F.col("vec_id") < n_items), f"{tmp_path}/index")
    near, _ = vectors.search(v.filter(F.col("vec_id") >= 10 - n_asked), f"{tmp_path}/index", 5)
    assert near.count() == n_items * n_asked
