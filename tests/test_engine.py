"""Rules, scalars, statistics, sources and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import flow, rules, stats
from millrace.functions import text as T
from millrace.operators import fusion, mining, screening, validation, vectors
from millrace.plans import catalog, corpus
from millrace.sources import readers
from millrace.streaming.screen import screen_stream


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def hits(spark):
    t = [(i, *[x.replace("~", "\n") for x in pair]) for i, pair in enumerate(corpus.TEMPLATES)]
    return fusion.fuse(fusion.rule_hits(spark.createDataFrame(t, "pair_key int, before_source string, after_source string"))).collect()


def test_every_rule_hits_and_misses(hits):
    for column, ids in (("structural_changes", [r.id for r in rules.CHANGES]), ("multi_fault_signals", [r.id for r in rules.COMBINED]), ("findings", list(flow.FINDINGS))):
        for i in ids:
            n = sum(i in h[column] for h in hits)
            assert 0 < n < len(hits), i
    assert {h["confidence"] for h in hits} == {"low", "medium", "high"}
    for h in hits:
        assert h["all_categories"] == sorted(set(h["all_categories"]))
        assert bool(h["dependency_label"]) == h["is_multi_fault"]


def test_one_parent_two_categories_is_multi_but_neither_dual_nor_triple(spark):
    d = spark.createDataFrame([(["synchronization"], True), (["a", "b"], True), (["a", "b", "c"], True), (["a"], False)], "all_parents array<string>, is_multi_fault boolean")
    r = fusion.report(d).first()
    assert (r.total, r.multi, r.dual, r.triple, r.rate) == (4, 3, 1, 1, "75.0%")


def test_class_filter():
    assert mining.parse_class_filter("ml+rl") == (("ML", "RL"), True)
    assert mining.parse_class_filter("LC+LC") == (("LC",), False)
    assert mining.parse_class_filter(" All ") == ((), False)
    for bad in ("XX", "all+LC"):
        with pytest.raises(ValueError):
            mining.parse_class_filter(bad)


def test_dedupe_and_confidence(spark):
    rows = [("a", "m.x", "keyword", 1), ("a", "m.x", "keyword", 2), ("a", "m.x", "structural", 3), ("b", "m.x", "structural", 3), ("b", "s.y", "keyword", 1), *[("c", f"p{i}.z", "keyword", 1) for i in range(3)], ("c", "m.x", "structural", 3)]
    s = mining.strongest(spark.createDataFrame(rows, "k string, category string, source string, layer int"), "k")
    got = {r.k: (r.signal_count, r.confidence) for r in mining.candidates(s, "k").collect()}
    assert got == {"a": (1, "low"), "b": (2, "medium"), "c": (4, "high")}
    again = mining.strongest(s, "k")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, s.collect()))


def test_text_scalars(spark):
    assert one(spark, T.token_count(F.col("s")), s="int größe = a_b(1);") == 8
    assert one(spark, T.issue_ids(F.col("s")), s="Fixes #12, HBASE-7") == ["12", "HBASE-7"]
    h = one(spark, T.hunks(F.col("s")), s="@@ -10 +10,0 @@ x\n@@ -1,3 +2,4 @@")
    assert [tuple(x) for x in h] == [(10, 1, 10, 0), (1, 3, 2, 4)]
    m = one(spark, T.methods(F.col("s")), s="int f() { return 1; }\n\nint g(int a) {\n  return a;\n}")
    assert [(x.name, x.start_line, x.end_line) for x in m] == [("f", 1, 2), ("g", 3, 5)]
    assert one(spark, F.size(T.windows(T.tokens(F.col("s")))), s="a " * 513) == 2
    assert one(spark, T.method_body(F.col("s"), F.lit("g")), s="int f() {\n}\nint g() {\n  if (x) {\n  }\n}\nint h") == "int g() {\n  if (x) {\n  }\n}"
    assert one(spark, T.changed_methods(F.col("s")), s="@@ -1 +1 @@ void ctx(int\n+  public int add(int x) {\n-  if (a) {\n+++ b/x(") == ["add", "ctx"]


def test_flow_profile(spark):
    p = one(spark, flow.profile(F.col("s")), s="synchronized (a) { x(); }\nsynchronized (b) {\n synchronized (c) {\n  f.read(1);\n }\n}")
    assert (p.lock_depth, p.lock_acquires, p.io_in_lock, p.unclosed_resources) == (2, 3, True, 0)
    q = one(spark, flow.profile(F.col("s")), s="new FileInputStream(f); new Socket(h); x.close();")
    assert (q.resource_allocations, q.unclosed_resources) == (2, 1)


def test_t_tail_and_wilson(spark):
    for n, t in ((3, 12.706), (5, 3.1824), (12, 2.228139), (26, 2.0639)):
        df = n - 2
        p = one(spark, stats.t_two_sided(F.col("r2"), F.lit(n)), r2=t * t / (t * t + df))
        assert abs(p - 0.05) < 2e-4
    lo, hi = stats.wilson(F.col("h"), F.col("n"))
    assert 0 <= one(spark, lo, h=0.0, n=5.0) < one(spark, hi, h=5.0, n=5.0) <= 1
    assert one(spark, lo, h=0.0, n=0.0) is None


def test_signed_rank_exact(spark):
    d = spark.createDataFrame([("a", float(i), 0.0) for i in range(1, 6)] + [("z", 1.0, 1.0), ("z", 2.0, 2.0), ("s", 1.0, 0.0)], "k string, x double, y double")
    got = {r.k: (r.n, r.w, r.p) for r in stats.signed_rank(d, ["k"]).collect()}
    assert got == {"a": (5, 15.0, 1 / 32), "z": (2, 0.0, 1.0), "s": (1, 1.0, None)}


def test_kappa(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "a int, b int")
    assert tuple(stats.kappa(d, "a", "b").first()) == (4, 0.5)


def test_metrics_and_thresholds(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (3, 3), (3, 2)], "t int, p int")
    r = vectors.detection_metrics(d, "t", "p").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 0, 0.5, 1.0, 0.667)
    p = spark.createDataFrame([([0.39, 0.31, 0.2, 0.1],), ([0.2, 0.4, 0.4, 0.0],)], "p array<double>")
    assert [r[0] for r in p.select(vectors.threshold("p")).collect()] == [3, 1]
    v = spark.createDataFrame([(1, i, x) for i, x in enumerate((3, 0, 0, 3, 2))], "k int, o int, v int")
    assert vectors.majority(v, "k", "v", "o").first()["predicted"] == 3
    a = spark.createDataFrame([("This looks unsafe",), ("LOCK_CONTENTION? memory_leak",)], "s string")
    assert [r[0] for r in a.select(fusion.parsed_answer(F.col("s"))).collect()] == [3, 0]


def test_verdicts(spark):
    def series(rows):
        return spark.createDataFrame([(1, v, i, float(x)) for v, xs in rows.items() for i, x in enumerate(xs)], "entry int, variant string, ordinal int, value double")

    r = validation.leak_verdict(series({"buggy": (100, 101, 102, 103), "fixed": (5, 5, 5, 5)})).first()
    assert (r.passed, r.growth_pct) == (True, 3.0)
    assert not validation.leak_verdict(series({"buggy": (1, 2, 3), "fixed": (1, 1, 1)})).first().passed
    bench = spark.createDataFrame([(1, v, t, i, float(x)) for t in (8, 64) for v, xs in (("buggy", range(6)), ("fixed", range(10, 70, 10))) for i, x in enumerate(xs)], "entry int, variant string, threads int, ordinal int, value double")
    assert validation.contention_verdict(bench).first().passed
    assert not validation.contention_verdict(bench.filter("threads = 8")).first().passed


def test_top_k_forms_agree(spark):
    v = catalog._vectors(spark, "/root/testdata/sf0.001").limit(120)
    a = vectors.top_k(v, v).select("vec_id", "rank", "neighbour").collect()
    b = vectors.top_k(v, v, block_bytes=1 << 14).select("vec_id", "rank", "neighbour").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


DIFF = "+++ b/A.java\n@@ -1 +1,3 @@\n+int f(int x) {\n+  return x;\n+}\n+++ b/notes.txt\n@@ -1 +1,3 @@\n+int no(int x) {\n+  return x;\n+}\n+++ b/B.java\n@@ -1 +1,3 @@\n+int g(int x) {\n+  return 1;\n+}"


def test_screening(spark, tmp_path):
    d = spark.createDataFrame([("p", DIFF), ("n", None), ("e", "")], "k string, diff string")
    m = screening.screened_methods(d, "k")
    assert sorted((r.k, r.file, r.method) for r in m.collect()) == [("p", "A.java", "f"), ("p", "B.java", "g")]
    v = screening.verdicts(m.withColumn("label", F.when(F.col("method") == "f", 0).otherwise(1)).withColumn("confidence", F.when(F.col("method") == "f", 0.9).otherwise(0.3)))
    report = screening.screen_report(v)
    assert tuple(report.first()) == (2, 1, 1, 0, 0)
    assert screening.exit_code(report, True) == 1 and screening.exit_code(report, False) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.diff").write_text(DIFF)
    screen_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "log").write_text("h|||a|||d|||m|||p1 p2\nbroken|||x\n")
    assert tuple(readers.commit_log(spark, str(tmp_path / "log")).first()) == ("h", "a", "d", "m", "p1")
    (tmp_path / "rec").write_text("h1\x1fsub\x1fbody\nmore<<<END>>>\nh2\x1fs2\x1f<<<END>>>\n")
    assert sorted(r.commit_hash for r in readers.commit_records(spark, str(tmp_path / "rec")).collect()) == ["h1", "h2"]
    (tmp_path / "result_t8.json").write_text(json.dumps([{"benchmark": "x.Buggy.run", "threads": 8, "primaryMetric": {"rawData": [[1.0, 2.0], [3.0]]}}, {"benchmark": "x.buggy", "threads": 4, "primaryMetric": {"rawData": [[9.0]]}}]))
    assert [r.value for r in readers.benchmark_results(spark, str(tmp_path / "result_t*.json"), "BUGGY").orderBy("ordinal").collect()] == [1.0, 2.0, 3.0]
    (tmp_path / "x_heap.log").write_text("a heapMB=10 heapMB=11\nnothing\nheapMB=12\n")
    assert [r.value for r in readers.heap_log(spark, str(tmp_path / "x_heap.log")).orderBy("line").collect()] == [10.0, 12.0]
    (tmp_path / "fd.csv").write_text("a,1\nb,x\nc,2,3\nd, 4\n")
    assert [r.value for r in readers.descriptor_counts(spark, str(tmp_path / "fd.csv")).orderBy("line").collect()] == [1.0, 4.0]
    (tmp_path / "tax.json").write_text(json.dumps({"taxonomy": {"memory": {"label": "m", "subcategories": {"leak": {"commit_keywords": ["a", "b"], "structural_patterns_before": ["p"], "structural_patterns_after": [], "sub_patterns": {"k": {"patterns_before": ["q"], "patterns_after": ["r"]}}}}}}}))
    assert readers.taxonomy(spark, str(tmp_path / "tax.json")).count() == 5
    (tmp_path / "pairs.json").write_text(json.dumps({"pairs": [{"pair_id": "1", "structural_changes": ["a", "b"]}, {"pair_id": "2"}]}))
    pairs = readers.json_rows(spark, str(tmp_path / "pairs.json"), "pairs", readers.PAIR)
    readers.write_csv(pairs, str(tmp_path / "out"), ["pair_id", "structural_changes", "missing"])
    back = readers.code_csv(spark, str(tmp_path / "out"), "pair_id string, structural_changes string, missing string")
    assert sorted((r.pair_id, r.structural_changes or "") for r in back.collect()) == [("1", "a|b"), ("2", "")]
    both = readers.union_all([pairs.select("pair_id"), spark.range(1)])
    assert both.columns == ["pair_id", "id"] and both.count() == 3


def test_taxonomy_rules_and_lookups(spark, tmp_path):
    tax = {"taxonomy": {"memory": {"subcategories": {"leak": {"commit_keywords": ["Leak", "bad("], "structural_patterns_before": [r"\.put\("], "structural_patterns_after": [r"\.remove\("], "sub_patterns": {"k": {"patterns_before": ["a.b"], "patterns_after": []}}}}}}}
    (tmp_path / "t.json").write_text(json.dumps(tax))
    keywords, patterns = mining.rules_of(readers.taxonomy(spark, str(tmp_path / "t.json")))
    assert keywords == [("memory.leak", 0, "Leak")] and len(patterns) == 3
    d = spark.createDataFrame([("c", "a leak", "-m.put(a\n-b)\n+m.remove(a)"), ("d", "none", "-m.put(a)\n-a b"), ("e", None, None)], "k string, message string, diff string")
    assert [r.k for r in mining.keyword_signals(d, "k", F.col("message"), 1, keywords).collect()] == ["c"]
    got = {r.k: (r.source, r.evidence) for r in mining.diff_signals(d, "k", patterns=patterns).collect()}
    assert got == {"c": ("structural", r"after:\.remove\(|before:\.put\("), "d": ("structural_partial", r"before:\.put\(|before:a.b")}
    p = mining.with_project(spark.createDataFrame([("x/y",), ("u/v/w",)], "repo string"), spark.createDataFrame([("x/y", "Y")], "path string, project string"))
    assert sorted(r.project for r in p.collect()) == ["Y", "w"]
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "z", 5)], "k int, v string, n int")
    assert sorted(map(tuple, mining.overlay(left, right, "k").collect())) == [(1, "z", 5), (2, "b", None)]
    assert one(spark, T.code_tokens(F.col("s"), True), s="if (a_1) { b(); }") == ["if", "(", "a_1", ")", "{", "b", "(", ")", ";", "}"]
    assert one(spark, T.padded(T.code_tokens(F.col("s")), 3, F.lit("")), s="a b") == ["a", "b", ""]


def test_command_line(spark, tmp_path):
    from millrace.__main__ import main

    (tmp_path / "a.diff").write_text("+++ b/A.java\n@@ -1 +1,4 @@\n+int f(Lock l) {\n+  synchronized (l) { Thread.sleep(1); }\n+  return 1;\n+}\n")
    args = ["screen", "--diff", str(tmp_path / "a.diff"), "--output", str(tmp_path / "r")]
    assert main([*args, "--fail-on-fault"]) == 1 and main(args) == 0
    assert main(["screen", "--diff", str(tmp_path / "none"), "--output", str(tmp_path / "x")]) == 2
    c = spark.createDataFrame([("h", "o/r", "fix memory leak", "-m.put(a)\n+m.remove(a)", ["A.java"]), ("n", "o/r", "docs", "", [])], "commit_hash string, repo string, message string, diff string, files array<string>")
    c.write.parquet(str(tmp_path / "c"))
    assert main(["mine", "--commits", str(tmp_path / "c"), "--fault-filter", "ML", "--output", str(tmp_path / "m")]) == 0
    assert [r.commit_hash for r in spark.read.json(str(tmp_path / "m" / "candidates")).collect()] == ["h"]
    (tmp_path / "p.json").write_text(json.dumps({"pairs": [{"pair_id": "1", "before_source": "synchronized (a) {\n m.put(1);\n}", "after_source": "m.put(1);\nm.clear();"}, {"pair_id": "2"}]}))
    assert main(["detect", "--method-pairs", str(tmp_path / "p.json"), "--output", str(tmp_path / "d")]) == 0
    assert spark.read.json(str(tmp_path / "d" / "totals")).first().multi == 1
