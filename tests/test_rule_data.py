"""Rules as data against rules in the plan and against plain matching."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import rules as R
from millrace.operators import mining, rule_data


@pytest.mark.parametrize("pattern,words", [
    ("memory leak", ["memory leak"]), (r"leak(s|ed)? memory|heap growth", [" memory", "heap growth"]), (r"\bdeadlock\b", ["deadlock"]), (r"a+bc?d", []), (r"lock(?:ed)?s", ["lock"]),
    (r"[a-z]+", []), (r"busy[- ]wait", ["busy"]), (r"\.put\(", [".put("]), (r"x{2,3}yz", ["yz"]), (r"(a|b)|cd", []), (r"Straße", ["strasse"]), (r"\Qa.b\E", []), ("", []), (r"ab(c[)]d)ef", ["ab"]), (r"(?x) a b c", []), (r"ab(?i:cd)", []), (r"ab*cde", ["cde"]),
])
def test_fixed_words(pattern, words):
    assert rule_data.fixed_words(pattern) == words


def test_every_match_holds_a_fixed_word():
    rng = random.Random(3)
    for _ in range(3000):
        pattern = "".join(rng.choice(["a", "b", "c", "d", r"\.", "[ab]", "(a|b)", "(bc)?", "a*", "b+", "c{1,2}", "d?", "|", r"\w", "."]) for _ in range(rng.randint(1, 7)))
        words = rule_data.fixed_words(pattern)
        for _ in range(5):
            text = "".join(rng.choice("abcd.") for _ in range(12))
            if words and re.search(pattern, text):
                assert any(w in text for w in words), (pattern, text)


def taxonomy(spark, n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b = (f"w{rng.randint(0, 60)}" for _ in range(2))
        rows.append((f"c{i % 37}.s", "keyword", "", i, rng.choice([f"{a} {b}", rf"\b{a}\b", rf"{a}\s+{b}", f"{a}(x|y)? {b}", f"[{a}]{{9}}q", f"{a}|{b}z"])))
        rows.append((f"c{i % 37}.s", rng.choice(["pattern", "sub"]), rng.choice(["before", "after"]), i, rng.choice([f"{a}.*{b}", rf"{a}\(", f"{a}"])))
    rows += [("bad.s", "keyword", "", 0, "bad("), ("bad.s", "pattern", "after", 0, "bad[")]
    return spark.createDataFrame(rows, "category string, kind string, side string, ordinal int, pattern string")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    word = lambda: f"W{rng.randint(0, 60)}" if rng.random() < 0.5 else f"w{rng.randint(0, 60)}"
    rows = [("r", f"k{i}", " ".join(word() for _ in range(60)), "\n".join(rng.choice("+- ") + " ".join(word() for _ in range(5)) + rng.choice(["", "("]) for _ in range(8))) for i in range(40)]
    rows += [("r", "null", None, None), ("r", "empty", "", ""), ("fork", "k1", rows[1][2], rows[1][3])]
    return spark.createDataFrame(rows, "repo string, hash string, message string, diff string")


KEY = ("repo", "hash")


def same(a, b):
    cols = [*KEY, "category", "source", "layer"]
    left, right = ({tuple(r[c] for c in cols): sorted(r.evidence.split("|")) for r in d.collect()} for d in (a, b))
    assert left == right and left


def test_equals_rules_in_the_plan(spark, texts):
    tax = taxonomy(spark, 60)
    keywords, patterns = mining.rules_of(tax)
    rules = rule_data.numbered(tax)
    same(rule_data.keyword_signals(texts, KEY, F.col("message"), 1, rules), mining.keyword_signals(texts, KEY, F.col("message"), 1, keywords))
    same(rule_data.diff_signals(texts, KEY, rules), mining.diff_signals(texts, KEY, patterns=patterns))


def test_five_thousand_rules(spark, texts, tmp_path, monkeypatch):
    tax = taxonomy(spark, 5000)
    tax.write.parquet(f"{tmp_path}/t")
    rules = rule_data.numbered(spark.read.parquet(f"{tmp_path}/t"))
    found = rule_data.hits(texts.select(*KEY, "message"), "message", rules.filter("kind = 'keyword'"))
    got = {(r.hash, r.ordinal) for r in found.filter("repo = 'r'").collect()}
    known, asked = tax.filter("kind = 'keyword' AND category != 'bad.s'").collect(), texts.filter("repo = 'r' AND message IS NOT NULL").collect()
    want = {(t.hash, r.ordinal) for r in known for t in asked if re.search(r.pattern, t.message, re.I)}
    assert got == want and len(got) > 1000
    taxonomy(spark, 50).write.parquet(f"{tmp_path}/u")
    few = rule_data.hits(texts.select(*KEY, "message"), "message", rule_data.numbered(spark.read.parquet(f"{tmp_path}/u")).filter("kind = 'keyword'"))
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(found) - size(few)) < 200
    monkeypatch.setattr(rule_data, "PART_BYTES", 5000)  # many parts
    again = rule_data.hits(texts.select(*KEY, "message"), "message", rules.filter("kind = 'keyword'"))
    assert {(r.hash, r.ordinal) for r in again.filter("repo = 'r'").collect()} == want


def test_no_rules(spark, texts):
    rules = rule_data.numbered(taxonomy(spark, 1).limit(0))
    assert rule_data.keyword_signals(texts, KEY, F.col("message"), 1, rules).count() == 0


def test_said_is_has_whatever_the_case(spark):
    texts = ["Memory LEAK", "leaſ loſt", "\u212aernel leak", "LEAKS memory heap growth", "", None, "STRASSE Straße", "dead lock", "Deadlock!", "ünlock ÜNLOCK"]
    patterns = ["leak", "los(t|s)", "kernel", r"leak(s|ed)? memory|heap growth", r"\bdeadlock\b", "straße", "ünlock", "les"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", R.folded(F.col("t")))
    for r in d.select("t", *[R.said(F.col("f"), p).alias(f"a{i}") for i, p in enumerate(patterns)], *[R.has("t", p, "i").alias(f"b{i}") for i, p in enumerate(patterns)]).collect():
        assert [r[f"a{i}"] for i in range(len(patterns))] == [r[f"b{i}"] for i in range(len(patterns))], r.t
