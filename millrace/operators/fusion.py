"""Method pairs: rule hits, profiles, fusion of the evidence, and reports on co-occurring faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import flow
from ..functions import rules as R


def rule_hits(pairs: DataFrame) -> DataFrame:
    """pairs with structural_changes, multi_fault_signals (ids) and detected (sorted categories of both)."""
    d = pairs.withColumn("structural_changes", R.fired(R.change_rules("before_source", "after_source"))).withColumn("multi_fault_signals", R.fired(R.combined_rules("before_source", "after_source")))
    kinds = F.create_map(*[F.lit(x) for r in R.CHANGES for x in (r.id, r.category)])
    lists = F.create_map(*[x for r in R.COMBINED for x in (F.lit(r.id), F.array(*[F.lit(c) for c in r.categories]))])
    own = F.transform("structural_changes", lambda i: F.element_at(kinds, i))
    more = F.flatten(F.transform("multi_fault_signals", lambda i: F.element_at(lists, i)))
    return d.withColumn("detected", F.array_sort(F.array_distinct(F.concat(own, more))))


def paper_label(categories: str | Column) -> Column:
    """Labels of sorted categories joined by '+', first seen first; else the first category, else UNKNOWN."""
    c = F.col(categories) if isinstance(categories, str) else categories

    def one(x: Column) -> Column:
        return F.filter(F.array(*[F.when(x.startswith(p), F.lit(v)) for p, v in R.PAPER.items()]), lambda y: y.isNotNull())

    labels = F.array_distinct(F.flatten(F.transform(c, one)))
    return F.when(F.size(labels) > 0, F.array_join(labels, "+")).otherwise(F.coalesce(F.get(c, 0), F.lit("UNKNOWN")))


def _lookup(ids: Column, table: dict[str, tuple[str, ...]]) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return F.flatten(F.transform(ids, lambda i: F.coalesce(F.try_element_at(m, i), F.array().cast("array<string>"))))


def _holds(words: tuple[str, ...]):
    return lambda c: R.any_of(F.contains(F.lower(c), F.lit(w)) for w in words)


def fuse(hits: DataFrame) -> DataFrame:
    """``rule_hits`` rows with findings, all_categories, all_parents, is_multi_fault, fault_count, dependency_label,
    detection_layers, confidence and validation_needed."""
    d = hits.withColumn("b", flow.profile(F.col("before_source"))).withColumn("a", flow.profile(F.col("after_source")))
    d = d.withColumn("findings", flow.findings()).drop("a", "b")
    parts = F.flatten(F.transform("multi_fault_signals", lambda s: F.split(F.substring_index(s, ":", 1), r"\+")))
    category = _lookup(parts, {k: (c,) for k, (_, c) in R.ABBREVIATIONS.items()})
    parent = _lookup(parts, {k: (p,) for k, (p, _) in R.ABBREVIATIONS.items()})
    d = d.withColumn("all_categories", F.array_sort(F.array_distinct(F.concat("detected", category, _lookup(F.col("findings"), {k: c for k, (_, _, c) in flow.FINDINGS.items()})))))
    own = F.transform("detected", lambda c: F.substring_index(c, ".", 1))
    d = d.withColumn("all_parents", F.array_sort(F.array_distinct(F.concat(own, parent, _lookup(F.col("findings"), {k: p for k, (_, p, _) in flow.FINDINGS.items()})))))
    multi = (F.size("all_parents") >= 2) | (F.size("all_categories") >= 2)
    layers = (F.size("multi_fault_signals") > 0).cast("int") + (F.size("findings") > 0).cast("int") + (F.size("detected") >= 2).cast("int")
    short = F.create_map(*[F.lit(x) for kv in R.SHORT.items() for x in kv])
    label = F.array_join(F.transform("all_parents", lambda p: F.coalesce(F.try_element_at(short, p), F.upper(p))), "+")
    hints = F.filter(F.array(*[F.when(F.exists("all_categories", _holds(words)), F.lit(text)) for words, text in R.HINTS]), lambda x: x.isNotNull())
    d = d.withColumn("is_multi_fault", multi).withColumn("fault_count", F.size("all_categories"))
    d = d.withColumn("dependency_label", F.when(F.col("is_multi_fault"), label).otherwise(""))
    d = d.withColumn("detection_layers", F.when(F.col("is_multi_fault"), layers).otherwise(0))
    d = d.withColumn("confidence", F.when(F.col("detection_layers") >= 3, "high").when(F.col("detection_layers") >= 2, "medium").otherwise("low"))
    return d.withColumn("validation_needed", F.when(F.col("is_multi_fault"), hints).otherwise(F.array().cast("array<string>")))


def co_occurrence(fused: DataFrame, items: str, top: int | None = None) -> DataFrame:
    """first, second, n: unordered pairs of a row's items over multi-fault rows, most frequent first."""
    left = fused.filter("is_multi_fault").select(F.col(items).alias("x"), F.posexplode(items).alias("i", "first"))
    pairs = left.select("first", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("second"))
    counts = pairs.groupBy("first", "second").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "first", "second").limit(top) if top else counts


def report(fused: DataFrame) -> DataFrame:
    """One row: totals, multi-fault, dual (two parents), triple (three or more), and the multi rate to one decimal."""
    n = F.size("all_parents")
    total, multi = F.count("*"), F.count_if("is_multi_fault")
    d = fused.agg(total.alias("total"), multi.alias("multi"), F.count_if(F.col("is_multi_fault") & (n == 2)).alias("dual"), F.count_if(F.col("is_multi_fault") & (n >= 3)).alias("triple"))
    return d.withColumn("rate", F.concat(F.round(100.0 * F.col("multi") / F.greatest("total", F.lit(1)), 1).cast("string"), F.lit("%")))


def chains(fused: DataFrame, key: str) -> DataFrame:
    """key, all_parents, all_categories, dependency_label of rows of three parents or more."""
    return fused.filter(F.size("all_parents") >= 3).select(key, "all_parents", "all_categories", "dependency_label")


def by_confidence(fused: DataFrame) -> DataFrame:
    """confidence, n over multi-fault rows, zeros included."""
    row = fused.filter("is_multi_fault").agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("low", "medium", "high")])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("confidence"), F.col(c).alias("n")) for c in ("low", "medium", "high")])).alias("x")).select("x.*")


def finding_label(rule: Column) -> Column:
    """The label of an analyser's rule key; safe for other keys."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in R.RULE_KEYS.items() for x in kv]), rule), F.lit(R.SAFE))


def expected_ranges(fused: DataFrame, expected: DataFrame) -> DataFrame:
    """alias, found, in_range for each (alias, categories, lo, hi): rows whose label holds the alias, '+' aside, or that
    share a category with it. The few expectations are the small side."""
    f = fused.filter("is_multi_fault").select("dependency_label", "all_categories")
    e = expected.select("alias", "categories", "lo", "hi")
    near = F.contains(F.replace("dependency_label", F.lit("+"), F.lit("")), F.replace("alias", F.lit("+"), F.lit(""))) | F.arrays_overlap("all_categories", "categories")
    counts = f.join(e, near).groupBy("alias").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0))
    return e.join(counts, "alias", "left").select("alias", found.alias("found"), found.between(F.col("lo"), F.col("hi")).alias("in_range"))


#: What tells a file of a commit; a fork has the hashes of its origin.
FILE = ("repo", "commit_hash", "file_path")


def matched_methods(before: DataFrame, after: DataFrame, hunks: DataFrame, file: tuple[str, ...] = FILE) -> DataFrame:
    """Methods of both sides with one signature (the last of several wins) whose text changed and that a hunk touches.

    before, after: the columns of ``file``, signature, start_line, end_line, source; hunks: the columns of ``file``,
    old_start, old_count, new_start, new_count. Other columns are those of the side before."""
    keys = [*file, "signature"]

    def last(d: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(F.desc("start_line"))
        return d.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")

    def touched(d: DataFrame, start: str, count: str) -> DataFrame:
        h = hunks.select(*[F.col(c).alias(f"{c}_") for c in file], F.col(start).alias("s_"), (F.col(start) + F.col(count) - 1).alias("e_"))
        on = (d.start_line <= h.e_) & (d.end_line >= h.s_)
        for c in file:
            on = on & (d[c] == h[f"{c}_"])
        return d.join(h, on, "left_semi").select(*keys)

    b, a = last(before), last(after)
    hit = touched(b, "old_start", "old_count").union(touched(a, "new_start", "new_count")).distinct()
    right = a.select(*keys, F.col("source").alias("after_source"), F.col("start_line").alias("after_start"), F.col("end_line").alias("after_end"))
    both = b.withColumnRenamed("source", "before_source").join(right, keys).join(hit, keys, "left_semi")
    return both.filter(F.trim("before_source") != F.trim("after_source"))


def baseline_label(code: Column) -> Column:
    """Two or more of a class's patterns give its label, classes in order; else safe. A line end stops a dot."""
    out = F.lit(R.SAFE)
    for label, patterns in reversed(R.BASELINE):
        hits = sum((R.has(code, p).cast("int") for p in patterns), F.lit(0))
        out = F.when(hits >= 2, label).otherwise(out)
    return out


def parsed_answer(text: Column) -> Column:
    """The first of four names that an answer holds, whatever its case; safe if none."""
    up = F.upper(text)
    return F.when(F.contains(up, F.lit("LOCK_CONTENTION")), 0).when(F.contains(up, F.lit("MEMORY_LEAK")), 1).when(F.contains(up, F.lit("RESOURCE_LEAK")), 2).otherwise(R.SAFE)
