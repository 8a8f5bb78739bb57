"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight (5, 2, 1 repeating in code-point order, null last) and shares the whole size; a target stops
at ``max_repeat`` times its source's size and the excess is reshared by weight. Inside a source the documents
stand in the order of a hash of their id, one pass after another, and a pass of a document is taken if the
middle of its words lies below the target. Each source has a schedule, a piecewise linear rate over training
time in [0, 1]; its integral is the cumulative demand, and inverting that at a document's first word gives the
document's position, by which the rows are range-sorted.

Scale: two aggregates that combine before the shuffle, and one exchange by (source, slice of the hash), so a
hot source is spread over thousands of groups. Prefix sums run inside a slice; the sums of slices are a table
of sources x slices.

Null text: size 0. Null doc_id: the hash of the empty text. Repeated rows: each is a document of its own.
Size 0: never changes a sum; taken is 0. Empty table: no rows. Columns beyond those named are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import of_columns, save, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Rates at times 0 and 1 (knots) for each class of weight; a schedule is scaled to an integral of 1.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def integrate(knots) -> list[tuple[float, float, float, float]]:
    """(time, share so far, rate, slope of the rate) at the start of each segment; the last share would be 1."""
    area = sum((t2 - t1) * (r1 + r2) / 2 for (t1, r1), (t2, r2) in zip(knots, knots[1:]))
    out, so_far = [], 0.0
    for (t1, r1), (t2, r2) in zip(knots, knots[1:]):
        out.append((t1, so_far, r1 / area, (r2 - r1) / area / (t2 - t1)))
        so_far += (t2 - t1) * (r1 + r2) / 2 / area
    return out


def invert(share: Column, knots) -> Column:
    """The time at which the schedule has given ``share`` of its demand."""
    out = None
    for time, so_far, rate, slope in integrate(knots):
        left = F.greatest(share - F.lit(so_far), F.lit(0.0))
        x = F.lit(time) + 2.0 * left / (F.lit(rate) + F.sqrt(F.greatest(F.lit(rate * rate) + 2.0 * slope * left, F.lit(0.0))))
        out = x if out is None else F.when(share >= F.lit(so_far), x).otherwise(out)
    return F.least(out, F.lit(1.0))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, klass, target. A row for each source: the windows run over that table in one task, which holds
    millions of sources; documents don't come there."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("klass", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("klass") + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("k", F.row_number().over(by))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    every = W.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    s = s.withColumn("first", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("k"))).over(every))
    s = s.withColumn("level", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(every))
    target = F.when(F.col("k") < F.col("first"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("level")))
    return s.select("source", "source_size", F.col("klass").cast("int").alias("klass"), target.alias("target"))


def mix_sources(docs: DataFrame, carry: tuple[str, ...] = (), weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, passes, taken, start (words of its
    source before it, in a pass), klass, and the columns of ``carry``."""
    order = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    flat = of_columns(docs, *dict.fromkeys(["doc_id", "source", "text", *carry]))
    full = flat.select("doc_id", "source", size_of().alias("size"), order.alias("h"), *[c for c in carry if c not in ("doc_id", "source")])
    sized = full.select("doc_id", "source", "size", "h")
    if not carry:
        full = sized = save(sized, "sizes")
    part = F.substring("h", 1, 3)
    slices = save(sized.groupBy("source", part.alias("slice")).agg(F.sum("size").alias("size")), "slices")
    sums = slices.withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(slices, weights, max_repeat).withColumnRenamed("source", "s_")
    known = sums.join(targets, F.col("source").eqNullSafe(F.col("s_"))).select(F.col("source").alias("s_"), F.col("slice").alias("p_"), "before", "source_size", "klass", "target")
    joined = full.withColumn("slice", part).join(known, F.col("source").eqNullSafe(F.col("s_")) & (F.col("slice") == F.col("p_")))
    inside = W.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = sum((F.when((F.lit(k) * F.col("source_size") + F.col("start")) + F.col("size") / 2 <= F.col("target"), 1).otherwise(0) for k in range(max_repeat)), F.lit(0))
    joined = joined.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0).cast("int"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"), "start", "klass", *[c for c in carry if c not in ("doc_id", "source")])


def position(nth: Column, schedules=SCHEDULES) -> Column:
    """The training position of the ``nth`` pass (from 0) of a row of ``mix_sources``."""
    share = (nth * F.col("source_size") + F.col("start")) / F.when(F.col("target") > 0, F.col("target"))
    return F.coalesce(*[F.when(F.col("klass") == i, invert(share, k)) for i, k in enumerate(schedules)])


def training_order(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The mixed documents: a row for each pass that is taken, range-sorted by position."""
    mixed = mix_sources(docs, carry=columns).filter(F.col("passes") > 0)
    rows = mixed.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    return rows.withColumn("position", position(F.col("nth"))).orderBy("position", "doc_id", "nth").select(*columns)


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, position (first pass, null if none), in that order."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    out = out.withColumn("position", F.when(F.col("passes") > 0, F.round(position(F.lit(0)), 9)))
    return out.select("doc_id", "size", "source_size", "target", "taken", "passes", "position").orderBy("position", "doc_id")


def _invert_sql(share: str, knots) -> str:
    parts = [(so_far, f"{time!r} + 2.0 * greatest({share} - {so_far!r}, 0.0) / ({rate!r} + sqrt(greatest({rate * rate!r} + {2.0 * slope!r} * greatest({share} - {so_far!r}, 0.0), 0.0)))") for time, so_far, rate, slope in integrate(knots)]
    return "least(CASE " + " ".join(f"WHEN {share} >= {a!r} THEN {x}" for a, x in reversed(parts[1:])) + f" ELSE {parts[0][1]} END, 1.0)" if parts[1:] else f"least({parts[0][1]}, 1.0)"


ORACLE_OP10 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         sha256(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS klass FROM sized GROUP BY source),
c AS (SELECT *, CASE klass WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS k,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
  sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  (sum(source_size) OVER ())::BIGINT AS total FROM c),
l AS (SELECT *, (total - before) / rest AS level FROM o),
f AS (SELECT min(k) AS first FROM l WHERE level <= cap / w),
t AS (SELECT source, source_size, klass, CASE WHEN k < f.first THEN cap ELSE least(cap, w * (SELECT level FROM l AS y WHERE y.k = f.first)) END AS target FROM l, f),
d AS (SELECT doc_id, size, h, t.*, (sum(size) OVER (PARTITION BY sized.source ORDER BY h, doc_id, size) - size)::BIGINT AS start
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN size > 0 THEN (CASE WHEN start + size / 2 <= target THEN 1 ELSE 0 END) + (CASE WHEN source_size + start + size / 2 <= target THEN 1 ELSE 0 END)
  + (CASE WHEN 2 * source_size + start + size / 2 <= target THEN 1 ELSE 0 END) ELSE 0 END AS passes, start::DOUBLE / nullif(target, 0) AS share FROM d)
SELECT doc_id, size, source_size, target, (size * passes)::BIGINT AS taken, passes::INTEGER AS passes,
  CASE WHEN passes > 0 THEN round(CASE klass WHEN 0 THEN {_invert_sql("share", SCHEDULES[0])} WHEN 1 THEN {_invert_sql("share", SCHEDULES[1])} ELSE {_invert_sql("share", SCHEDULES[2])} END, 9) END AS position
FROM p
"""
