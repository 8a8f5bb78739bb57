"""Validation of candidates by statistics over measured series.

Series are long relations (entry, variant, ordinal, value); variant is 'buggy' or 'fixed'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats

THREADS = 32
BORDER = (0.03, 0.07)


def regression(series: DataFrame) -> DataFrame:
    """entry, variant, n, slope, r2 and the slope's two-sided p."""
    x, y = F.col("ordinal").cast("double"), F.col("value")
    g = series.groupBy("entry", "variant").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    return g.withColumn("p", stats.t_two_sided(F.col("r2"), F.col("n")))


def monotone(series: DataFrame) -> DataFrame:
    """entry, variant, n, rising (share of steps at or above 95 % of the value before), monotone, first, last."""
    w = W.partitionBy("entry", "variant").orderBy("ordinal")
    d = series.withColumn("prev", F.lag("value").over(w))
    step = F.when(F.col("prev").isNotNull(), (F.col("value") >= F.col("prev") * 0.95).cast("int"))
    g = d.groupBy("entry", "variant").agg(F.count("*").alias("n"), F.avg(step).alias("rising"), F.regr_slope(F.col("value"), F.col("ordinal").cast("double")).alias("slope"), F.min_by("value", "ordinal").alias("first"), F.max_by("value", "ordinal").alias("last"))
    return g.withColumn("monotone", (F.col("n") >= 4) & (F.col("slope") > 0) & (F.col("rising") >= 0.65))


def _sides(d: DataFrame, *columns: str) -> DataFrame:
    """One row for each entry with the columns of both variants."""
    picks = [F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}") for v in ("buggy", "fixed") for c in columns]
    return d.groupBy("entry").agg(*picks)


def leak_verdict(series: DataFrame) -> DataFrame:
    """Memory: passed if the buggy series rises steadily and the fixed one does not; borderline if it grew by 0 to 5 %."""
    d = _sides(monotone(series), "monotone", "first", "last", "n")
    growth = (F.col("buggy_last") - F.col("buggy_first")) / F.greatest("buggy_first", F.lit(1.0)) * 100
    passed = F.coalesce(F.col("buggy_monotone"), F.lit(False)) & ~F.coalesce(F.col("fixed_monotone"), F.lit(False))
    return d.select("entry", F.coalesce("buggy_monotone", F.lit(False)).alias("buggy_monotone"), F.coalesce("fixed_monotone", F.lit(False)).alias("fixed_monotone"), F.round(growth, 4).alias("growth_pct"), passed.alias("passed"), (~passed & (growth > 0) & (growth < 5)).alias("is_borderline"))


def growth(series: DataFrame) -> DataFrame:
    """entry, variant, grows: three points or more, rising, p below 0.05."""
    d = regression(series)
    return d.select("entry", "variant", ((F.col("n") >= 3) & (F.col("slope") > 0) & (F.coalesce("p", F.lit(1.0)) < stats.ALPHA)).alias("grows"))


def resource_verdict(series: DataFrame, findings: DataFrame) -> DataFrame:
    """Resources: passed if a static finding (entry, confirmed) and the buggy side grows and the fixed does not."""
    d = _sides(growth(series), "grows").join(findings, "entry", "left")
    st, b, f = F.coalesce("confirmed", F.lit(False)), F.coalesce("buggy_grows", F.lit(False)), F.coalesce("fixed_grows", F.lit(False))
    passed = st & b & ~f
    return d.select("entry", st.alias("static_confirmed"), b.alias("buggy_grows"), f.alias("fixed_grows"), passed.alias("passed"), (~passed & (st | b)).alias("is_borderline"))


def paired(bench: DataFrame) -> DataFrame:
    """entry, threads, ordinal, x (buggy), y (fixed): the first n of both variants, n the shorter length."""
    keys = ["entry", "threads", "ordinal"]
    side = [F.collect_list(F.when(F.col("variant") == v, F.struct("value"))).alias(v) for v in ("buggy", "fixed")]
    both = bench.dropna(subset=keys).groupBy(*keys).agg(*side)  # the series is made once for both sides
    both = both.select(*keys, F.explode("buggy").alias("b"), "fixed").select(*keys, "b", F.explode("fixed").alias("f"))
    return both.select(*keys, F.col("b.value").alias("x"), F.col("f.value").alias("y"))


def speed_up(bench: DataFrame) -> DataFrame:
    g = bench.groupBy("entry", "threads").agg(*[F.avg(F.when(F.col("variant") == v, F.col("value"))).alias(f"{v}_mean") for v in ("buggy", "fixed")])
    return g.withColumn("speedup", F.col("fixed_mean") / F.greatest("buggy_mean", F.lit(1e-9)))


def contention_verdict(bench: DataFrame) -> DataFrame:
    """Locks: the fixed side must be greater by a signed-rank test at 32 threads or more; borderline for a p from 0.05
    (what lies below passes) to 0.07."""
    tests = stats.signed_rank(paired(bench), ["entry", "threads"], "y", "x").filter(F.col("threads") >= THREADS)
    hit, near = F.col("p") < stats.ALPHA, F.col("p").between(*BORDER)
    g = tests.groupBy("entry").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("passed"), F.coalesce(F.bool_or(near), F.lit(False)).alias("near"), F.min("p").alias("least_p"))
    out = bench.select("entry").distinct().join(g, "entry", "left")
    passed = F.coalesce("passed", F.lit(False))
    return out.select("entry", passed.alias("passed"), (~passed & F.coalesce("near", F.lit(False))).alias("is_borderline"), F.round("least_p", 6).alias("least_p"))


def disposition(verdicts: DataFrame) -> DataFrame:
    """validated, borderline or rejected; a reason (an entry that failed) rejects."""
    kind = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("passed"), "validated").when(F.col("is_borderline"), "borderline").otherwise("rejected")
    return verdicts.withColumn("disposition", kind)


def rejection(dispositions: DataFrame) -> DataFrame:
    """One row: totals and the Wilson interval of the rejection rate in per cent to one decimal."""
    n, r = F.count("*"), F.count_if(F.col("disposition") == "rejected")
    d = dispositions.agg(n.alias("n_total"), r.alias("n_rejected"), *[F.count_if(F.col("disposition") == k).alias(f"n_{k}") for k in ("validated", "borderline")])
    lo, hi = stats.wilson(F.col("n_rejected").cast("double"), F.col("n_total").cast("double"))
    return d.select("*", F.round(100.0 * F.col("n_rejected") / F.nullif(F.col("n_total"), F.lit(0)), 1).alias("rate_pct"), F.round(100 * lo, 1).alias("lo_pct"), F.round(100 * hi, 1).alias("hi_pct"))
