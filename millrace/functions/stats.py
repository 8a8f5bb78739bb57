"""Statistics as columns: tail probabilities of t, rank tests, agreement, intervals, areas under curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHA = 0.05
#: Rank sums of at most so many differences without ties are tested exactly.
EXACT = 25


def t_two_sided(r2: Column, n: Column) -> Column:
    """The two-sided p of a slope from r squared of n points: the finite series for integer degrees of freedom
    (Abramowitz and Stegun 26.7.3, 26.7.4)."""
    df = n - 2
    t = F.sqrt(r2 * df / F.nullif(1 - r2, F.lit(0.0)))
    theta = F.atan(t / F.sqrt(F.greatest(df, F.lit(1)).cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def series(first: Column, last: Column) -> Column:
        steps = F.when(last >= first, F.sequence(first, last, F.lit(2))).otherwise(F.array().cast("array<int>"))

        def step(a: Column, k: Column) -> Column:
            term = a["term"] * cos2 * (k - 1) / k
            return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

        return F.aggregate(steps, start, step)["sum"]

    d = df.cast("int")
    odd = 2 / F.pi() * (theta + F.when(d > 1, F.sin(theta) * F.cos(theta) * series(F.lit(3), d - 2)).otherwise(0.0))
    even = F.sin(theta) * series(F.lit(2), d - 2)
    p = 1 - F.when(d % 2 == 1, odd).otherwise(even)
    return F.when(d < 1, F.lit(None)).when(r2 >= 1, 0.0).otherwise(F.greatest(p, F.lit(0.0)))


def signed_rank(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, n (pairs), w (rank sum of positive x - y), p: one-sided Wilcoxon test that x is greater. Zero differences are
    dropped and ties share ranks; p is exact for at most EXACT differences without ties or zeros, else normal.
    Fewer than two pairs: p null. No difference but zeros: p 1."""
    d = pairs.withColumn("d", F.col(x) - F.col(y)).withColumn("size", F.abs("d"))
    # one shuffle and one order: zeros and unknown differences come first, so that they are taken off the ranks of the others afterwards
    ranked = d.withColumn("same", F.count("*").over(W.partitionBy(*keys, "size"))).withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy("size")) + (F.col("same") - 1) / 2)
    live, above, tie = F.col("d") != 0, F.col("d") > 0, F.col("same") * F.col("same") - 1
    g = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("zeros"), F.count_if(live).cast("int").alias("m"), F.count_if(above).alias("up"), F.sum(F.when(above, F.col("rank")).otherwise(0.0)).alias("ranks"), F.max(F.when(live, F.col("same"))).alias("tied"), F.sum(F.when(live, tie)).cast("double").alias("ties"))
    m = F.col("m")
    g = g.withColumn("w", F.col("ranks") - (F.col("n") - m) * F.col("up"))
    full = m * (m + 1) / 2
    start = F.transform(F.sequence(F.lit(0), full.cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    # counts of subsets of 1..m by their sum
    ways = F.aggregate(F.sequence(F.lit(1), m), start, lambda a, k: F.transform(a, lambda v, i: v + F.when(i >= k, F.get(a, i - k)).otherwise(0.0)))
    exact = F.aggregate(F.slice(ways, F.col("w").cast("int") + 1, F.size(ways)), F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), m)
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    z = F.when(sd > 0, (F.col("w") - full / 2) / sd).otherwise(0.0)
    p = F.when((m <= EXACT) & (F.col("tied") == 1) & (F.col("zeros") == 0), exact).otherwise(normal_above(z))
    return g.select(*keys, "n", "w", F.when(F.col("n") >= 2, F.when(m > 0, p).otherwise(1.0)).alias("p"))


def normal_above(z: Column) -> Column:
    """P(Z > z), absolute error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and Cohen's kappa of two columns where both are set."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    x = both.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("na"))
    y = both.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("nb"))
    seen = both.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    chance = x.join(y, "c").agg(F.sum(F.col("na") * F.col("nb")).alias("crossed"))
    po = F.col("same") / F.col("total")
    pe = F.coalesce("crossed", F.lit(0)) / (F.col("total").cast("double") * F.col("total"))
    return seen.join(chance).select(F.col("total").alias("n"), F.round((po - pe) / F.greatest(1 - pe, F.lit(1e-9)), 6).alias("kappa"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The bounds of the Wilson interval; null for n = 0."""
    n = F.nullif(n, F.lit(0))
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return F.when(mid.isNotNull(), F.greatest(mid - half, F.lit(0.0))), F.when(mid.isNotNull(), F.least(mid + half, F.lit(1.0)))


def macro_auc(scores: DataFrame, label: str = "label") -> DataFrame:
    """One row: the mean over classes of the one-vs-rest area under the curve; (class, score) in a long table, one row for
    each example and class. Classes without positives or negatives are left out."""
    pos = F.col(label) == F.col("klass")
    same = W.partitionBy("klass", "score")
    up = W.partitionBy("klass").orderBy("score")
    r = scores.withColumn("rank", F.rank().over(up) + (F.count("*").over(same) - 1) / 2)
    g = r.groupBy("klass").agg(F.sum(F.when(pos, F.col("rank"))).alias("s"), F.count_if(pos).alias("np"), F.count_if(~pos).alias("nn")).filter("np > 0 AND nn > 0")
    auc = (F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))
    return g.agg(F.round(F.avg(auc), 6).alias("macro_auc"), F.count("*").alias("classes"))
