"""Validates candidate fixes by what was measured before and after them, and keeps the verdicts of each fault class up to date.

Locks are judged by benchmarks at several thread counts, memory by heap samples, resources by counts of open descriptors and static findings.
Verdicts go to ``verdicts/fault_category=C``, partitioned by disposition, and the rejection rate of each class with its
Wilson interval to ``rates/fault_category=C``. A run replaces the folders of the classes that it is asked for and leaves the others alone, so
that a run over the same input gives the same output. An entry of which one side was not measured is rejected, with the reason.

    python jobs/series_validation.py --output OUT --config jobs/series_validation.json [--benchmarks B] [--memory M] [--descriptors D] [--findings F]

The inputs are Parquet folders; the config's selects give them their columns. Rows without an entry, a variant or a value are counted and left out.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, shaped, start
from millrace.operators import validation

KINDS = {"lock_contention": "benchmarks", "memory_leak": "memory", "resource_leak": "descriptors"}
SETTINGS = {k: "SELECT * FROM {input}" for k in ("benchmarks", "memory", "descriptors", "findings")} | {"kinds": list(KINDS)}
VERDICT = "entry long, passed boolean, is_borderline boolean, measure double, reason string"
RATE = "n_total long, n_rejected long, n_validated long, n_borderline long, rate_pct double, lo_pct double, hi_pct double"


def measured(rows: DataFrame, name: str) -> DataFrame:
    good = F.col("entry").isNotNull() & F.col("variant").isin("buggy", "fixed") & F.col("value").isNotNull()
    n, kept = rows.agg(F.count("*"), F.count_if(good)).first()
    log.info("read %d rows of %s, left out %d", n, name, n - kept)
    return rows.filter(good)


def verdicts(kind: str, series: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """entry, passed, is_borderline, measure (least p, growth in per cent, or none), reason, disposition."""
    if kind == "lock_contention":
        v = validation.contention_verdict(series).withColumn("measure", F.col("least_p"))
    elif kind == "memory_leak":
        v = validation.leak_verdict(series).withColumn("measure", F.col("growth_pct"))
    else:
        if findings is None:
            findings = series.select("entry", F.lit(False).alias("confirmed")).limit(0)
        known = findings.groupBy("entry").agg(F.bool_or("confirmed").alias("confirmed"))
        v = validation.resource_verdict(series, known).withColumn("measure", F.lit(None).cast("double"))
    sides = series.groupBy("entry").agg(F.size(F.collect_set("variant")).alias("sides"))
    v = v.join(sides, "entry").withColumn("reason", F.when(F.col("sides") < 2, "one side was not measured"))
    v = v.withColumn("is_borderline", F.coalesce("is_borderline", F.lit(False)))
    return validation.disposition(v).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in VERDICT.split(", ")], "disposition")


def run(spark: SparkSession, output: str, settings: dict | None = None, **inputs: str | None) -> dict[str, int]:
    """Judges the classes of ``kinds`` whose input is given (benchmarks, memory, descriptors, findings: paths) and returns the verdicts of each."""
    how = SETTINGS | (settings or {})
    if unknown := set(how["kinds"]) - set(KINDS):
        raise ValueError(f"unknown classes {sorted(unknown)}; known are {sorted(KINDS)}")
    done = {}
    for kind in how["kinds"]:
        name = KINDS[kind]
        if not inputs.get(name):
            log.info("no %s: %s is left as it is", name, kind)
            continue
        series = measured(shaped(spark, spark.read.parquet(inputs[name]), how[name]), inputs[name])
        findings = shaped(spark, spark.read.parquet(inputs["findings"]), how["findings"]) if kind == "resource_leak" and inputs.get("findings") else None
        at = f"{output}/verdicts/fault_category={kind}"
        verdicts(kind, series, findings).write.mode("overwrite").partitionBy("disposition").parquet(at)
        found = spark.read.schema(f"{VERDICT}, disposition string").parquet(at)
        validation.rejection(found).write.mode("overwrite").parquet(f"{output}/rates/fault_category={kind}")
        done[kind] = found.count()
        log.info("wrote %d verdicts to %s", done[kind], at)
    return done


def written(spark: SparkSession, output: str) -> DataFrame:
    """All verdicts with the rates of their class."""
    found = spark.read.schema(f"{VERDICT}, fault_category string, disposition string").parquet(f"{output}/verdicts")
    return found.join(spark.read.schema(f"{RATE}, fault_category string").parquet(f"{output}/rates"), "fault_category")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--output", required=True)
    p.add_argument("--config", required=True)
    for name in ("benchmarks", "memory", "descriptors", "findings"):
        p.add_argument(f"--{name}")
    a = p.parse_args(args)
    spark = start("series validation")
    try:
        run(spark, a.output, config(spark, a.config, **SETTINGS), benchmarks=a.benchmarks, memory=a.memory, descriptors=a.descriptors, findings=a.findings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
