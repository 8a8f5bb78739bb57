"""Mines commit messages as they arrive: each run takes the files that are new since the last one.

A file stream hands over the new files in batches and its checkpoint remembers them. A batch becomes candidates: commits that
name a fault and are not ruled out, with class, issues, signals and pull request. It is written to a folder of its own, ``commits/batch=N``,
so that a batch that is run again after a failure replaces what it left. A commit that came before, in this batch or an
earlier one, is taken once. ``repos`` holds the totals of each repository over all batches and is written anew by each run that took something.

    python jobs/commit_mining.py --input IN --output OUT --checkpoint CP [--pull-requests PR] --config jobs/commit_mining.json

IN is a folder of Parquet files to which files are added, or a pattern of paths.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, shaped, start
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.operators import mining

KEY = ("repo", "commit_hash")
COLUMNS = "repo string, commit_hash string, category string, issue_ids array<string>, categories array<string>, parents array<string>, is_multi_fault boolean, fault_count int, signal_count int, confidence string, pr_number string, pr_details string"
OUTPUT = f"{COLUMNS}, batch long, fault_class string"
#: What the select has to give; null texts are empty.
INPUT = ("repo", "commit_hash", "subject", "body")
SETTINGS = {"select": "SELECT * FROM {input}", "pull_requests": "SELECT * FROM {input}", "max_files": 1000, "fault_filter": "all", "merged_only": False}


def triage(commits: DataFrame, prs: DataFrame | None = None, fault_filter: str = "all", merged_only: bool = False, keywords=R.KEYWORDS) -> DataFrame:
    """Candidates of commits (repo, commit_hash, subject, body), one row each, with ``fault_class``, their classes joined. Each message is
    scanned once; what is shuffled has no texts. Of repeated commits the least row counts; a null in the key counts as empty."""
    commits = commits.select(*[F.coalesce(c, F.lit("")).alias(c) for c in KEY], "subject", mining.message().alias("text"))
    text = F.col("text")
    light = commits.select(*KEY, mining.stage1_category(text).alias("category"), mining.rejected(text).alias("rejected"), T.issue_ids(F.coalesce("subject", F.lit(""))).alias("issue_ids"), mining.keyword_hits(text, keywords).alias("hits"))
    about = [c for c in light.columns if c not in KEY]
    light = light.groupBy(*KEY).agg(F.min(F.struct(*about)).alias("x")).select(*KEY, "x.*").filter("NOT rejected AND size(hits) > 0")
    signals = light.select(*KEY, F.inline("hits")).select(*KEY, "category", F.lit("keyword").alias("source"), F.lit(1).alias("layer"))
    found = mining.class_filter(mining.candidates(mining.strongest(signals, KEY), KEY), fault_filter)
    found = found.join(light.select(*KEY, "category", "issue_ids"), list(KEY))
    if prs is None:
        found = found.withColumns({"pr_number": F.lit(None).cast("string"), "pr_url": F.lit(""), "pr_title": F.lit("")})
    else:
        by = KEY if "repo" in prs.columns else "commit_hash"
        if merged_only:
            found = mining.merged_only(found, prs, key=by)
        found = mining.with_pull_request(found, prs.drop("merged", "pr_body"), by)
    details = mining.traceability(F.col("repo"), F.col("commit_hash"))
    found = found.select("*", details.alias("pr_details"), F.coalesce(F.nullif(F.array_join(mining.classes(), "+"), F.lit("")), F.lit("other")).alias("fault_class"))
    return found.withColumn("pr_number", F.col("pr_number").cast("string")).select(*[c.split()[0] for c in COLUMNS.split(", ")], "fault_class")


def written(spark: SparkSession, output: str) -> DataFrame:
    """All candidates that the job has written; none before its first batch."""
    try:
        return spark.read.schema(OUTPUT).parquet(f"{output}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OUTPUT)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, pull_requests: str | None = None, settings: dict | None = None) -> dict[str, int]:
    """Takes what is new at ``source`` and returns how many batches and rows it read and how many candidates it wrote."""
    how = SETTINGS | (settings or {})
    done = {"batches": 0, "read": 0, "written": 0}

    def take(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        prs = shaped(here, here.read.parquet(pull_requests), how["pull_requests"]) if pull_requests else None
        found = triage(shaped(here, batch, how["select"]).select(*INPUT), prs, how["fault_filter"], how["merged_only"])
        if number:
            before = written(here, output).filter(F.col("batch") < number).select(*KEY).distinct()
            found = found.join(before, list(KEY), "left_anti")
        at = f"{output}/commits/batch={number}"
        found.write.mode("overwrite").partitionBy("fault_class").parquet(at)
        n, kept = batch.count(), here.read.schema(f"{COLUMNS}, fault_class string").parquet(at).count()
        log.info("batch %d: read %d rows of %s, wrote %d candidates to %s", number, n, source, kept, at)
        done.update(batches=done["batches"] + 1, read=done["read"] + n, written=done["written"] + kept)

    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", how["max_files"]).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if done["batches"]:
        totals = mining.repo_summary(written(spark, output))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{output}/repos")
        log.info("wrote the totals of %d repositories to %s/repos", spark.read.parquet(f"{output}/repos").count(), output)
    else:
        log.info("nothing new at %s", source)
    return done


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output", "checkpoint", "config"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--pull-requests")
    a = p.parse_args(args)
    spark = start("commit mining")
    try:
        run(spark, a.input, a.output, a.checkpoint, a.pull_requests, config(spark, a.config, **SETTINGS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
