"""The jobs as registered queries: run twice over whole tables into one new folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import commit_mining, series_validation
from millrace.plans import catalog, corpus
from millrace.sources.readers import scratch


def over(text: str, *tables: str) -> str:
    """One of the corpus' texts as a select of a job: its table becomes the input."""
    text = text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {input}")
    return text


PULLS = "SELECT 'c' || CAST(o_orderkey * 3 AS STRING) AS commit_hash, o_orderkey AS pr_number, 'https://example.org/pull/' || CAST(o_orderkey AS STRING) AS pr_url, 'Change ' || o_orderpriority AS pr_title, o_orderstatus = 'F' AS merged FROM {input}"


def job1_commit_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates among the messages of documents, with the totals of their repository."""
    at = scratch(spark, "job1")
    settings = {"select": f"SELECT repo, commit_hash, subject, body FROM ({over(corpus.MSG, 'documents')}) AS m", "pull_requests": PULLS}
    for _ in range(2):
        # a pattern: a stream's path has to be a folder or a pattern, and the table may be one file
        commit_mining.run(spark, f"{sf_dir}/documents.parque[t]", f"{at}/out", f"{at}/checkpoint", f"{sf_dir}/orders.parquet", settings)
    repos = spark.read.schema("repo string, total long, multi long").parquet(f"{at}/out/repos").select(F.col("repo").alias("r_"), F.col("total").alias("repo_total"), F.col("multi").alias("repo_multi"))
    found = commit_mining.written(spark, f"{at}/out")
    found = found.join(repos, F.col("repo") == F.col("r_")).drop("r_", "batch")
    return found.withColumns({c: F.array_join(c, "|") for c in ("issue_ids", "categories", "parents")})


ORACLE_JOB1 = (
    catalog.KW.replace(", v_diff AS (" + corpus.VIEWS["v_diff"] + ")", "")
    + f""", cand AS (SELECT commit_hash, list_sort(list_distinct(list(category))) AS categories, list_sort(list_distinct(list(string_split(category, '.')[1]))) AS parents FROM kw GROUP BY commit_hash),
x AS (SELECT coalesce(repo, '') AS repo, commit_hash, {catalog.STAGE1} AS category, {catalog.IDS} AS ids, categories, parents, {catalog.CLS} AS classes, pr_number, pr_url, pr_title
  FROM cand JOIN v_msg USING (commit_hash) LEFT JOIN ({catalog.PRS}) p USING (commit_hash) WHERE NOT {catalog.REJECTED})
SELECT repo, commit_hash, category, array_to_string(ids, '|') AS issue_ids, array_to_string(categories, '|') AS categories, array_to_string(parents, '|') AS parents, len(parents) >= 2 AS is_multi_fault,
  len(categories)::INT AS fault_count, len(categories)::INT AS signal_count, 'low' AS confidence, pr_number::VARCHAR AS pr_number,
  CASE WHEN pr_number IS NOT NULL THEN 'PR #' || pr_number::VARCHAR || ' · ' || substr(pr_title, 1, 80) || ' | PR: ' || pr_url || ' | ' ELSE '' END || 'Commit: https://github.com/' || repo || '/commit/' || commit_hash AS pr_details,
  CASE WHEN classes = '' THEN 'other' ELSE classes END AS fault_class, count(*) OVER (PARTITION BY repo)::BIGINT AS repo_total, (count_if(len(parents) >= 2) OVER (PARTITION BY repo))::BIGINT AS repo_multi
FROM x"""
)


def job2_series_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over benchmarks of parts and series of users, with the rates of their class."""
    at = scratch(spark, "job2")
    series = over(corpus.SERIES, "events")
    settings = {"benchmarks": over(corpus.BENCH, "lineitem"), "memory": series, "descriptors": series, "findings": "SELECT DISTINCT user_id AS entry, user_id % 2 = 0 AS confirmed FROM {input}"}
    events = f"{sf_dir}/events.parquet"
    for _ in range(2):
        series_validation.run(spark, at, settings, benchmarks=f"{sf_dir}/lineitem.parquet", memory=events, descriptors=events, findings=events)
    return series_validation.written(spark, at)


_P = "(n_rejected::DOUBLE / nullif(n_total, 0))"
_WIDE = f"1.96 * sqrt({_P} * (1 - {_P}) / n_total + 1.96 * 1.96 / (4.0 * n_total * n_total)) / (1 + 1.96 * 1.96 / n_total)"
_MID = f"({_P} + 1.96 * 1.96 / (2 * n_total)) / (1 + 1.96 * 1.96 / n_total)"
ORACLE_JOB2 = (
    catalog.LC
    + catalog.LEAK.replace(catalog._with("v_series").rstrip(), ", v_series AS (" + corpus.SERIES + ")")
    + catalog.REG.removeprefix(catalog._with("v_series"))
    + """, rl AS (SELECT entry, entry % 2 = 0 AS st, coalesce(bool_or(CASE WHEN variant = 'buggy' THEN n >= 3 AND slope > 0 AND coalesce(p, 1) < 0.05 END), false) AS b, coalesce(bool_or(CASE WHEN variant = 'fixed' THEN n >= 3 AND slope > 0 AND coalesce(p, 1) < 0.05 END), false) AS f FROM rg GROUP BY entry),
sides AS (SELECT 'lock_contention' AS fault_category, entry, count(DISTINCT variant) AS sides FROM v_bench GROUP BY entry
  UNION ALL SELECT unnest(['memory_leak', 'resource_leak']), entry, sides FROM (SELECT entry, count(DISTINCT variant) AS sides FROM v_series GROUP BY entry)),
found AS (SELECT 'lock_contention' AS fault_category, entry, passed, is_borderline, least_p AS measure FROM lv
  UNION ALL SELECT 'memory_leak', entry, passed, coalesce(is_borderline, false), growth_pct FROM lk
  UNION ALL SELECT 'resource_leak', entry, st AND b AND NOT f, NOT (st AND b AND NOT f) AND (st OR b), NULL FROM rl),
told AS (SELECT fault_category, entry, passed, is_borderline, measure, CASE WHEN sides < 2 THEN 'one side was not measured' END AS reason,
  CASE WHEN sides < 2 THEN 'rejected' WHEN passed THEN 'validated' WHEN is_borderline THEN 'borderline' ELSE 'rejected' END AS disposition FROM found JOIN sides USING (fault_category, entry)),
rates AS (SELECT fault_category, count(*)::BIGINT AS n_total, count_if(disposition = 'rejected')::BIGINT AS n_rejected, count_if(disposition = 'validated')::BIGINT AS n_validated, count_if(disposition = 'borderline')::BIGINT AS n_borderline FROM told GROUP BY fault_category)"""
    + f" SELECT told.*, n_total, n_rejected, n_validated, n_borderline, round(100.0::DOUBLE * n_rejected / nullif(n_total, 0), 1) AS rate_pct, round(100 * ({_MID} - {_WIDE}), 1) AS lo_pct, round(100 * ({_MID} + {_WIDE}), 1) AS hi_pct FROM told JOIN rates USING (fault_category)"
)

QUERIES = {"job1_commit_mining": job1_commit_mining, "job2_series_validation": job2_series_validation}
ORACLES = {"job1_commit_mining": ORACLE_JOB1, "job2_series_validation": ORACLE_JOB2}
