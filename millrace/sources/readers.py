"""Readers of the engine's inputs, with explicit schemas, and writers of its outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = ("commit_hash", "author", "date", "message", "parents")
PAIR = "pair_id string, repo string, commit_hash string, file_path string, method_name string, class_name string, before_source string, after_source string, before_line_start int, before_line_end int, after_line_start int, after_line_end int, structural_changes array<string>, detected_fault_categories array<string>, multi_fault_signals array<string>, pr_number string, pr_url string, commit_url string, pr_title string"
CANDIDATE = "repo string, commit_hash string, parent_hash string, message string, author string, date string, changed_java_files array<string>, all_categories array<string>, all_parents array<string>, is_multi_fault boolean, confidence string, github_labels array<string>, issue_ids array<string>, pr_number string, pr_url string, commit_url string, pr_title string"
SUB = "struct<label:string,description:string,commit_keywords:array<string>,structural_patterns_before:array<string>,structural_patterns_after:array<string>,sub_patterns:map<string,struct<patterns_before:array<string>,patterns_after:array<string>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task whose work is by row, however few bytes they have.
SPREAD_ROWS = 10_000


def spread(d: DataFrame) -> DataFrame:
    """``d`` dealt out by the number of its rows, which files of few bytes don't do: as many parts as threads, more where a part would have over
    ``SPREAD_ROWS`` rows. Few rows stay as they are."""
    n = d.count()
    if n <= SPREAD_ROWS // 10:
        return d
    return d.repartition(max(d.sparkSession.sparkContext.defaultParallelism, -(-n // SPREAD_ROWS)))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset on one machine, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/millrace/{tag}-{uuid.uuid4().hex}"


def commit_log(spark: SparkSession, path: str, separator: str = "|||") -> DataFrame:
    """An exported log, one commit a line; lines of fewer than five fields are dropped, the first parent is kept."""
    parts = F.split("value", "[" + separator[0] + "]{" + str(len(separator)) + "}", -1)
    d = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= len(COMMIT))
    return d.select(*[F.get("p", i).alias(c) for i, c in enumerate(COMMIT)]).withColumn("parent", F.substring_index("parents", " ", 1)).drop("parents")


def commit_records(spark: SparkSession, path: str, end: str = "<<<END>>>", separator: str = "\x1f") -> DataFrame:
    """hash, subject, body of records closed by an end marker; a body may hold line ends."""
    p = F.split("value", separator, 3)
    part = lambda i: F.regexp_replace(F.coalesce(F.get("p", i), F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    return spark.read.option("lineSep", end).text(path).select(p.alias("p")).filter(F.size("p") >= 2).select(part(0).alias("commit_hash"), part(1).alias("subject"), part(2).alias("body"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """category, kind, side, ordinal, pattern: the two-level taxonomy as rows."""
    schema = f"taxonomy map<string,struct<label:string,subcategories:map<string,{SUB}>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("taxonomy").alias("parent", "v"))
    d = d.select("parent", F.explode("v.subcategories").alias("sub", "s")).select(F.concat_ws(".", "parent", "sub").alias("category"), "s")
    empty = F.array().cast("array<string>")

    def part(kind: str, side: str, c) -> object:
        return F.transform(F.coalesce(c, empty), lambda p, i: F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), i.alias("ordinal"), p.alias("pattern")))

    subs = F.flatten(F.transform(F.coalesce(F.map_values("s.sub_patterns"), F.array().cast("array<struct<patterns_before:array<string>,patterns_after:array<string>>>")), lambda x: F.concat(part("sub", "before", x["patterns_before"]), part("sub", "after", x["patterns_after"]))))
    rows = F.concat(part("keyword", "", F.col("s.commit_keywords")), part("pattern", "before", F.col("s.structural_patterns_before")), part("pattern", "after", F.col("s.structural_patterns_after")), subs)
    return d.select("category", F.explode(rows).alias("r")).select("category", "r.*")


def json_rows(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The structs of an array field of JSON documents ('candidates' or 'pairs'), or of JSON lines that hold one each, as
    ``write_report`` writes them. Other input is an error; no lines at all are no rows."""
    fields = [x.strip().split(" ", 1) for x in _fields(schema)]
    head = spark.read.text(path).filter("trim(value) != ''").select(F.json_object_keys("value").alias("k")).head()
    if head is None or field not in (head.k or ()) and {a for a, _ in fields} & set(head.k or ()):
        return spark.read.schema(schema).json(path)
    found = spark.read.schema(f"{field} array<struct<{', '.join(f'{a}:{b}' for a, b in fields)}>>").json(path, multiLine=True)
    if found.filter(F.col(field).isNotNull()).isEmpty():
        raise ValueError(f"{path} holds neither {field} nor lines with any of {', '.join(a for a, _ in fields)}")
    return found.select(F.inline(field))


def _fields(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def benchmark_results(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """file, threads, ordinal, value of result_t<N>.json files: entries whose thread count is the file name's and whose
    name holds the variant, whatever the case."""
    schema = "benchmark string, threads int, primaryMetric struct<rawData:array<array<double>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    d = d.filter((F.regexp_extract("file", r"result_t(\d+)\.json", 1).try_cast("int") == F.col("threads")) & F.contains(F.lower("benchmark"), F.lit(variant.lower())))
    return d.select("file", "threads", F.posexplode(F.flatten("primaryMetric.rawData")).alias("ordinal", "value"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return d.select("file", F.posexplode(F.split("value", r"\r?\n", -1)).alias("line", "text"))


def heap_log(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value: the first heapMB=<int> of each line that has one."""
    d = _numbered(spark, path).withColumn("value", F.regexp_extract("text", r"heapMB=(\d+)", 1).try_cast("double"))
    return d.filter("value IS NOT NULL").select("file", "line", "value")


def descriptor_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of lines of exactly two fields whose second is a whole number; others are dropped."""
    p = F.split("text", ",", -1)
    d = _numbered(spark, path).filter(F.size(p) == 2).withColumn("value", F.trim(F.get(p, 1)).try_cast("int"))
    return d.filter("value IS NOT NULL").select("file", "line", F.col("value").cast("double").alias("value"))


def code_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted cells that may span lines."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def diffs(spark: SparkSession, path: str) -> DataFrame:
    """file, diff: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("diff"))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """A projection for CSV: arrays joined by '|', nulls empty, missing columns empty, other columns left out."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        if c not in kinds:
            out.append(F.lit("").alias(c))
        elif kinds[c].startswith("array"):
            out.append(F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c))
        else:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    flat(df, columns).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


VECTOR = "vec_id long, embedding array<float>, label int"


def vectors(spark: SparkSession, path: str, schema: str = VECTOR) -> DataFrame:
    """Vectors with their ids and labels."""
    return spark.read.schema(schema).parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
