"""Screening of unified diffs: added method bodies, their verdicts, and a summary. Works on batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SAFE
from ..functions.text import SCREEN_SKIPS, declared, lines, method_body
from . import learning, vectors

NAMES = ("LOCK_CONTENTION", "MEMORY_LEAK", "RESOURCE_LEAK", "SAFE")
_HUNKS = "struct<file:string,code:string>"
_STATE = f"struct<file:string,open:boolean,code:string,done:array<{_HUNKS}>>"


def added_hunks(diff: Column) -> Column:
    """struct(file, code): the added lines of each hunk of a Java file. A pending hunk is closed by every file header,
    and hunks of other files are left out."""

    def closed(a: Column) -> Column:
        one = F.array(F.struct(a["file"].alias("file"), a["code"].alias("code"))).cast(f"array<{_HUNKS}>")
        return F.when(a["open"] & (a["code"] != "") & (a["file"] != ""), F.concat(a["done"], one)).otherwise(a["done"])

    def state(file: Column, open_: Column, code: Column, done: Column) -> Column:
        return F.struct(file.alias("file"), open_.alias("open"), code.alias("code"), done.alias("done")).cast(_STATE)

    def step(a: Column, x: Column) -> Column:
        header = x.startswith("+++ ")
        java = x.startswith("+++ b/") & x.endswith(".java")
        at_header = state(F.when(java, F.substring(x, 7, 1 << 30)).otherwise(""), F.lit(False), F.lit(""), closed(a))
        at_hunk = state(a["file"], F.lit(True), F.lit(""), closed(a))
        line = F.substring(x, 2, 1 << 30)
        at_added = state(a["file"], a["open"], F.when(a["code"] == "", line).otherwise(F.concat(a["code"], F.lit("\n"), line)), a["done"])
        return F.when(header, at_header).when(x.startswith("@@"), at_hunk).when(a["open"] & x.startswith("+"), at_added).otherwise(a)

    start = state(F.lit(""), F.lit(False), F.lit(""), F.array().cast(f"array<{_HUNKS}>"))
    return F.aggregate(lines(diff), start, step, closed)


def screened_methods(diffs: DataFrame, key: str, diff: str = "diff") -> DataFrame:
    """key, file, method, code: bodies of two lines or more of the methods that added lines declare."""
    h = diffs.select(key, F.explode(added_hunks(F.col(diff))).alias("h")).select(key, "h.file", "h.code")
    names = F.array_except(declared(F.col("code")), F.array(*[F.lit(w) for w in SCREEN_SKIPS]))
    m = h.select(key, "file", "code", F.explode(names).alias("method"))
    return m.select(key, "file", "method", method_body(F.col("code"), F.col("method")).alias("code")).filter("code != ''")


def verdicts(methods: DataFrame, label: str = "label", confidence: str = "confidence", tau: float = 0.4) -> DataFrame:
    """SAFE below ``tau``; FAULT for labels below 3; else SAFE."""
    v = F.when(F.col(confidence) < tau, "SAFE").when(F.col(label) < SAFE, "FAULT").otherwise("SAFE")
    return methods.withColumn("verdict", v).withColumn("label_name", F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.when(F.col("verdict") == "SAFE", SAFE + 1).otherwise(F.col(label) + 1)))


def by_model(methods: DataFrame, encoded: DataFrame, index: DataFrame, model, k: int = vectors.K, tau: float = vectors.TAU) -> DataFrame:
    """methods with label and confidence by a stored model: ``encoded`` (code, embedding) holds the methods' vectors,
    ``index`` the labelled ones. A method without a vector is safe with confidence 0."""
    known = encoded.select(F.xxhash64("code").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.lit(SAFE).alias("label4"), F.lit(-1).alias("project"), F.lit(False).alias("in_train")).dropDuplicates(["vec_id"])
    asked = known.join(methods.select(F.xxhash64("code").alias("vec_id")).distinct(), "vec_id")
    rows = vectors.feature_vector(asked, vectors.retrieval_features(vectors.top_k(asked, index, k)))
    told = learning.apply(model, rows, tau).select(F.col("vec_id").alias("v_"), F.col("predicted").alias("p_"), F.array_max("probability").alias("c_"))
    out = methods.join(told, F.xxhash64("code") == F.col("v_"), "left")
    return out.select(*[methods[c] for c in methods.columns], F.coalesce("p_", F.lit(SAFE)).alias("label"), F.coalesce("c_", F.lit(0.0)).alias("confidence"))


def screen_report(screened: DataFrame) -> DataFrame:
    """One row: methods, faults, and faults of each kind."""
    fault = F.col("verdict") == "FAULT"
    return screened.agg(F.count("*").alias("methods"), F.count_if(fault).alias("faults"), *[F.count_if(fault & (F.col("label_name") == n)).alias(n.lower()) for n in NAMES[:3]])


def exit_code(report: DataFrame, fail_on_fault: bool) -> int:
    """0, or 1 if asked for and a fault was found; what fails to run is the caller's 2."""
    row = report.first()
    return int(fail_on_fault and bool(row) and row["faults"] > 0)


def majority_prompt(snippet: Column, neighbours: Column, mode: str = "few_shot") -> Column:
    """The text of a question about a snippet: alone, with reasoning, or with (label, similarity) neighbours."""
    ask = F.concat(F.lit("Classify the Java method as LOCK_CONTENTION, MEMORY_LEAK, RESOURCE_LEAK or SAFE.\n"), snippet)
    if mode == "zero_shot":
        return ask
    if mode == "chain":
        return F.concat(ask, F.lit("\nThink step by step, then answer with one name."))
    shots = F.array_join(F.transform(neighbours, lambda n: F.format_string("%s (similarity %.2f)", n["label"], n["sim"])), "; ")
    return F.concat(ask, F.lit("\nSimilar methods: "), shots)
