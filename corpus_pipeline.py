"""The corpus pipeline: stages over documents, each calling one operator of ``millrace.llm``.

Each stage takes all rows its predecessor kept. All but the last return the columns of documents:

1. toxicity: documents whose score is 0.5 or more go.
2. near_dedup: of each component of near-duplicates one row stays, of the least id (of several such rows the first one
   written); blank texts are not duplicates of anything, and rows without doc_id stay. Rows that share an id are judged
   one by one, each by its own text.
3. secrets: every span found is replaced by a mark; n_chars follows. No document goes.
4. mixing: each source is taken up to its target; a document that is taken k times is there k times, in training order.
5. packing: the pieces of all documents and their bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import minhash, mixing, packing, secret_scan, toxicity
from millrace.llm.common import forget, placed, save, table, tables_of_run

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = placed(docs, "place", *COLUMNS)
    gone = minhash.near_duplicates(rows, key="place").filter("NOT kept").select(F.col("place").alias("gone"))
    return rows.join(gone, rows.place == gone.gone, "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(docs.withColumn("was", F.col("text").isNull()), carry=("was", "lang", "source", "n_chars"))
    out = secret_scan.redact(found)
    touched = F.size("spans") > 0
    return out.select("doc_id", F.when(~F.col("was"), F.col("text")).alias("text"), "lang", "source", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("secrets", redact_secrets), ("mixing", mix), ("packing", pack)]

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with tables_of_run() as mine:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = save(docs, name)
                forget(spark, mine[:-1])  # what the stage read is read no more
    return docs
