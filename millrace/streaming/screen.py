"""Screening of diffs as files arrive, and windows over events (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import learning, screening, vectors
from ..operators.screening import screened_methods

VERDICT = "file_name string, file string, method string, code string, label int, confidence double, verdict string, label_name string"


def diff_stream(spark: SparkSession, path: str) -> DataFrame:
    """file, diff of each new file of a folder."""
    d = spark.readStream.format("text").option("wholetext", True).schema("value string").load(path)
    return d.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("diff"))


def screen_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Bodies of methods that new diffs add, appended to a Parquet folder; stateless, so late files need no watermark."""
    out = screened_methods(diff_stream(spark, source), "file_name").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def verdict_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, model: str, encoded: str, k: int = vectors.K, tau: float = vectors.TAU, most: int = 1000) -> StreamingQuery:
    """Verdicts on the methods that new diffs add, by a stored model and its index (``<model>-index``) with the vectors of methods
    in ``encoded`` (code, embedding), until no file is left.

    A batch goes to ``batch=N`` under the sink and replaces what an interrupted run of it left there, so that each diff's verdicts are there
    once. Model, index and vectors are read at the start of each batch; ``most`` files make one."""

    def take(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        methods = screened_methods(batch, "file_name")
        judged = screening.by_model(methods, here.read.parquet(encoded), here.read.parquet(f"{model}-index"), learning.load(model), k, tau)
        out = screening.verdicts(judged, tau=tau).select(*[c.split()[0] for c in VERDICT.split(", ")])
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    d = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most).schema("value string").load(source)
    named = d.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("diff"))
    return named.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_verdicts(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(f"{VERDICT}, batch long").parquet(sink)


def event_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type with a watermark; ``events`` may be a stream."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
