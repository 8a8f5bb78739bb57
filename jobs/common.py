"""What the jobs share: their config, the shape of their input, and their start."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("millrace.jobs")


def config(spark: SparkSession, path: str, **known) -> dict:
    """The settings of a JSON file over the ``known`` ones; others are an error. Spark reads it, so the path may be remote."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings {sorted(unknown)} in {path}; known are {sorted(known)}")
    return known | given


def shaped(spark: SparkSession, rows: DataFrame, select: str) -> DataFrame:
    """``select``, a SQL text over ``{input}``, on rows of a table or a stream."""
    return spark.sql(select, input=rows)


def start(name: str) -> SparkSession:
    """The session of a command line."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
