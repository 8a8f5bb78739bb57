"""Work by row is dealt out by rows, whatever the bytes of a file."""

from pyspark.sql import functions as F

from millrace.plans import catalog
from millrace.sources import readers


def test_parts_of_one_small_file_meet_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "SPREAD_ROWS", 500)
    part = spark.range(3000).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    code = catalog.view(spark, str(tmp_path), "v_code")
    sizes = [r["n"] for r in code.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 6 and max(sizes) <= 700


def test_few_rows_stay(spark):
    few = spark.range(5).coalesce(1)
    assert readers.spread(few).rdd.getNumPartitions() == 1
