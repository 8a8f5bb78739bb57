"""What a fit sends in each round doesn't grow with the parts of its input."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import learning


@pytest.mark.parametrize("few,most,want", [(2048, 65_536, 1), (50, 65_536, 4), (50, 30, 10)])
def test_fits_take_as_many_parts_as_threads(spark, monkeypatch, few, most, want):
    seen = []
    real = learning.LogisticRegression

    class Counted(real):
        def _fit(self, dataset):
            seen.append((dataset.rdd.getNumPartitions(), dataset.count(), dataset.storageLevel.useMemory))
            return super()._fit(dataset)

    monkeypatch.setattr(learning, "LogisticRegression", Counted)
    monkeypatch.setattr(learning, "FEW_ROWS", few)
    monkeypatch.setattr(learning, "PART_ROWS", most)
    d = spark.range(300, numPartitions=40).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 4).cast("double"), F.lit(1.0)).alias("features"), (F.col("id") % 4).cast("int").alias("label4"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    learning.fit("logistic", d)
    assert seen == [(want, 300, True)]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
