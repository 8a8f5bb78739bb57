"""Boosted trees: few jobs for few rows, and the same trees from many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import boosting, learning


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=3) + [3 * (i % 4), (i % 4) ** 2, 0]], i % 4) for i in range(400)]
    return spark.createDataFrame(rows, "vec_id long, features array<double>, label4 int").persist()


def told(d, **how):
    rows = learning.predict("boosted", d.filter("vec_id >= 100"), d.filter("vec_id < 100"), 0.0, **how)
    return sorted((r.vec_id, tuple(r.probability), r.predicted, r.label4) for r in rows.collect())


def test_blocks_and_one_task_agree(noisy, monkeypatch):
    jobs = []
    real = boosting._spread
    monkeypatch.setattr(boosting, "_spread", lambda data, *how: jobs.append(data.getNumPartitions()) or real(data, *how))
    whole = told(noisy, rounds=7)
    assert not jobs and np.mean([p == y for _, _, p, y in whole]) > 0.8
    monkeypatch.setattr(boosting, "ONE_TASK", 50)
    monkeypatch.setattr(boosting, "FEW_ROWS", 100)
    assert told(noisy, rounds=7) == whole and jobs == [3]
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    assert len(told(noisy, rounds=1)) == 100 and jobs == [3, 5]


def test_jobs_do_not_grow_with_rounds(spark, noisy):
    tracker, group = spark.sparkContext.statusTracker(), "boosted"
    seen = []
    for rounds in (2, 9):
        spark.sparkContext.setJobGroup(f"{group}{rounds}", "")
        learning.fit("boosted", noisy, rounds=rounds)
        seen.append(len(tracker.getJobIdsForGroup(f"{group}{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen[0] == seen[1] < 20, seen


def test_best_equals_all_splits():
    rng = np.random.default_rng(9)
    x, w, r = rng.integers(0, 32, (200, 4)), rng.integers(1, 4, 200).astype(float), rng.normal(size=200)
    sums = np.stack([[[np.bincount(x[:, j], v, 32) for j in range(4)]] for v in (w, w * r)])
    gain, f, c, left, right, own = boosting.best(sums, np.arange(4))[:, 0, 0]
    error = lambda m: (w[m] * (r[m] - np.average(r[m], weights=w[m])) ** 2).sum()
    every = {(j, b): error(x[:, j] >= 0) - error(x[:, j] <= b) - error(x[:, j] > b) for j in range(4) for b in range(31) if 0 < (x[:, j] <= b).sum() < 200}
    assert (f, c) == max(every, key=every.get) and np.isclose(gain, every[f, c]) and np.isclose(own, np.average(r, weights=w))
    assert np.isclose(left, np.average(r[x[:, int(f)] <= c], weights=w[x[:, int(f)] <= c]))


def test_rows_that_nothing_parts(spark):
    d = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("features"), F.when(F.col("id") % 2 == 0, 0).otherwise(2).alias("label4"))
    rows = learning.predict("boosted", d, d, 0.0, rounds=3).collect()
    assert len(rows) == 40 and all(np.allclose(r.probability, [0.5, 0, 0.5, 0]) for r in rows)
