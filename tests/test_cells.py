"""Retrieval: a cell is a task, sets of columns are looked into by their maxima, lists of neighbours serve folds, few parts for few rows."""

import threading

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import learning, vectors


def test_each_cell_is_a_task_of_its_own(spark):
    rows = [(cell * 10 + i, [float(i), 1.0], 0, 0, side, cell) for cell in range(40) for side in (0, 1) for i in range(3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int, side int, cell int")
    met = vectors._met(d, "cell", 2, 40).withColumn("part", F.spark_partition_id())
    parts = {(r.vec_id // 10, r.part) for r in met.collect()}
    assert len(parts) == len({p for _, p in parts}) == 40


def test_near_best_keeps_all_that_may_be_best():
    rng = np.random.default_rng(4)
    for n in (1, 5, 31, 640, 641, 671, 2000):
        for many in (4, 4000):
            s = rng.integers(-many, many, size=(6, n)).astype(np.float32)
            s[rng.random(s.shape) < 0.4] = -np.inf
            s[0] = -np.inf
            margin = np.full(6, 0.5, np.float32)
            got = set(zip(*(x.tolist() for x in vectors._near_best(s, 5, margin))))
            for i, row in enumerate(s):
                finite = np.sort(row[row > -np.inf])[::-1]
                floor = finite[4] - 0.5 if len(finite) > 4 else -np.inf
                assert {(i, j) for j in np.flatnonzero((row >= floor) & (row > -np.inf)).tolist()} <= got
            assert all(s[i, j] > -np.inf for i, j in got)


def test_blocks_by_project_leave_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 4, None if i % 6 == 5 else i % 6) for i in range(1200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int")
    left = []
    real = vectors._met
    monkeypatch.setattr(vectors, "_met", lambda *a, **b: left.append(real(*a, **b)) or left[-1])
    near = vectors.top_k(v.filter("project IS NOT NULL"), v.filter("project IS NOT NULL"), 5, by_project=True, block_bytes=64)
    assert near.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n != 25").isEmpty() and near.count() == 25_000
    assert left[0].count() <= 1000 * 5 * (vectors.MANY + 5)


def test_lists_of_neighbours_say_what_rows_do(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 6, i % 4) for i in range(300)]  # labels 4 and 5 are none
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int").persist()
    near = vectors.top_k(v, v, 5, by_project=True).drop("rank").persist()
    lists = vectors.near_lists(near)
    for project in range(4):
        best = F.row_number().over(vectors.W.partitionBy("vec_id").orderBy(F.desc("sim"), "neighbour"))
        told = vectors.retrieval_features(near.filter(F.col("p_") != project).withColumn("rank", best).filter("rank <= 5"))
        want = {r[0]: r[1:] for r in told.collect()}
        got = lists.select("vec_id", vectors.list_features(F.filter("near", lambda x: x["p_"] != project)).alias("f")).collect()
        assert len(got) == 300 and all(np.allclose(r.f, want.get(r.vec_id, [0.0] * 6)) for r in got)


def test_features_of_few_rows_have_few_parts(spark):
    d = spark.range(1000).repartition(64)
    assert vectors.few_parts(d, 1000).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert vectors.few_parts(d, 20 * vectors.PART_ROWS).rdd.getNumPartitions() == 20


def test_predictions_of_a_fold_have_few_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4) + i % 4], i % 4, i % 2, True) for i in range(80)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int, in_train boolean")
    parts = []
    metrics = vectors.detection_metrics
    monkeypatch.setattr(vectors, "detection_metrics", lambda d, *a: parts.append(d.rdd.getNumPartitions()) or metrics(d, *a))
    monkeypatch.setattr(learning, "predict", lambda name, train, test, tau: test.select("vec_id", "label4", F.array(*[F.lit(0.25)] * 4).alias("probability"), F.lit(0).alias("predicted")).repartition(64))
    assert learning.leave_one_project_out(v).count() == 2
    assert max(parts) <= 2 * spark.sparkContext.defaultParallelism


def test_all_classifiers_are_fitted_at_a_time(spark, monkeypatch):
    d = spark.createDataFrame([(i, [float(i)], i % 4) for i in range(8)], "vec_id long, features array<double>, label4 int")
    all_here, begun = threading.Barrier(len(learning.BUILDERS)), []

    def told(name, train, test):
        begun.append(name)
        all_here.wait(20)
        return test.select("label4", F.col("label4").alias("predicted"))

    monkeypatch.setattr(learning, "predict", told)
    assert sorted(r.classifier for r in learning.compare(d, d).collect()) == sorted(learning.BUILDERS) == sorted(begun)
