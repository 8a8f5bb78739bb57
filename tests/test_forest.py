"""A forest that no place holds whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import forest, learning


@pytest.mark.parametrize("few", [60, 1 << 20])
def test_only_upper_levels_are_grown_on_the_driver(spark, monkeypatch, few):
    depths = []
    real = forest.RandomForestClassifier
    monkeypatch.setattr(forest, "RandomForestClassifier", lambda **how: depths.append(how["maxDepth"]) or real(**how))
    monkeypatch.setattr(learning, "RandomForestClassifier", forest.RandomForestClassifier)
    monkeypatch.setattr(forest, "LEAF_ROWS", few)
    rng = np.random.default_rng(5)
    rows = [(i, [float(r * np.cos(a)), float(r * np.sin(a)), float(i % 4 // 2)], i % 4) for i in range(600) for a, r in [(rng.uniform(0, 6.28), 0.5 + 1.5 * (i % 2))]]
    d = spark.createDataFrame(rows, "vec_id long, features array<double>, label4 int")
    told = learning.predict("forest", d.filter("vec_id >= 150"), d.filter("vec_id < 150"), 0.0, trees=20).collect()
    assert sorted(r.vec_id for r in told) == list(range(150)) and all(abs(sum(r.probability) - 1) < 1e-9 for r in told)
    assert np.mean([r.predicted == r.label4 for r in told]) > 0.95
    assert depths == ([3] if few == 60 else [])


def test_a_tree_fits_its_rows_and_ends():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 32, (500, 9)).astype(np.uint8), rng.integers(0, 4, 500)
    assert (forest.grow(x, y, np.ones(500), x, 30, 1).argmax(1) == y).all()
    same = forest.grow(np.zeros((8, 9), np.uint8), np.arange(8) % 4, np.ones(8), x[:3], 30, 1)
    assert np.allclose(same, 0.25)
    assert np.allclose(forest.grow(x, y, np.ones(500), x[:2], 0, 1), np.bincount(y) / 500)


def test_reruns_agree(spark):
    rng = np.random.default_rng(7)
    d = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=5)], int(rng.integers(0, 4))) for i in range(200)], "vec_id long, features array<double>, label4 int")
    one, two = (sorted((r.vec_id, tuple(r.probability)) for r in learning.predict("forest", x.filter("vec_id >= 50"), x.filter("vec_id < 50"), trees=12).select("vec_id", F.transform("probability", lambda p: F.round(p, 9)).alias("probability")).collect()) for x in (d, d.repartition(7)))
    assert one == two


def test_equal_rows_are_dealt_out_as_one(spark, monkeypatch):
    dealt = []
    real = forest._binned
    monkeypatch.setattr(forest, "_binned", lambda d, cuts: dealt.append(d.count()) or real(d, cuts))
    d = spark.range(4000).selectExpr("id AS vec_id", "array(CAST(id % 7 AS DOUBLE), CAST(id % 2 AS DOUBLE)) AS features", "CAST(id % 7 % 4 AS INT) AS label4")
    told = learning.predict("forest", d.filter("vec_id >= 500"), d.filter("vec_id < 500"), 0.0, trees=10).collect()
    assert dealt == [28] and len(told) == 500
    assert all(r.predicted == r.label4 for r in told)
