"""Rows are sent to the trees in pieces, and nodes of few rows and of many tell the same splits."""

import numpy as np
import pytest

from millrace.operators import forest, learning


def _brute(bins, y, w):
    """The greatest gain of a node for each feature."""
    out = []
    for b in bins.T:
        gains = [-1.0]
        for cut in np.unique(b)[:-1]:
            gains.append(sum(sum(w[s & (y == c)].sum() ** 2 for c in range(4)) / w[s].sum() for s in (b <= cut, b > cut)))
        out.append(max(gains))
    return np.array(out)


@pytest.mark.parametrize("few", [2, 3, 5, 10, 40])
def test_gains_are_those_of_all_cuts(few):
    rng = np.random.default_rng(few)
    size = rng.integers(1, few + 1, 30)
    bins, y, w = rng.integers(0, 6, (30, few, 4)).astype(np.uint8), rng.integers(0, 4, (30, few)), rng.random((30, few)) + 0.1
    there = np.arange(few) < size[:, None]
    at = np.repeat(np.arange(30), size)
    pairwise, cuts = forest._pairwise(bins, y, w, size)
    tables, others = forest._tables(bins[there], y[there], w[there], at, 30)
    want = np.array([_brute(bins[i][: size[i]], y[i][: size[i]], w[i][: size[i]]) for i in range(30)])
    assert np.allclose(pairwise, want) and np.allclose(tables, want)
    for found in (cuts, others):
        for i, j in zip(*np.nonzero(want > 0)):
            b, s = bins[i, : size[i], j], slice(size[i])
            parts = [sum(w[i, s][p & (y[i, s] == c)].sum() ** 2 for c in range(4)) / w[i, s][p].sum() for p in (b <= found[i, j], b > found[i, j])]
            assert abs(sum(parts) - want[i, j]) < 1e-9


def test_draws_are_those_of_a_bootstrap():
    h = np.arange(200_000).astype(np.uint64)
    one, two = (forest._times(h, np.ones(len(h), int), tree, 42) for tree in (0, 1))
    assert abs(one.mean() - 1) < 0.02 and abs(one.var() - 1) < 0.03 and abs(np.corrcoef(one, two)[0, 1]) < 0.01
    for n in (5, 100):
        many = forest._times(h[:20_000], np.full(20_000, n), 3, 42)
        assert abs(many.mean() / n - 1) < 0.02 and abs(many.var() / n - 1) < 0.05


def test_rows_come_in_pieces_and_below_no_upper_levels(spark, monkeypatch):
    pieces = []
    real = forest._dealt
    monkeypatch.setattr(forest, "_dealt", lambda *how: pieces.append(real(*how).count()) or real(*how))
    monkeypatch.setattr(forest, "RandomForestClassifier", None)
    d = spark.range(0, 22_000, 1, 3).selectExpr("id AS vec_id", "array(CAST(id % 4 AS DOUBLE), CAST(id AS DOUBLE)) AS features", "CAST(id % 4 AS INT) AS label4")
    told = learning.predict("forest", d.filter("vec_id >= 2000"), d.filter("vec_id < 2000"), 0.0, trees=5).collect()
    assert sorted(r.vec_id for r in told) == list(range(2000)) and np.mean([r.predicted == r.label4 for r in told]) > 0.99
    assert pieces[0] <= 5 * 20


def test_ids_may_be_texts(spark):
    d = spark.range(300).selectExpr("concat('v', id) AS vec_id", "array(CAST(id % 4 AS DOUBLE), CAST(id % 5 AS DOUBLE)) AS features", "CAST(id % 4 AS INT) AS label4")
    told = learning.predict("forest", d, d, 0.0, trees=8).collect()
    assert len(told) == 300 and all(r.predicted == r.label4 for r in told)
