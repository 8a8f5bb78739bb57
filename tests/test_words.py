"""Word vectors of many rows are learnt from counts of pairs."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import forest, learning, words

KINDS = [["lock", "unlock", "wait"], ["put", "cache", "map"], ["open", "close", "stream"], ["plus", "minus", "times"]]


def test_many_rows_cost_as_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(learning, "COUNTED_ROWS", 200)
    monkeypatch.setattr(learning, "Word2Vec", None)  # no row is gone through again
    rng = np.random.default_rng(2)
    rows = [(i, [str(rng.choice(KINDS[i % 4])) for _ in range(12)], i % 4, i < 300) for i in range(320)] + [(500, [], 3, False), (501, ["never", "lock"], 3, False)]
    d = spark.createDataFrame(rows, "vec_id long, tokens array<string>, label4 int, in_train boolean")
    got = {r.vec_id: np.array(r.features) for r in learning.word_vectors(d, size=16, rounds=8).collect()}
    assert len(got) == len(rows) and not got[500].any()
    one = spark.createDataFrame([(900, ["lock"])], "vec_id long, tokens array<string>")
    known, v = words.learn(d.filter("in_train").select("tokens", F.lit(1).alias("n")), 16, 8)
    assert np.allclose(2 * got[501], words.means(one, known, v).first().features, atol=1e-6)
    u = dict(zip(known.to_pylist(), v / np.linalg.norm(v, axis=1, keepdims=True)))
    near = [u[a] @ u[b] for k in KINDS for a in k for b in k if a < b]
    far = [u[a] @ u[b] for k in KINDS for m in KINDS if k is not m for a in k for b in m]
    assert min(near) > max(far) + 0.3


def test_pairs_are_those_of_the_rows(spark):
    rows = [(["a", "b", "a", "c"], 3), (["b"], 5), ([], 2), (["c", "a"], 1)]
    got = {(r.word, r.other): round(r.weight, 9) for r in words.pairs(spark.createDataFrame(rows, "tokens array<string>, n long"), 2).collect()}
    want = {}
    for t, n in rows:
        for i, a in enumerate(t):
            for j, b in enumerate(t):
                if 0 < abs(i - j) <= 2:
                    want[a, b] = want.get((a, b), 0) + n * (3 - abs(i - j)) / 2
    assert got == want


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    block = (np.array([2, 5]), np.array([0, 2]), np.array([0, 3, 1, 3, 0]), rng.random(5), rng.random(5))
    v, u = rng.normal(size=(2, 3)), rng.normal(size=(4, 3))
    for by_node, x in ((False, v), (True, u)):
        names, slope, _, _ = words.slopes(block, v, u, by_node)
        for i, name in enumerate(names):
            for j in range(3):
                each = []
                for h in (1e-5, -1e-5):
                    x[name, j] += h
                    each.append(words.slopes(block, v, u, by_node)[3])
                    x[name, j] -= h
                assert abs((each[0] - each[1]) / 2e-5 - slope[i, j]) < 1e-6


def test_paths_tell_words_apart():
    counts = [50, 20, 9, 9, 4, 1]
    starts, nodes, bits = words.paths(counts)
    ways = [tuple(zip(nodes[a:b].tolist(), bits[a:b].tolist())) for a, b in zip(starts, starts[1:])]
    assert len(set(ways)) == 6 and len(ways[0]) == 1 and max(map(len, ways)) == len(ways[5])
    assert all(w[0][0] == 4 for w in ways) and set(nodes.tolist()) == set(range(5))


def test_copies_need_no_upper_levels(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_ROWS", 100)
    monkeypatch.setattr(forest, "RandomForestClassifier", None)
    monkeypatch.setattr(forest, "_cuts", None)
    d = spark.range(4000).selectExpr("id AS vec_id", "array(CAST(id % 7 AS DOUBLE), 1.5D) AS features", "CAST(id % 7 % 4 AS INT) AS label4")
    told = learning.predict("forest", d.filter("vec_id >= 500"), d.filter("vec_id < 500"), 0.0, trees=10).collect()
    assert len(told) == 500 and all(r.predicted == r.label4 for r in told)
