"""Blocks of retrieval: bounded in number, equal vectors, groups of an index that share cells."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import vectors


def test_small_blocks_do_not_grow_in_number_with_the_input():
    assert vectors._blocks(450, 64, 1 << 14) == vectors.MANY
    assert vectors._blocks(600_000, 64, 1 << 14) == vectors._blocks(600_000, 64, vectors.BLOCK_BYTES) == 10
    assert vectors._blocks(100_000, 64, vectors.BLOCK_BYTES) == vectors.MANY  # cells for all threads
    assert vectors._blocks(0, 64, 1 << 14) == vectors._blocks(1, 0, 8) == 1


def test_copies_are_taken_by_id_and_rows_are_sent_to_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    common = [float(x) for x in rng.normal(size=8)]
    rows = [(i, common if i % 3 else [float(x) for x in rng.normal(size=8)], i % 4, i % 5) for i in range(900)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int")
    sent = []
    real = vectors._met
    monkeypatch.setattr(vectors, "_met", lambda d, *a, **b: sent.append(d.count()) or real(d, *a, **b))
    near = vectors.top_k(v, v, 4, apart=True, block_bytes=64).collect()
    assert sent[0] <= 2 * vectors.MANY * len(rows)
    m = np.array([r[1] for r in rows])
    for i in range(0, 900, 37):
        sims = [(-float(np.einsum("j,j->", m[i], m[j])), j) for j in range(900) if j % 5 != i % 5]
        got = [r.neighbour for r in sorted((r for r in near if r.vec_id == i), key=lambda r: r["rank"])]
        want = sorted(sims)[:4]
        assert np.allclose([float(m[i] @ m[j]) for j in got], [-s for s, _ in want]) and [j for j in got if j % 3] == sorted(j for j in got if j % 3)
    per = vectors.top_k(v, v, 4, by_project=True, block_bytes=64)
    assert per.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n != 20").isEmpty()


def test_groups_of_an_index_share_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 4, 0) for i in range(1200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label4 int, project int")
    items, asked = v.filter("vec_id % 10 != 0"), v.filter("vec_id % 10 = 0")
    vectors.write_index(items, f"{tmp_path}/index", block_bytes=480)
    sent = []
    real = vectors._met
    monkeypatch.setattr(vectors, "_met", lambda d, *a, **b: sent.append(d.count()) or real(d, *a, **b))
    near, told = vectors.search(asked, f"{tmp_path}/index", 5, block_bytes=480)
    got = sorted((r.vec_id, r["rank"], r.neighbour) for r in near.collect())
    assert told["pairs"] > 5000 and max(sent) <= 3 * vectors.MANY * 1200
    assert got == sorted((r.vec_id, r["rank"], r.neighbour) for r in vectors.top_k(asked, items, 5).collect())
