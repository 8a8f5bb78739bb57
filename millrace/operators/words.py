"""Word vectors by skip-gram from counts of pairs of words: the likelihood of a text is a function of these counts, whatever the number of its rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a block, entries that are multiplied at a time, and inner nodes whose sums meet in one task.
BLOCK_PAIRS, STEP, NODES = 65_536, 8_192, 4_096
#: The first step of a coordinate; later ones shrink as its squared slopes add up.
RATE = 0.1


def paths(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Huffman tree of words: where each word's path begins in the other two (one more at the end), its inner nodes from the root down, and whether it goes to the second child."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, second = np.zeros(2 * n, np.int64), np.zeros(2 * n, bool)
    for new in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[[i, j]], second[j] = new, True
        heapq.heappush(heap, (a + b, new))
    starts, nodes, bits = [0], [], []
    for i in range(n):
        way = []
        while i < 2 * n - 2:
            way.append((parent[i] - n, second[i]))
            i = parent[i]
        nodes += [x for x, _ in reversed(way)]
        bits += [b for _, b in reversed(way)]
        starts.append(len(nodes))
    return np.array(starts), np.array(nodes, np.int64), np.array(bits, bool)


def pairs(rows: DataFrame, window: int, tokens: str = "tokens", n: str = "n") -> DataFrame:
    """word, other, weight: how often words lie within a window whose reach is drawn evenly from 1 to ``window``, as expected. A row counts ``n`` times."""
    t = F.col(tokens)
    ahead = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.transform(F.slice(t, d + 1, F.greatest(F.size(t) - d, F.lit(0))), lambda x, i: F.struct(F.get(t, i).alias("word"), x.alias("other"), d.alias("d")))))
    one = rows.select(n, F.explode(ahead).alias("p")).groupBy("p.word", "p.other").agg(F.sum(F.col(n) * (window + 1 - F.col("p.d"))).alias("w"))
    both = one.unionByName(one.select(F.col("other").alias("word"), F.col("word").alias("other"), "w"))
    return both.groupBy("word", "other").agg((F.sum("w") / window).alias("weight"))


def _blocks(found: DataFrame, words: pa.Array, tree: tuple, parts: int) -> RDD:
    """For each part, by word: the words, where the entries of each begin, and each entry's node and how often the path turns to its first and second child there."""
    shared = found.sparkSession.sparkContext.broadcast((words, tree))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("word", pa.string()), ("other", pa.string()), ("weight", pa.float64())]))
        if not len(t):
            return
        known, (starts, nodes, bits) = shared.value
        a, b = (pc.index_in(t[c].combine_chunks(), value_set=known).to_numpy() for c in ("word", "other"))
        length = starts[b + 1] - starts[b]
        at = np.repeat(starts[b] - np.r_[0, length.cumsum()[:-1]], length) + np.arange(length.sum())
        key, where = np.unique(np.repeat(a.astype(np.int64), length) * len(known) + nodes[at], return_inverse=True)
        weight = np.repeat(t["weight"].to_numpy(), length)
        turns = [np.bincount(where, np.where(bits[at] == second, weight, 0.0), len(key)) for second in (False, True)]
        own, begin = np.unique(key // len(known), return_index=True)
        packed = [own.astype(np.int64), begin.astype(np.int64), key % len(known), *turns]
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.large_binary()) for v in packed], list("wbnlr"))

    held = found.repartition(parts, "word").mapInArrow(pack, ", ".join(f"{c} binary" for c in "wbnlr"))
    return held.rdd.map(lambda r: (*(np.frombuffer(r[c], np.int64) for c in "wbn"), *(np.frombuffer(r[c]) for c in "lr")))


def slopes(block: tuple, v: np.ndarray, u: np.ndarray, by_node: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Words of a block or nodes, the slopes of the log likelihood by their vectors, how often they occur, and the likelihood. ``v``: the block's words, ``u``: all nodes."""
    _, begin, node, left, right = block
    of = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(node)]))
    names, at = np.unique(node, return_inverse=True) if by_node else (np.arange(len(begin)), of)
    out, total = np.zeros((len(names), v.shape[1])), 0.0
    order = np.argsort(at, kind="stable") if by_node else np.arange(len(at))
    for i in range(0, len(order), STEP):
        e = order[i : i + STEP]
        a, b = v[of[e]], u[node[e]]
        x = np.einsum("ij,ij->i", a, b)
        total -= float((left[e] * np.logaddexp(0, -x) + right[e] * np.logaddexp(0, x)).sum())
        pull = left[e] - (left[e] + right[e]) / (1 + np.exp(-x))
        first = np.flatnonzero(np.r_[True, at[e][1:] != at[e][:-1]])
        out[at[e][first]] += np.add.reduceat(pull[:, None] * (a if by_node else b), first)
    return names, out, np.bincount(at, left + right, len(names)), total


def _step(x: np.ndarray, seen: np.ndarray, slope: np.ndarray, often: np.ndarray) -> None:
    """Moves ``x`` up the mean slope, by coordinate the less the more was seen of it."""
    mean = slope / np.maximum(often, 1e-300)[:, None]
    seen += mean**2
    x += RATE * mean / np.sqrt(seen + 1e-20)


def learn(rows: DataFrame, size: int, rounds: int, window: int = 5, seed: int = 42, tokens: str = "tokens", n: str = "n") -> tuple[pa.Array, np.ndarray]:
    """The words and their vectors: skip-gram with a Huffman tree, which ``Word2Vec`` climbs row by row, climbed on the counts of pairs of all rows.

    The counts are made once, by Spark. A round moves the words' vectors by the slopes over all pairs, which blocks of pairs tell, and then the nodes'. As in
    MLlib, the vectors of the vocabulary are on the driver and are sent to the blocks; a round costs as the different pairs, not as the rows."""
    spark = rows.sparkSession
    counted = rows.select(n, F.explode(tokens).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.sum(n).alias("n")).orderBy(F.desc("n"), "word").toArrow()
    words, k = counted["word"].combine_chunks().cast(pa.string()), len(counted)
    v = ((np.random.default_rng(seed).random((k, size)) - 0.5) / size).astype(float)
    if k < 2:
        return words, v
    found = pairs(rows, window, tokens, n).filter("word IS NOT NULL AND other IS NOT NULL").persist()
    different = found.count()
    u = np.zeros((k, size))
    seen = [np.zeros_like(v), np.zeros_like(u)]
    blocks = _blocks(found, words, paths(counted["n"].to_pylist()), max(1, min(spark.sparkContext.defaultParallelism, -(-different // (BLOCK_PAIRS // 16))), -(-different // BLOCK_PAIRS))).persist()
    try:
        for _ in range(rounds if different else 0):
            sent = spark.sparkContext.broadcast((v, u))
            for own, slope, often, _total in blocks.map(lambda b: (b[0], *slopes(b, sent.value[0][b[0]], sent.value[1], False)[1:])).collect():  # a word is in one block
                part, was = v[own], seen[0][own]
                _step(part, was, slope, often)
                v[own], seen[0][own] = part, was
            sent.unpersist()
            sent = spark.sparkContext.broadcast((v, u))

            def by_node(block: tuple) -> list[tuple]:
                names, slope, often, _ = slopes(block, sent.value[0][block[0]], sent.value[1], True)
                cut = [(i, names // NODES == i) for i in np.unique(names // NODES)]
                return [(int(i), (names[m], slope[m], often[m])) for i, m in cut]

            def added(x: tuple, y: tuple) -> tuple:
                names, at = np.unique(np.r_[x[0], y[0]], return_inverse=True)
                slope, often = np.zeros((len(names), size)), np.zeros(len(names))
                for (m, s, o), w in ((x, at[: len(x[0])]), (y, at[len(x[0]) :])):
                    slope[w] += s
                    often[w] += o
                return names, slope, often

            for _, (own, slope, often) in blocks.flatMap(by_node).reduceByKey(added, -(-k // NODES)).collect():
                part, was = u[own], seen[1][own]
                _step(part, was, slope, often)
                u[own], seen[1][own] = part, was
            sent.unpersist()
    finally:
        blocks.unpersist()
        found.unpersist()
    return words, v


def means(rows: DataFrame, words: pa.Array, v: np.ndarray, tokens: Column | str = "tokens") -> DataFrame:
    """rows with features: the mean of the vectors of a row's words, where unknown ones count as zeros; zeros without words."""
    shared = rows.sparkSession.sparkContext.broadcast((words, v))
    width = v.shape[1]

    @F.arrow_udf("array<double>")
    def mean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, vectors = shared.value
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(b.flatten().cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(size)), size)
            of, at = of[at >= 0], at[at >= 0]
            out = np.zeros((len(size), width))
            for i in range(0, len(of), STEP):
                first = np.flatnonzero(np.r_[True, of[i : i + STEP][1:] != of[i : i + STEP][:-1]])
                out[of[i : i + STEP][first]] += np.add.reduceat(vectors[at[i : i + STEP]], first)
            out /= np.maximum(size, 1)[:, None]
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))

    return rows.withColumn("features", mean(tokens))
