"""A forest that is grown and asked without ever being whole in one place: upper levels by MLlib, the trees below a leaf of these by (tree, leaf)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training rows that a leaf of the upper levels holds on average at most; the rest of a tree is grown where these rows are.
LEAF_ROWS = 131_072
#: Bins of a feature, as many as MLlib's own trees have.
BINS = 32
CLASSES = 4
#: Shares of a Poisson law of mean 1 up to 0, 1, 2, ...: how often a tree takes a row.
DRAWS = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941, 0.99992)

#: Different rows up to which cuts are told from these and their numbers.
FEW_DIFFERENT = 4096
#: Equal rows beyond which a tree draws for all of them at once, by the normal law that their sum nears.
SUMMED = 30


def _cuts(train: DataFrame, width: int) -> list[np.ndarray]:
    """At most BINS - 1 cuts of each feature, from its quantiles."""
    columns = train.select(*[F.get("features", i).alias(f"f{i}") for i in range(width)])
    told = columns.approxQuantile(columns.columns, [i / BINS for i in range(1, BINS)], 0.002)
    return [np.unique(np.array(x, float)) for x in told]


def _cuts_of_few(equal: DataFrame) -> list[np.ndarray]:
    """What ``_cuts`` gives, exactly, of few different rows of which there are n each."""
    told = equal.select("features", "n").toArrow()
    m = np.array(told["features"].to_pylist(), float)
    at = np.quantile(m, np.arange(1, BINS) / BINS, axis=0, method="inverted_cdf", weights=told["n"].to_numpy())
    return [np.unique(x) for x in at.T]


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """rows with bins: a byte for each feature in place of features."""
    names, at = rows.columns, rows.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts))
            x = np.empty(m.shape, np.uint8)
            for i, c in enumerate(cuts):
                x[:, i] = np.searchsorted(c, m[:, i], side="left")
            bins = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([bins if i == at else c for i, c in enumerate(b.columns)], names)

    return rows.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'features' else t}" for c, t in rows.dtypes)).withColumnRenamed("features", "bins")


def _tables(bins: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node and feature tried: the greatest gain and the cut that has it, from sums by class and bin. bins: a row for each training row, a column for each
    feature tried; ``at``: the rows' nodes."""
    tries = bins.shape[1]
    each = nodes * tries
    key = (y * BINS * each + at * tries)[:, None] + np.arange(tries) + bins.astype(np.int64) * each
    low = np.bincount(key.ravel(), np.repeat(w, tries), CLASSES * BINS * each).reshape(CLASSES, BINS, each)
    np.cumsum(low, axis=1, out=low)
    whole = low[:, -1]
    nl, square = low.sum(0), np.einsum("cbi,cbi->bi", low, low)
    nh = nl[-1] - nl
    rest = np.einsum("ci,ci->i", whole, whole) - 2 * np.einsum("ci,cbi->bi", whole, low) + square
    gain = np.where((nl > 0) & (nh > 0), square / np.maximum(nl, 1e-300) + rest / np.maximum(nh, 1e-300), -1.0)
    cut = gain.argmax(0)
    return gain[cut, np.arange(each)].reshape(nodes, tries), cut.reshape(nodes, tries)


def _pairwise(bins: np.ndarray, y: np.ndarray, w: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_tables`` tells, of nodes of few rows, whose bins are compared with one another. bins: nodes x rows x features tried; y, w: nodes x rows, of
    which ``size`` count."""
    nodes, most, tries = bins.shape
    there = np.arange(most) < size[:, None]
    by_class = np.where(there, w, 0.0)[:, :, None] * (y[:, :, None] == np.arange(CLASSES))
    b = np.ascontiguousarray(bins.transpose(0, 2, 1))
    under = (b[:, :, None, :] <= b[:, :, :, None]) & there[:, None, None, :]
    low = np.matmul(under.reshape(nodes, tries * most, most).astype(float), by_class)
    whole = by_class.sum(1)[:, None]
    nl, n = low.sum(2), whole.sum(2)
    square, rest = np.einsum("nic,nic->ni", low, low), np.einsum("nic,nic->ni", whole - low, whole - low)
    parted = under.sum(3).reshape(nodes, -1) < size[:, None]
    gain = np.where(parted, square / np.maximum(nl, 1e-300) + rest / np.maximum(n - nl, 1e-300), -1.0).reshape(nodes, tries, most)
    gain[np.broadcast_to(~there[:, None], gain.shape)] = -1.0
    at = gain.argmax(2) + most * np.arange(nodes * tries).reshape(nodes, tries)
    return gain.ravel().take(at), b.ravel().take(at)


#: Rows of nodes whose rows are compared with one another, by which they are dealt with together; and numbers that are held at a time.
FEW, HELD = (2, 3, 4, 6, 8, 10), 1 << 18


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, depth: int, seed: int) -> np.ndarray:
    """Class shares of each asked row by one tree of ``x`` (bins), ``y`` (classes), ``w`` (weights); all nodes of a level at once, the best of
    sqrt(features) for each by Gini impurity. A node ends if it is of one class, can't be parted or lies at the greatest depth."""
    rng, tries = np.random.default_rng(seed), math.ceil(math.sqrt(x.shape[1]))
    node, asks, left = np.zeros(len(x), np.int64), np.zeros(len(asked), np.int64), np.arange(len(asked))
    out, nodes, width = np.zeros((len(asked), CLASSES)), 1, x.shape[1]
    while True:
        total = np.bincount(node * CLASSES + y, w, nodes * CLASSES).reshape(nodes, CLASSES)
        n, flat = total.sum(1), x.ravel()
        feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        size = np.bincount(node, minlength=nodes)
        open_ = np.flatnonzero((total > 0).sum(1) > 1) if depth > 0 else np.zeros(0, np.int64)
        if len(open_):
            picked = np.argpartition(rng.random((len(open_), width), np.float32), tries - 1, axis=1)[:, :tries]
            rows = np.argsort(node.astype(np.uint16 if nodes <= 1 << 16 else np.int64), kind="stable")  # few bytes are sorted by digits
            first = np.cumsum(size) - size
            own = (total[open_] ** 2).sum(1) / n[open_] * (1 + 1e-9)
            for few, most in zip((1, *FEW), (*FEW, len(x))):
                which = np.flatnonzero((size[open_] > few) & (size[open_] <= most)) if most > few else []
                small = few < FEW[-1]
                begin = 0
                while begin < len(which):
                    # nodes that are held at a time: of a fixed number of numbers each, or as many as their rows allow
                    end = begin + max(1, HELD // (tries * (most * most if small else BINS * CLASSES)))
                    some = which[begin:end]
                    names, begin = open_[some], end
                    if small:
                        slots = np.minimum(np.arange(most), size[names][:, None] - 1)
                        at = rows[first[names][:, None] + slots]
                        gain, cuts = _pairwise(flat.take((at * width)[:, :, None] + picked[some][:, None, :]), y[at], w[at], size[names])
                    else:
                        each = size[names]
                        of = np.repeat(np.arange(len(names)), each)
                        at = rows[np.arange(len(of)) + np.repeat(first[names] - (np.cumsum(each) - each), each)]
                        gain, cuts = _tables(flat.take((at * width)[:, None] + picked[some][of]), y[at], w[at], of, len(names))
                    j = gain.argmax(1)
                    top = gain[np.arange(len(j)), j]
                    up = np.flatnonzero(top > own[some])
                    feature[names[up]], cut[names[up]] = picked[some[up], j[up]], cuts[up, j[up]]
        over = feature[asks] < 0
        out[left[over]] = total[asks[over]] / n[asks[over]][:, None]
        left, asks = left[~over], asks[~over]
        stay = feature[node] >= 0
        x, y, w, node = x[stay], y[stay], w[stay], node[stay]
        if not len(left):
            return out
        new = np.cumsum(feature >= 0) - 1
        node = 2 * new[node] + (x.ravel().take(np.arange(len(x)) * width + feature[node]) > cut[node])
        asks = 2 * new[asks] + (asked[left, feature[asks]] > cut[asks])
        nodes, depth = 2 * int((feature >= 0).sum()), depth - 1


def _mixed(h: np.ndarray, *more: int) -> np.ndarray:
    """A number in [0, 1) from each hash and ``more``, by the finaliser of splitmix64."""
    z = h.copy()
    for m in more:
        z += np.uint64((m * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def _times(h: np.ndarray, n: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree takes each row, of which there are ``n`` equal ones: a draw for each, or one by the normal law for more than ``SUMMED``."""
    out, rows = np.zeros(len(h), np.int64), np.flatnonzero(n <= SUMMED)
    for copy in range(int(n[rows].max(initial=0))):
        rows = rows[n[rows] > copy]
        out[rows] += np.searchsorted(DRAWS, _mixed(h[rows], seed, tree, copy), side="right")
    many = np.flatnonzero(n > SUMMED)
    if len(many):
        u, v = (_mixed(h[many], seed + i, tree, SUMMED) for i in range(2))
        out[many] = np.maximum(0, np.round(n[many] + np.sqrt(n[many]) * np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * math.pi * v)))
    return out


#: What a part of the rows sends to a leaf of a tree: hashes, classes, weights and bins of the rows taken, ids and bins of those asked.
SENT = ("h", "y", "w", "x", "asked")


def _dealt(at: DataFrame, trees: int, width: int, seed: int) -> DataFrame:
    """A row for each tree, leaf and batch of rows of which the tree takes some or is asked some. at: vec_id, n, label4, weight, bins, leaves."""
    kind = dict(at.dtypes)["vec_id"]
    rows = at.select("vec_id", F.xxhash64("vec_id").alias("h"), F.col("n").cast("long").alias("n"), F.col("label4").cast("int").alias("label4"), F.col("weight").cast("double").alias("weight"), "bins", "leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            h, n, y, w = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            h, x = h.astype(np.int64).view(np.uint64), np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(len(h), width)
            leaves = b.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(h), trees)
            have, asks = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
            for tree in range(trees):
                times = _times(h[have], n[have], tree, seed)
                took = times > 0
                rows, often = have[took], times[took]
                there = np.unique(np.r_[leaves[rows, tree], leaves[asks, tree]])
                order = np.argsort(leaves[rows, tree], kind="stable")
                rows, often = rows[order], often[order]
                asked = asks[np.argsort(leaves[asks, tree], kind="stable")]
                ends = np.searchsorted(leaves[rows, tree], there, side="right")
                ask_ends = np.searchsorted(leaves[asked, tree], there, side="right")

                def cut(v: np.ndarray, ends: np.ndarray, size: int) -> pa.Array:
                    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.r_[0, ends] * size).astype(np.int32).tobytes()), pa.py_buffer(v.tobytes())])

                sent = [cut(h[rows], ends, 8), cut(y[rows].astype(np.int8), ends, 1), cut(w[rows] * often, ends, 8), cut(x[rows], ends, width), cut(x[asked], ask_ends, width)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ask_ends].astype(np.int32)), ids.take(pa.array(asked)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), tree, np.int32)), pa.array(there.astype(np.int32)), lists, *sent], ["tree", "leaf", "ids", *SENT])

    return rows.mapInArrow(run, f"tree int, leaf int, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in SENT))


def shares(train: DataFrame, test: DataFrame, seed: int = 42, trees: int = 300, depth: int = 30) -> DataFrame:
    """test (vec_id, label4, features) with probability instead of features: the mean over the trees of the class shares in a row's leaf. train has weight too.

    Equal rows are dealt out as one. The upper levels part the rows until a leaf holds LEAF_ROWS of those that are dealt out on average; MLlib grows
    these for all trees, and their leaves are known by ``leafCol``. Below, a task holds the rows of one leaf of one tree, a byte for each feature, and those that are asked; they come
    packed, a piece for each batch of rows. What comes of a tree are shares,
    so that no place holds the forest. Trees take rows by a hash below the upper levels, and by MLlib's own draws in these."""
    train, test = train.filter("vec_id IS NOT NULL"), test.filter("vec_id IS NOT NULL")
    both = train.select("vec_id", F.col("label4").cast("int").alias("label4"), "weight", "features").unionByName(test.select("vec_id", F.lit(-1).alias("label4"), F.lit(0.0).alias("weight"), "features"))
    both = both.groupBy("label4", "weight", "features").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))  # equal rows are one with a number
    rows, width = both.filter("label4 >= 0").agg(F.count("*"), F.max(F.size("features"))).first()
    top = min(depth, max(0, math.ceil(math.log2(max(rows, 1) / LEAF_ROWS))))
    if top:
        upper = RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=top, seed=seed, weightCol="weight", labelCol="label4", leafCol="leaves")
        model = upper.fit(train.select("label4", "weight", array_to_vector("features").alias("features")))
        at = model.transform(both.withColumn("raw", F.col("features")).withColumn("features", array_to_vector("features"))).select("vec_id", "n", "label4", "weight", F.col("raw").alias("features"), F.transform(vector_to_array("leaves"), lambda v: v.cast("int")).alias("leaves"))
    else:
        at = both.withColumn("leaves", F.array_repeat(F.lit(0), trees))
    cuts = _cuts_of_few(both.filter("label4 >= 0")) if 0 < rows <= FEW_DIFFERENT else _cuts(train, width)
    dealt = _dealt(_binned(at, cuts), trees, width or 0, seed)
    share = [f"p{i}" for i in range(CLASSES)]

    def one(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(group))
        ids = t["ids"].combine_chunks().flatten()
        if not len(ids):
            return
        h, y, w, x, asked = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in zip(SENT, (np.uint64, np.int8, np.float64, np.uint8, np.uint8)))
        if not len(h):  # a leaf whose rows this tree's draws all missed says nothing
            yield pa.RecordBatch.from_arrays([ids, *[pa.nulls(len(ids), pa.float64())] * CLASSES], ["vec_id", *share])
            return
        order = np.argsort(h, kind="stable")
        p = grow(x.reshape(len(h), width)[order], y[order].astype(np.int64), w[order], asked.reshape(len(ids), width), depth - top, hash((seed, key[0].as_py(), key[1].as_py())) & 0x7FFFFFFF)
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(c)) for c in p.T]], ["vec_id", *share])

    context = test.sparkSession.sparkContext
    parts = min(trees << top, max(4 * context.defaultParallelism, rows * trees // (1 << 21)))  # told, since it is the work of a row and not its bytes that counts
    said = dealt.repartition(parts, "tree", "leaf").groupBy("tree", "leaf").applyInArrow(one, f"vec_id {dict(test.dtypes)['vec_id']}, " + ", ".join(f"{c} double" for c in share))
    mean = said.groupBy("vec_id").agg(*[F.avg(c).alias(c) for c in share])
    probability = F.array(*[F.coalesce(c, F.lit(1.0 / CLASSES)) for c in share])
    told = both.filter("label4 < 0").select("vec_id", "features").join(mean, "vec_id", "left").drop("vec_id")
    return test.join(told, "features", "left").select(*[c for c in test.columns if c != "features"], probability.alias("probability"))
