"""Boosted trees, for each label one model against the rest, from sums by bin of the rows' residuals."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import BINS, CLASSES, _binned, _cuts

#: Rows up to which a label's trees are grown by one task, and the fewest and most rows of a block beyond.
ONE_TASK, FEW_ROWS, BLOCK_ROWS = 65_536, 8_192, 262_144
#: Rounds after which the rows' margins are kept.
KEPT = 5
#: Sums are of multiples of this, so that they are exact and the same in any order.
GRAIN = 2.0**-20


def _grained(x: np.ndarray) -> np.ndarray:
    return np.round(x / GRAIN) * GRAIN


def leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` of each row, counted from the left. Nodes lie level by level; what is above a node's cut goes right."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node - ((1 << depth) - 1)


def margins(x: np.ndarray, trees: list[tuple], depth: int) -> np.ndarray:
    """Sums over rounds for each row and label. A round: features, cuts and values of the trees of all labels."""
    out = np.zeros((len(x), len(trees[0][0]) if trees else 1))
    for feature, cut, value in trees:
        for k in range(len(feature)):
            out[:, k] += value[k][leaves(x, feature[k], cut[k], depth)]
    return out


def counts(block: tuple, labels: list[int], trees: list[tuple], level: int, feature: np.ndarray, cut: np.ndarray, depth: int, first: bool) -> np.ndarray:
    """Sums of weights and of weighted residuals (first axis) by label, feature, and node and bin."""
    x, y, w, m = block
    m = m + margins(x, trees, depth)
    nodes = 1 << level
    sums = np.empty((2, len(labels), x.shape[1], nodes * BINS))
    columns = np.ascontiguousarray(x.T)
    for i, k in enumerate(labels):
        sign = np.where(y == k, 1.0, -1.0)
        r = _grained(w * (sign if first else 4 * sign / (1 + np.exp(2 * sign * m[:, i]))))  # the first tree fits the signs themselves
        at = leaves(x, feature[i], cut[i], level) * BINS
        for j, c in enumerate(columns):
            key = at + c
            sums[0, i, j] = np.bincount(key, w, nodes * BINS)
            sums[1, i, j] = np.bincount(key, r, nodes * BINS)
    return sums


def best(sums: np.ndarray, features: np.ndarray) -> np.ndarray:
    """For each label and node: gain, feature, cut, the means left and right, and the node's own; no gain if it can't be parted."""
    w, r = sums.reshape(*sums.shape[:3], -1, BINS).cumsum(-1)
    low, high = w[..., :-1], w[..., -1:] - w[..., :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = r[..., :-1] ** 2 / low + (r[..., -1:] - r[..., :-1]) ** 2 / high
        gain = np.where((low > 0) & (high > 0), gain, -np.inf)
        cut = gain.argmax(-1)
        top = np.take_along_axis(gain, cut[..., None], -1)[..., 0]
        f = top.argmax(1)
        pick = lambda v: np.take_along_axis(v, f[:, None], 1)[:, 0]
        at = pick(cut)
        part = lambda v: np.take_along_axis(np.take_along_axis(v, f[:, None, :, None], 1)[:, 0], at[..., None], -1)[..., 0]
        lw, lr, tw, tr = part(w), part(r), w[:, 0, :, -1], r[:, 0, :, -1]
        own = np.where(tw > 0, tr / tw, 0.0)
        return np.stack([np.where(pick(top) > -np.inf, pick(top) - tr * own, 0.0), features[f], at, np.where(lw > 0, lr / lw, 0.0), np.where(tw > lw, (tr - lr) / (tw - lw), 0.0), own])


def grow(splits: Callable, keep: Callable, labels: list[int], rounds: int, depth: int, step: float) -> list[tuple]:
    """The rounds: ``splits`` tells what ``best`` does of a level under the trees that ``keep`` wasn't given yet, ``keep`` adds trees to the rows' margins."""
    inner = (1 << depth) - 1
    trees, since = [], 0
    for t in range(rounds):
        feature, cut = np.zeros((len(labels), inner), np.int64), np.full((len(labels), inner), BINS, np.int64)
        mean = np.zeros((len(labels), 2 * inner + 1))
        for level in range(depth):
            gain, f, c, left, right, own = splits(labels, trees[since:], level, feature, cut, depth, t == 0)
            at = (1 << level) - 1 + np.arange(1 << level)
            parted = gain > 1e-9
            feature[:, at], cut[:, at] = np.where(parted, f, 0), np.where(parted, c, BINS)
            mean[:, 2 * at + 1], mean[:, 2 * at + 2] = np.where(parted, left, own), np.where(parted, right, 0.0)
        trees.append((feature, cut, mean[:, inner:] * (step if t else 1.0)))
        if len(trees) - since == KEPT and t + 1 < rounds:
            keep(trees[since:], depth)
            since = len(trees)
    return trees


def _alone(block: tuple, label: int, rounds: int, depth: int, step: float) -> list[tuple]:
    """The trees of one label from one block."""
    held = [block]

    def splits(*how) -> np.ndarray:
        return best(counts(held[0], *how), np.arange(block[0].shape[1]))

    def keep(trees: list[tuple], depth: int) -> None:
        held[0] = _kept(held[0], trees, depth)

    return grow(splits, keep, [label], rounds, depth, step)


def _kept(block: tuple, trees: list[tuple], depth: int) -> tuple:
    return (*block[:3], block[3] + margins(block[0], trees, depth))


def _spread(blocks: RDD, labels: list[int], width: int, rounds: int, depth: int, step: float) -> list[tuple]:
    """The trees of all labels from many blocks: a job a level, which adds up the blocks' sums and chooses among some features in each task."""
    held = [blocks.persist()]
    chunks = [c for c in np.array_split(np.arange(width), blocks.getNumPartitions()) if len(c)]

    def splits(*how) -> np.ndarray:
        def some(block: tuple) -> Iterator[tuple[int, np.ndarray]]:
            sums = counts(block, *how)
            return ((i, sums[:, :, c]) for i, c in enumerate(chunks))

        said = held[0].flatMap(some).reduceByKey(np.add, len(chunks)).map(lambda x: (x[0], best(x[1], chunks[x[0]]))).collect()
        told = np.stack([v for _, v in sorted(said, key=lambda x: x[0])])
        return np.take_along_axis(told, told[:, :1].argmax(0)[None], 0)[0]  # of equal gains the least feature's

    def keep(trees: list[tuple], depth: int) -> None:
        new = held[0].map(lambda b: _kept(b, trees, depth)).persist()
        new.count()
        held.pop().unpersist()
        held.append(new)

    try:
        return grow(splits, keep, labels, rounds, depth, step)
    finally:
        held[0].unpersist()


def _blocks(train: DataFrame, cuts: list[np.ndarray], parts: int) -> RDD:
    """One block of bins, labels, weights and margins for each part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("label4", pa.int32()), ("weight", pa.float64()), ("bins", pa.binary())]))
        if len(t):
            packed = [b"".join(t["bins"].to_pylist()), t["label4"].to_numpy().astype(np.int8).tobytes(), _grained(t["weight"].to_numpy()).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.large_binary()) for v in packed], ["x", "y", "w"])

    def unpack(r) -> tuple:
        y = np.frombuffer(r["y"], np.int8)
        return np.frombuffer(r["x"], np.uint8).reshape(len(y), len(cuts)), y, np.frombuffer(r["w"]), np.zeros((len(y), 1))

    rows = _binned(train.repartition(parts), cuts).select("label4", "weight", "bins")
    return rows.mapInArrow(pack, "x binary, y binary, w binary").rdd.map(unpack)


class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """probability (vector): the logistic value of twice each label's margin, scaled to a sum of 1; a label that training lacks has 0."""

    trees = Param(Params._dummy(), "trees", "depth, labels, and by round and label features, thresholds and values, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = json.loads(self.getOrDefault(self.trees))
        depth, labels = told["depth"], told["labels"]
        rounds = [(np.array(f, int), np.array(c, float), np.array(v, float)) for f, c, v in told["rounds"]]

        @F.pandas_udf("array<double>")
        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                if not len(x):
                    yield x
                    continue
                p = np.zeros((len(x), CLASSES))
                p[:, labels] = 1 / (1 + np.exp(-2 * margins(np.stack(x.to_numpy()), rounds, depth)))
                yield pd.Series(list(p / np.maximum(p.sum(1), 1e-12)[:, None]))

        return dataset.withColumn("probability", array_to_vector(shares(vector_to_array("features"))))


class Boosted(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Trees of ``depth`` for each label against the rest by log loss, as MLlib's gradient-boosted trees: a tree fits the residuals by squared error,
    the first one the signs; the others count ``step``. Up to ``ONE_TASK`` rows a label is a task. Of more the rows stay where they are: a job adds up sums
    by bin for all nodes of a level of all labels, tasks choose the splits of some features each, and the driver holds the trees, whose size is fixed by
    rounds and depth."""

    rounds = Param(Params._dummy(), "rounds", "trees of a label", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "of a tree", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "what a later tree counts", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, rounds: int = 100, depth: int = 6, step: float = 0.3):
        super().__init__()
        self._setDefault(rounds=100, depth=6, step=0.3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        rounds, depth, step = (self.getOrDefault(p) for p in (self.rounds, self.depth, self.step))
        train = dataset.select(F.col("label4").cast("int").alias("label4"), F.col("weight").cast("double").alias("weight"), vector_to_array("features").alias("features"))
        rows, width, labels = train.agg(F.count("*"), F.max(F.size("features")), F.sort_array(F.collect_set("label4"))).first()
        trees: list[tuple] = []
        cuts = _cuts(train, width) if rows else []
        if rows and rows <= ONE_TASK:
            alone = _blocks(train, cuts, 1).flatMap(lambda b: [(i, (k, b)) for i, k in enumerate(labels)]).partitionBy(len(labels), int)
            found = sorted(alone.map(lambda x: (x[0], _alone(x[1][1], x[1][0], rounds, depth, step))).collect(), key=lambda x: x[0])
            trees = [tuple(np.concatenate(parts) for parts in zip(*each)) for each in zip(*(t for _, t in found))]
        elif rows:
            parts = max(min(dataset.sparkSession.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)), -(-rows // BLOCK_ROWS))
            trees = _spread(_blocks(train, cuts, parts), labels, width, rounds, depth, step)
        raw = []
        for feature, cut, value in trees:
            limits = [[float(cuts[f][c]) if c < len(cuts[f]) else float("inf") for f, c in zip(fs, cs)] for fs, cs in zip(feature.tolist(), cut.tolist())]
            raw.append((feature.tolist(), limits, value.tolist()))
        return BoostedModel(trees=json.dumps({"depth": depth, "labels": labels, "rounds": raw}))
