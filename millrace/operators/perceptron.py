"""A multilayer perceptron fitted by L-BFGS, whose slopes are matrix products in single precision over blocks of rows; the model is MLlib's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasMaxIter, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

#: Rows that are multiplied at a time, and sums of blocks beyond which they are added up in a tree.
STEP, FLAT = 1024, 32
#: Steps that the curvature is told from, and the share of the first loss below which ten rounds' gain ends a fit: MLlib's own.
KEPT, LEAST = 10, 1e-6


def _layers(w: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights (inputs x outputs) and biases of each layer, in MLlib's order."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def first(sizes: list[int], seed: int) -> np.ndarray:
    """Weights to begin with, even within 2.4 / sqrt(inputs), as MLlib draws them."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, a * b + b) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])])


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
    """Sums over the rows of the loss (cross entropy of a softmax above sigmoids) and of its slopes by ``w``."""
    layers = _layers(w.astype(x.dtype), sizes)
    loss, out = 0.0, np.zeros(len(w))
    sums = _layers(out, sizes)
    for i in range(0, len(x), STEP):
        seen = [x[i : i + STEP]]
        for k, (weight, bias) in enumerate(layers):
            z = seen[-1] @ weight
            z += bias
            if k + 1 < len(layers):
                np.clip(z, -80, 80, out=z)
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                seen.append(z)
        z = z.astype(float)
        z -= z.max(1, keepdims=True)
        p, of = np.exp(z), (np.arange(len(z)), y[i : i + STEP])
        total = p.sum(1)
        loss += float((np.log(total) - z[of]).sum())
        p /= total[:, None]
        p[of] -= 1
        back = p.astype(x.dtype)
        for k in range(len(layers) - 1, -1, -1):
            sums[k][0][...] += seen[k].T @ back
            sums[k][1][...] += back.sum(0)
            if k:
                back = back @ layers[k][0].T
                back *= seen[k]
                back *= 1 - seen[k]
    return loss, out


def least(told: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int) -> np.ndarray:
    """Where ``told`` (value and slopes) is least, by L-BFGS from ``w`` with steps by the weak Wolfe conditions."""
    value, slope = told(w)
    values, kept = [value], []
    for _ in range(rounds):
        if np.linalg.norm(slope) <= max(LEAST * abs(value), 1e-8):
            break
        way, weights = -slope, []
        for s, y in reversed(kept):
            weights.append((s @ way) / (s @ y))
            way = way - weights[-1] * y
        if kept:
            s, y = kept[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(kept, reversed(weights)):
            way = way + (a - (y @ way) / (s @ y)) * s
        fall = float(way @ slope)
        if fall >= 0:  # the curvature misleads
            kept, way, fall = [], -slope, -float(slope @ slope)
        step, low, high = 1.0 if kept else 1 / max(np.sqrt(-fall), 1e-300), 0.0, np.inf
        for _ in range(30):
            v, g = told(w + step * way)
            if not v <= value + 1e-4 * step * fall:
                high = step
            elif float(g @ way) < 0.9 * fall:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        if not v < value:
            break
        kept = [*kept, (step * way, g - slope)][-KEPT:] if (g - slope) @ way > 0 else kept
        w, value, slope = w + step * way, v, g
        values = [*values, value]
        if max(values[-KEPT - 1 :]) - value <= LEAST * abs(values[0]):
            break
    return w


def _blocks(train: DataFrame) -> RDD:
    """One block of features and labels for each part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for b in batches:
            x.append(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32).tobytes())
            y.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int8).tobytes())
        if any(y):
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(v)], pa.large_binary()) for v in (x, y)], ["x", "y"])

    def unpack(r) -> tuple[np.ndarray, np.ndarray]:
        y = np.frombuffer(r["y"], np.int8)
        return np.frombuffer(r["x"], np.float32).reshape(len(y), -1), y

    return train.select(vector_to_array("features", "float32").alias("x"), train["label4"].cast("int").alias("y")).mapInArrow(pack, "x binary, y binary").rdd.map(unpack)


class Perceptron(Estimator, HasMaxIter, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Sigmoid layers and a softmax, as MLlib's, over features and label4; the fitted model is MLlib's and holds the weights.

    A round is a job over the blocks of all rows, in which a part sends one sum as large as the weights. Products are taken in single precision and sums over
    rows kept in double, which MLlib's fit takes four times as long for."""

    layers = Param(Params._dummy(), "layers", "sizes from inputs to outputs", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, layers: list[int] | None = None, maxIter: int = 200, seed: int = 42):
        super().__init__()
        self._setDefault(maxIter=200, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        sizes, rounds, seed = (self.getOrDefault(p) for p in (self.layers, self.maxIter, self.seed))
        context = dataset.sparkSession.sparkContext
        blocks = _blocks(dataset).persist()

        def add(a: tuple, b: tuple) -> tuple:
            return a[0] + b[0], a[1] + b[1]

        try:
            rows = blocks.map(lambda b: len(b[1])).sum()

            def told(w: np.ndarray) -> tuple[float, np.ndarray]:
                sent = context.broadcast(w)
                sums = blocks.map(lambda b: slopes(*b, sent.value, sizes))
                loss, slope = sums.reduce(add) if blocks.getNumPartitions() <= FLAT else sums.treeReduce(add)
                sent.unpersist()
                return loss / rows, slope / rows

            w = least(told, first(sizes, seed), rounds)
        finally:
            blocks.unpersist()
        held = MultilayerPerceptronClassifier(layers=sizes, maxIter=0, labelCol="label4", initialWeights=Vectors.dense(w))  # takes the weights as they are
        return held.fit(dataset.limit(1))
