"""A support vector machine with a Gaussian kernel by random features, which are made anew in each round and never kept; all labels at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasMaxIter, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import CLASSES
from .perceptron import FLAT, STEP, _blocks, least


def directions(width: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of ``size`` cosines whose inner products near exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2 * gamma), size=(width, size)).astype(np.float32), rng.uniform(0, 2 * np.pi, size).astype(np.float32)


def cosines(x: np.ndarray, drawn: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    z = x.astype(np.float32) @ drawn[0]
    z += drawn[1]
    np.cos(z, out=z)
    z *= np.float32(np.sqrt(2 / len(drawn[1])))
    return z


def spread(x: np.ndarray, drawn: tuple) -> np.ndarray:
    """Sums and sums of squares of the cosines."""
    out = np.zeros((2, len(drawn[1])))
    for i in range(0, len(x), STEP):
        z = cosines(x[i : i + STEP], drawn)
        out += [z.sum(0, dtype=float), (z * z).sum(0, dtype=float)]
    return out


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, labels: list[int], drawn: tuple) -> tuple[float, np.ndarray]:
    """Sums over rows and labels of the hinge loss of one label against the rest, and of its slopes by ``w``: for each label weights of the cosines and one of 1."""
    loss, out, single = 0.0, np.zeros(w.shape), w.astype(np.float32)
    for i in range(0, len(x), STEP):
        z = cosines(x[i : i + STEP], drawn)
        sign = np.where(y[i : i + STEP, None] == np.array(labels), np.float32(1), np.float32(-1))
        short = 1 - sign * (z @ single[:, :-1].T + single[:, -1])
        loss += float(short[short > 0].sum(dtype=float))
        pull = np.where(short > 0, -sign, np.float32(0))
        out[:, :-1] += pull.T @ z
        out[:, -1] += pull.sum(0)
    return loss, out


class KernelModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """probability (vector): the logistic value of each label's margin, scaled to a sum of 1; a label that training lacks has 0."""

    held = Param(Params._dummy(), "held", "width, size, gamma, seed, labels and weights, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, held: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = json.loads(self.getOrDefault(self.held))
        labels, w = told["labels"], np.array(told["weights"])

        @F.pandas_udf("array<double>")
        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            drawn = directions(told["width"], told["size"], told["gamma"], told["seed"])
            for x in batches:
                if not len(x):
                    yield x
                    continue
                p = np.zeros((len(x), CLASSES))
                p[:, labels] = 1 / (1 + np.exp(-(cosines(np.stack(x.to_numpy()), drawn) @ w[:, :-1].T + w[:, -1])))
                yield pd.Series(list(p / np.maximum(p.sum(1), 1e-12)[:, None]))

        return dataset.withColumn("probability", array_to_vector(shares(vector_to_array("features"))))


class KernelMachine(Estimator, HasMaxIter, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """For each label of features and label4 a linear machine against the rest on ``size`` cosines: mean hinge loss and ``regParam`` / 2 times the square of the
    weights of the cosines in units of their deviation, as MLlib's machine on standardised features. A round is a job over blocks of the features themselves, in which
    a part makes the cosines of some rows at a time for all labels, and sends one sum as large as the weights."""

    size = Param(Params._dummy(), "size", "number of cosines", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel exp(-gamma |x - y|^2)", TypeConverters.toFloat)
    regParam = Param(Params._dummy(), "regParam", "what the weights' square counts", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, size: int = 1024, gamma: float = 1.0, regParam: float = 0.0, maxIter: int = 100, seed: int = 42):
        super().__init__()
        self._setDefault(size=1024, gamma=1.0, regParam=0.0, maxIter=100, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KernelModel:
        size, gamma, penalty, rounds, seed = (self.getOrDefault(p) for p in (self.size, self.gamma, self.regParam, self.maxIter, self.seed))
        context = dataset.sparkSession.sparkContext
        blocks = _blocks(dataset).persist()
        many = blocks.getNumPartitions() > FLAT

        def add(a: tuple, b: tuple) -> tuple:
            return tuple(x + y for x, y in zip(a, b))

        try:
            seen = blocks.map(lambda b: (len(b[1]), b[0].shape[1], sorted(set(b[1].tolist())))).collect()  # three numbers and the labels of each part
            rows, width, labels = sum(s[0] for s in seen), max((s[1] for s in seen), default=0), sorted({v for s in seen for v in s[2]})
            shape = (len(labels), size + 1)
            drawn = context.broadcast(directions(width, size, gamma, seed))

            def summed(said) -> tuple:
                return said.treeReduce(add) if many else said.reduce(add)

            total, square = summed(blocks.map(lambda b: tuple(spread(b[0], drawn.value)))) if rows else np.zeros((2, size))
            deviation = np.sqrt(np.maximum(square - total**2 / max(rows, 1), 0) / max(rows - 1, 1))
            scale = np.append(np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0), 1.0)

            def told(v: np.ndarray) -> tuple[float, np.ndarray]:
                v = v.reshape(shape)
                sent = context.broadcast(v * scale)
                loss, slope = summed(blocks.map(lambda b: slopes(*b, sent.value, labels, drawn.value)))
                sent.unpersist()
                free = np.append(v[:, :-1], np.zeros((len(v), 1)), axis=1)
                return loss / rows + penalty / 2 * float((free**2).sum()), (slope / rows * scale + penalty * free).ravel()

            w = least(told, np.zeros(shape).ravel(), rounds).reshape(shape) * scale if rows else np.zeros(shape)
        finally:
            blocks.unpersist()
        return KernelModel(held=json.dumps({"width": width, "size": size, "gamma": gamma, "seed": seed, "labels": labels, "weights": w.tolist()}))
