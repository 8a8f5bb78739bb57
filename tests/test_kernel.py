"""A kernel machine makes its cosines anew in each round and keeps none."""

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators import kernel


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, drawn = rng.normal(size=(1500, 3)).astype(np.float32), rng.integers(0, 4, 1500), kernel.directions(3, 8, 0.5, 3)
    z, w, labels = kernel.cosines(x, drawn).astype(float), rng.normal(size=(3, 9)), [0, 1, 3]
    sign = np.where(y[:, None] == np.array(labels), 1, -1)
    short = 1 - sign * (z @ w[:, :-1].T + w[:, -1])
    loss, slope = kernel.slopes(x, y, w, labels, drawn)
    assert abs(loss / np.maximum(short, 0).sum() - 1) < 1e-5
    pull = np.where(short > 0, -sign, 0)
    assert np.allclose(slope, np.c_[pull.T @ z, pull.sum(0)], atol=1e-2)
    assert np.allclose(kernel.spread(x, drawn), [z.sum(0), (z * z).sum(0)], rtol=1e-3, atol=1e-2)


def test_loss_is_as_low_as_the_librarys_and_no_cosine_is_kept(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in x], int(x[0] * x[1] > 0)) for i, x in enumerate(rng.normal(size=(300, 2)))]
    d = spark.createDataFrame(rows, "vec_id long, features array<double>, label4 int").withColumn("features", array_to_vector("features")).repartition(3).persist()
    d.count()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = kernel.KernelMachine(size=40, gamma=0.5, regParam=0.01, maxIter=100).fit(d)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    z = kernel.cosines(x, kernel.directions(2, 40, 0.5, 42)).astype(float)
    sign, deviation = np.where(y == 1, 1, -1), z.std(0, ddof=1)

    def loss(w, b):
        return np.maximum(0, 1 - sign * (z @ w + b)).mean() + 0.005 * ((w * deviation) ** 2).sum()

    import json

    told = json.loads(model.getOrDefault(model.held))
    mine = loss(np.array(told["weights"][1][:-1]), told["weights"][1][-1])
    flat = spark.createDataFrame([(v.tolist(), float(k)) for v, k in zip(z, y)], "features array<double>, label double").withColumn("features", array_to_vector("features"))
    other = LinearSVC(regParam=0.01, maxIter=100).fit(flat)
    assert mine < 1.03 * loss(other.coefficients.toArray(), other.intercept)
    p = model.transform(d).select("label4", F.udf(lambda v: float(v[1]), "double")("probability").alias("p")).collect()
    assert np.mean([(r.p > 0.5) == (r.label4 == 1) for r in p]) > 0.9
