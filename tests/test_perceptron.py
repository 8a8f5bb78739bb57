"""The perceptron's slopes are matrix products over blocks, and its model is the library's."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators import learning, perceptron

SIZES = [3, 5, 4, 4]


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(2500, 3)), rng.integers(0, 4, 2500), perceptron.first(SIZES, 2)
    loss, slope = perceptron.slopes(x, y, w, SIZES)
    for i in range(0, len(w), 7):
        a, b = w.copy(), w.copy()
        a[i] += 1e-5
        b[i] -= 1e-5
        assert abs((perceptron.slopes(x, y, a, SIZES)[0] - perceptron.slopes(x, y, b, SIZES)[0]) / 2e-5 - slope[i]) < 1e-3
    single = perceptron.slopes(x.astype(np.float32), y, w, SIZES)
    assert abs(single[0] / loss - 1) < 1e-5 and np.abs(single[1] - slope).max() < 1e-3 * np.abs(slope).max()


def test_least_of_a_narrow_valley():
    def told(w):
        return float(100 * (w[1] - w[0] ** 2) ** 2 + (1 - w[0]) ** 2), np.array([-400 * w[0] * (w[1] - w[0] ** 2) - 2 * (1 - w[0]), 200 * (w[1] - w[0] ** 2)])

    assert np.allclose(perceptron.least(told, np.array([-1.2, 1.0]), 200), 1, atol=1e-2)


@pytest.mark.parametrize("flat", [32, 1])
def test_loss_is_as_low_as_the_librarys(spark, monkeypatch, flat):
    monkeypatch.setattr(perceptron, "FLAT", flat)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in x], int((x[0] * x[1] > 0) + 2 * (x[2] > 0.3 * rng.normal()))) for i, x in enumerate(rng.normal(size=(400, 3)))]
    d = spark.createDataFrame(rows, "vec_id long, features array<double>, label4 int").withColumn("features", array_to_vector("features")).repartition(3).persist()
    model = perceptron.Perceptron(layers=SIZES, maxIter=60).fit(d)
    other = MultilayerPerceptronClassifier(layers=SIZES, maxIter=60, labelCol="label4", seed=1).fit(d)
    assert isinstance(model, MultilayerPerceptronClassificationModel)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    mine, theirs = (perceptron.slopes(x, y, m.weights.toArray(), SIZES)[0] for m in (model, other))
    assert mine < 1.1 * theirs
    told = model.transform(d).select("vec_id", "prediction").collect()
    assert np.mean([r.prediction == rows[r.vec_id][2] for r in told]) > 0.75


def test_a_fit_reads_all_rows_in_blocks(spark, monkeypatch):
    seen = []
    real = perceptron._blocks
    monkeypatch.setattr(perceptron, "_blocks", lambda d: seen.append(real(d).map(lambda b: (b[0].dtype.name, len(b[1]))).collect()) or real(d))
    d = spark.range(300, numPartitions=40).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 4).cast("double"), F.lit(1.0)).alias("features"), (F.col("id") % 4).cast("int").alias("label4"))
    monkeypatch.setitem(learning.WORK_ROWS, "mlp", 100)
    learning.fit("mlp", d)
    assert len(seen[0]) == 3 and sum(n for _, n in seen[0]) == 300 and {t for t, _ in seen[0]} == {"float32"}
