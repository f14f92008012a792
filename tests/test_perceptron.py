import numpy as np
from pyspark.sql import functions as F

from reportlens.operators import perceptron


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, w = rng.standard_normal((7, 3)), np.array([0, 1, 2, 0, 1, 2, 2]), rng.standard_normal(3 * 4 + 4 + 4 * 3 + 3)

    def loss(v):
        parts = perceptron.unpack(v, 3, 4, 3)
        fit = -np.log(perceptron.probabilities(x, parts)[np.arange(7), y]).mean()
        return fit + 0.3 / 14 * ((parts[0] ** 2).sum() + (parts[2] ** 2).sum())

    slope = [(loss(w + e) - loss(w - e)) / 2e-5 for e in np.eye(len(w)) * 1e-5]
    assert np.allclose(perceptron.gradient(w, x, y, 4, 3, 0.3), slope, atol=1e-7)


def test_stops_early_with_the_best_weights(spark):
    rows = spark.range(900).select("id", F.array(F.cos("id") * (1 + F.col("id") % 3), F.sin("id") * (1 + F.col("id") % 3)).alias("vec"),
                                   (F.col("id") % 3).cast("double").alias("label"))
    gaps = rows.unionByName(spark.createDataFrame([(-1, None, 0.0), (-2, [0.0, 0.0], None)], "id long, vec array<double>, label double"))
    one = perceptron.fit(gaps, 3, hidden=16, step=0.02, patience=4, epochs=60)
    assert len(one.history) <= 61 and max(one.history) >= 0.95
    assert len(one.history) == 61 or max(one.history[-4:]) <= max(one.history[:-4]) + 1e-4
    right = one.predict(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right >= 0.95
    again = perceptron.fit(rows.repartition(7), 3, hidden=16, step=0.02, patience=4, epochs=60)
    assert np.array_equal(one.weights, again.weights)
    parts = perceptron.fit(rows, 3, hidden=16, step=0.02, patience=4, epochs=20, part_rows=300)     # averaged over three tasks
    assert max(parts.history) > 0.6
