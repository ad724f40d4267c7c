import numpy as np

from tessera.operators import models


def test_kmeans_trains_on_all_rows(spark):
    """More than 256 rows a centroid: without a bound all of them count."""
    x = np.random.default_rng(1).normal(size=(700, 3))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    c, _ = models.kmeans(table, 2, 1, start=x[:2], max_points=None)
    near = ((x[:, None] - x[None, :2]) ** 2).sum(2).argmin(1)
    assert np.allclose(c, [x[near == i].mean(0) for i in range(2)], atol=1e-12)
