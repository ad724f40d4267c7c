import numpy as np
import pytest

from tessera.operators import knn


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("kind", ["ties", "one value", "few", "rounding"])
def test_one_dimension(spark, kind, exclude):
    rng = np.random.default_rng(2)
    x = {"ties": rng.integers(-30, 30, 400) / 2, "one value": np.ones(50), "few": np.array([3.0, 1.0]), "rounding": np.concatenate([1e16 + np.arange(0, 60, 2), [0.0, 0.1, 0.2]])}[kind]
    rows = [(i, float(v)) for i, v in enumerate(x[rng.permutation(len(x))])]
    table = spark.createDataFrame([*rows, (900, None), (905, float("nan"))], "id long, x double")
    got = knn.one_dimension_knn(table.where("id % 5 = 0"), table, 3, exclude)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()  # no pairs of blocks and shards
    want = [(q, n + 1, i, d) for q, v in rows if q % 5 == 0 for n, (d, i) in enumerate(sorted((abs(v - w), i) for i, w in rows if not exclude or i != q)[:3])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
