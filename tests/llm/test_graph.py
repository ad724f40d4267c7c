import random

from tessera.llm._graph import components
from tessera.llm._session import Kept, prepare


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(-40, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(260)] + [(7, 7), (5000, 4000), (4000, 5000)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    rows = components(prepare(spark).createDataFrame(edges, "u long, v long"), Kept(spark)).collect()
    assert {(r.node, r.root) for r in rows} == {(x, find(x)) for x in up} and len(rows) == len(up)
    assert components(spark.createDataFrame([], "u long, v long"), Kept(spark)).collect() == []
