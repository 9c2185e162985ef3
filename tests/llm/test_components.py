"""Components against union-find."""

import random

from tessera.llm.components import components


def test_random_graphs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(-5, 9), (7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(3)
    assert {r["node"]: r["comp"] for r in components(df).collect()} == {x: find(x) for x in list(up)}
    assert components(df.limit(0)).count() == 0
