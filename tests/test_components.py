import random

from loam.operators.components import connected_components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_against_union_find(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, k) for k in range(400, 460)] + [(7, 7), (999, 999)]
    df = spark.createDataFrame([(a, b, 0) for a, b in edges] + [(None, 3, 0)] + [(1000, 1001, 1)], "src BIGINT, dst BIGINT, component INT")
    assert {r.node: r.component for r in connected_components(df).collect()} == plain(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src STRING, dst STRING")).count() == 0
