import random

import pytest

from genoloom.llm import common


@pytest.mark.parametrize("part_edges", [40, 1 << 19])
def test_components(spark, monkeypatch, part_edges):
    monkeypatch.setattr(common, "PART_EDGES", part_edges)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(-5, 2000), (2000, 2001), (7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = common.components(df).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert common.components(df.limit(0)).count() == 0
