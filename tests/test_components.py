import random

import pytest

from siltstone.operators import components as C


def closure(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(0, i) for i in range(200, 230)]
    got = C.connected_components(spark, spark.createDataFrame(edges + edges[:9] + [(None, 3), (7, 7)], "u long, v long"))
    want = {x: c for x, c in closure([e for e in edges if e[0] != e[1]]).items()}
    rows = {r["node"]: r["component"] for r in got.collect()}
    loops = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert rows == {k: v for k, v in want.items() if k not in loops}
    assert got.count() == len(rows)


def test_components_of_no_edges(spark):
    assert C.connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0
