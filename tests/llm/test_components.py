import random

from loam.llm.components import components


def test_components_equal_union_find(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)]  # a chain and a star
    edges += [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(5, 5), (100, 101)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {x for x in up if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: top(x) for x in up if x not in alone}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
