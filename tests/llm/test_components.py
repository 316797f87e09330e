import random

from inkprint.llm.components import components


def test_against_union_find(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(400, 440)]  # a long path
    edges += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = {r["node"]: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
