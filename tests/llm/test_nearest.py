import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.llm import nearest
from inkprint.llm.nearest import CollisionIndex, Best, collision_threshold, directions, nearest_vectors
from inkprint.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, extra string, score double, own boolean"


def make(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.0, True) for i, v in rows], SCHEMA)


def distance(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, asks, k):
    """For each query row (query, rank, id, distance), by all distances."""
    single = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    out = []
    for n, (q, a) in enumerate(single):
        if q is None or not asks(q) or not good(a):
            continue
        others = [
            (distance(a, b), i is None, i or 0)
            for m, (i, b) in enumerate(single)
            if m != n and good(b) and len(b) == len(a)
        ]
        out += [(q, r, None if null else i, d) for r, (d, null, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=str)


def result(df, asks, k):
    return sorted((tuple(r) for r in nearest_vectors(df, asks, k).collect()), key=str)


def same(found, expected):
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(found, expected, strict=True))


def test_few_vectors_are_all_found(spark):
    draw = random.Random(1)
    point = lambda d=8: [draw.gauss(0, 1) for _ in range(d)]
    hot = point()
    rows = [(i, hot) for i in range(0, 60)]  # ties go to the smaller id
    rows += [(100 + i, point()) for i in range(40)] + [(200 + i, point(5)) for i in range(7)]
    rows += [(300, None), (310, [0.0] * 8), (320, [float("nan")] + point(7)), (330, [float("inf")] + point(7))]
    rows += [(340, [None] + point(7)), (350, []), (None, hot), (None, point()), (20, hot), (110, rows[70][1])]
    same(result(make(spark, rows), F.col("vec_id") % 10 == 0, 10), brute(rows, lambda i: i % 10 == 0, 10))
    same(result(make(spark, rows), F.col("vec_id") == 105, 500), brute(rows, lambda i: i == 105, 500))


def test_no_vectors(spark):
    assert nearest_vectors(make(spark, []), F.col("vec_id") == 0).collect() == []
    assert nearest_vectors(make(spark, [(0, None), (1, [1.0])]), F.col("vec_id") == 0).collect() == []
    assert nearest_vectors(make(spark, [(0, [1.0])]), F.col("vec_id") == 0).collect() == []


def test_blocks_of_queries_and_of_vectors(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.standard_normal((900, 6)).astype(np.float32))]
    asks = F.col("vec_id") % 3 == 0
    whole = result(make(spark, rows), asks, 10)
    monkeypatch.setattr(nearest, "QUERY_BYTES", 8 * 6 * 70)
    parts = result(make(spark, rows).repartition(3), asks, 10)
    expected = brute(rows, lambda i: i % 3 == 0, 10)
    for found in (whole, parts):
        assert len(set(r[:2] + r[2:3] for r in found) & set(r[:3] for r in expected)) >= 0.97 * len(expected)


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(clustered):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((6000, 64))
    if clustered:
        vectors = draw.standard_normal((60, 64))[draw.integers(0, 60, 6000)] + 0.1 * vectors
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    along = directions(64, nearest.PROJECTIONS)
    index = CollisionIndex(vectors, np.arange(6000), np.ones(6000, bool), along)
    queries = vectors[::100]
    best = [Best(11) for _ in queries]
    index.search(queries, np.arange(0, 6000, 100), queries @ along.T, best)
    hits = 0
    for n, b in enumerate(best):
        true = np.argsort(((vectors - queries[n]) ** 2).sum(axis=1))[:11]
        assert b.ids[0] == n * 100 and b.own.tolist() == [True] + [False] * 10
        hits += len(set(true.tolist()) & set(b.ids.tolist())) - 1
    assert hits >= 0.97 * 10 * len(queries)


def test_threshold():
    hit = math.erf(1 / math.sqrt(2))
    draw = np.random.default_rng(4).binomial(128, hit, 100_000)
    wanted = collision_threshold(128)
    assert (draw < wanted).mean() <= 0.012 and (draw < wanted + 1).mean() >= 0.008
    turned = directions(16, 40)
    assert np.allclose(turned[:16] @ turned[:16].T, 16 * np.eye(16))


def test_query(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.1")
    rows = QUERIES["op12_nearest_vectors"](spark, larger).collect()
    table = spark.read.parquet(f"{larger}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert all(abs(d[ids == i][0] - s) < 1e-12 for _, i, s in got)
        assert [(s, i) for _, i, s in got] == sorted((s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & set(ids[order].tolist()))
    assert hits >= 0.95 * 10 * len(found)
