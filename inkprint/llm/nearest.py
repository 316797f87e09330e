"""Nearest vectors by counting collisions (query-aware hashing).

Each vector is projected to ``PROJECTIONS`` random directions, those of random rotations, and for
each direction a block of vectors keeps its projections as one sorted array. A query puts a window
around its own projection into every array. At radius R a vector at distance R falls into a window
with a fixed chance, so a vector that is found in ``collision_threshold`` windows or more is likely to be
that near, and only those are verified by their distance. Widening all windows to the next radius
needs no new index: the same arrays are read further to both sides (virtual rehashing).

The search of a block ends when its windows reach the distance of the k-th nearest vector verified
so far, as then all nearer ones were counted. Of vectors at just that distance ``MISSED`` are not
found; of nearer ones, fewer. When windows hold the whole block everything is verified.

Vectors stay where they are; queries come to them in blocks of a fixed number of bytes, one pass
after another, and each task returns its k best for a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.operators.distribute import with_row_number
from inkprint.session import materialize

PROJECTIONS = 128
#: Share of the vectors at the radius itself that may fall below the threshold.
MISSED = 0.01
#: How windows grow, and the first radius against the spread of a block.
GROWTH = 1.25
FIRST_RADIUS = 0.125
BLOCK_ROWS = 1 << 14
QUERY_BYTES = 4 << 20
_LOCKSTEP = 128
_SEED = 20231


def directions(dim: int, count: int) -> np.ndarray:
    """``count`` rows: random rotations, scaled so that a difference of length 1 projects to spread 1."""
    draw = np.random.default_rng(_SEED + dim)
    turned = [np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(turned)[:count] * math.sqrt(dim)


def collision_threshold(count: int, missed: float = MISSED) -> int:
    """Windows of ``count`` that a vector at the radius falls into in all but ``missed`` of cases."""
    hit = math.erf(1 / math.sqrt(2))
    below = 0.0
    for wanted in range(count + 1):
        below += math.comb(count, wanted) * hit**wanted * (1 - hit) ** (count - wanted)
        if below > missed:
            return max(1, wanted)
    return count


@dataclass
class Best:
    """The nearest vectors verified for one query, in order."""

    size: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0))
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def reach(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.size else math.inf

    def add(self, score: np.ndarray, own: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        near = score <= self.reach
        columns = [
            np.concatenate([a, b[near]])
            for a, b in ((self.score, score), (self.own, own), (self.known, known), (self.ids, ids))
        ]
        # Ties by id; a null id comes last.
        order = np.lexsort((columns[3], ~columns[2], columns[0]))[: self.size]
        self.score, self.own, self.known, self.ids = (c[order] for c in columns)


class CollisionIndex:
    """The sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, known: np.ndarray, along: np.ndarray):
        self.vectors, self.ids, self.known = vectors, ids, known
        shadows = along @ vectors.T
        order = np.argsort(shadows, axis=1, kind="stable")
        self.shadows = np.take_along_axis(shadows, order, 1)
        self.order = order.ravel()
        self.offset = np.arange(len(along)) * len(vectors)
        spread = float(np.median(self.shadows.std(axis=1)))
        self.first = FIRST_RADIUS * spread or 1.0
        self.threshold = collision_threshold(len(along))

    def _edges(self, shadows: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and direction the part of the sorted array within the radius."""
        low, high = np.empty(shadows.shape, np.int64), np.empty(shadows.shape, np.int64)
        # Projections of equal vectors are equal but for rounding.
        slack = 1e-9 * (np.abs(shadows) + radius[:, None] + 1e-300)
        left, right = shadows - radius[:, None] - slack, shadows + radius[:, None] + slack
        for j, line in enumerate(self.shadows):
            low[:, j] = np.searchsorted(line, left[:, j], "left")
            high[:, j] = np.searchsorted(line, right[:, j], "right")
        return low + self.offset, high + self.offset

    def search(self, queries: np.ndarray, query_ids: np.ndarray, shadows: np.ndarray, best: list[Best]) -> None:
        """Add to ``best`` what this block has for each query; counts of all queries go side by side."""
        n = len(self.vectors)
        if n == 0 or len(queries) == 0:
            return
        hits = np.zeros((len(queries), n), np.int32)
        seen = np.zeros((len(queries), n), bool)
        middle = np.empty(shadows.shape, np.int64)
        for j, line in enumerate(self.shadows):
            middle[:, j] = np.searchsorted(line, shadows[:, j])
        low = middle + self.offset
        high = low.copy()
        radius = np.full(len(queries), self.first)
        reach = np.array([b.reach for b in best])
        open_ = np.arange(len(queries))
        while len(open_):
            last = np.minimum(radius, reach[open_])
            new_low, new_high = self._edges(shadows[open_], last)
            full = (new_high - new_low).min(axis=1) == n
            for at, i in enumerate(open_.tolist()):
                a, b = new_low[at].tolist(), new_high[at].tolist()
                rings = [self.order[x:y] for x, y in zip(a, low[i].tolist(), strict=True) if x < y]
                rings += [self.order[x:y] for x, y in zip(high[i].tolist(), b, strict=True) if x < y]
                low[i], high[i] = np.minimum(new_low[at], low[i]), np.maximum(new_high[at], high[i])
                if not rings:
                    continue
                hits[i] += np.bincount(np.concatenate(rings), minlength=n).astype(np.int32)
                fresh = np.flatnonzero((hits[i] >= self.threshold) & ~seen[i])
                if len(fresh):
                    seen[i, fresh] = True
                    apart = self.vectors[fresh] - queries[i]
                    score = np.sqrt((apart * apart).sum(axis=1))
                    own = self.known[fresh] & (self.ids[fresh] == query_ids[i]) & (score == 0)
                    best[i].add(score, own, self.known[fresh], self.ids[fresh])
                    reach[i] = best[i].reach
            more = (last < reach[open_]) & ~full
            open_, radius = open_[more], radius[more] * GROWTH


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has finite components only, and one that is not zero."""
    number = lambda x: x.cast("double")
    finite = lambda x: F.coalesce(~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: number(x) != 0), F.lit(False))


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of components: the rows that have it, and their vectors."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    sizes = np.diff(ends, prepend=0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _searched(block, k: int, projections: int):
    """``block`` is a broadcast of (row, id, vector) arrays of queries for each number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        along = {dim: directions(dim, projections) for dim in block.value}
        shadows = {dim: vectors @ along[dim].T for dim, (_, _, vectors) in block.value.items()}
        best = {dim: [Best(k + 1) for _ in rows] for dim, (rows, _, _) in block.value.items()}
        held: dict[int, list] = {}

        def search(dim: int) -> None:
            parts = held.pop(dim)
            vectors, ids, known = (np.concatenate([p[i] for p in parts]) for i in range(3))
            _, query_ids, queries = block.value[dim]
            for first in range(0, len(vectors), BLOCK_ROWS):
                here = slice(first, first + BLOCK_ROWS)
                index = CollisionIndex(vectors[here], ids[here], known[here], along[dim])
                for begin in range(0, len(queries), _LOCKSTEP):
                    some = slice(begin, begin + _LOCKSTEP)
                    index.search(queries[some], query_ids[some], shadows[dim][some], best[dim][some])

        for batch in batches:
            known = batch["id"].is_valid().to_numpy(zero_copy_only=False)
            ids = batch["id"].fill_null(0).to_numpy(zero_copy_only=False)
            for dim, rows, vectors in _by_size(batch["vector"]):
                if dim in block.value:
                    held.setdefault(dim, []).append((vectors, ids[rows], known[rows]))
                    if sum(len(p[1]) for p in held[dim]) >= BLOCK_ROWS:
                        search(dim)
        for dim in list(held):
            search(dim)
        for dim, (rows, query_ids, _) in block.value.items():
            sizes = [len(b.score) for b in best[dim]]
            if sum(sizes) == 0:
                continue
            ids = np.concatenate([b.ids for b in best[dim]])
            known = np.concatenate([b.known for b in best[dim]])
            yield pa.record_batch(
                [
                    pa.array(np.repeat(rows, sizes)),
                    pa.array(np.repeat(query_ids, sizes)),
                    pa.array(ids, mask=~known),
                    pa.array(np.concatenate([b.score for b in best[dim]])),
                    pa.array(np.concatenate([b.own for b in best[dim]])),
                ],
                ["row", "query_id", "vec_id", "score", "own"],
            )

    return run


def nearest_vectors(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    projections: int = PROJECTIONS,
) -> DataFrame:
    """The ``k`` nearest vectors of each row that ``is_query`` holds for, by Euclidean distance.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the distance in double
    precision of the vectors as they are. Candidates are all rows but the query's own; ties go to
    the smaller id, a null id comes last. If there are fewer candidates all are returned.

    Vectors that are null, zero, empty or hold a null or non-finite component take no part; vectors
    with another number of components are no candidates. Rows may repeat: each row is a query, or a
    candidate, of its own. A row without an id is no query. Other columns are not read, and an empty
    table gives no row. Some of the nearest may be missed, see above; tests hold the recall.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(usable(F.col("vector")))
    asking = rows.filter(F.col("asks") & F.col("id").isNotNull()).select("id", "vector")
    queries = materialize(with_row_number(asking, ["id"], "row"))
    count, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    size = max(1, QUERY_BYTES // (8 * (dim or 1)))
    spark, passes = vectors.sparkSession, []
    first_row = queries.agg(F.min("row")).first()[0] or 0
    for first in range(first_row, first_row + count, size):
        taken = queries.filter(F.col("row").between(first, first + size - 1)).toArrow().combine_chunks()
        table = pa.table(taken)
        numbers, ids = table["row"].to_numpy(), table["id"].to_numpy()
        by_size = {d: (numbers[at], ids[at], v) for d, at, v in _by_size(table["vector"].combine_chunks())}
        block = spark.sparkContext.broadcast(by_size)
        found = rows.select("id", "vector").mapInArrow(
            _searched(block, k, projections), "row long, query_id long, vec_id long, score double, own boolean"
        )
        passes.append(materialize(found))
        block.destroy()
    if not passes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    of_query = Window.partitionBy("row")
    order = of_query.orderBy("score", F.asc_nulls_last("vec_id"))
    ranked = every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    # The query's own row, at distance 0, is one of those with its id; those further on move up.
    own = F.coalesce(F.min(F.when(F.col("own"), F.col("place"))).over(of_query), F.lit(k + 1))
    ranked = ranked.withColumn("at", own).filter(F.col("place") != F.col("at"))
    rank = F.col("place") - (F.col("place") > F.col("at")).cast("int")
    return ranked.select("query_id", rank.alias("rank"), "vec_id", "score")


__all__ = ["BLOCK_ROWS", "PROJECTIONS", "CollisionIndex", "collision_threshold", "nearest_vectors"]
