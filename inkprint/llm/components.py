"""Connected components by alternating stars; every table is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.session import materialize


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _ends(edges: DataFrame) -> DataFrame:
    """(u, m, below, above): each node's smallest neighbour (or itself), how many are smaller, whether any is larger."""
    return _neighbours(edges).groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"),
        F.count_if(F.col("v") < F.col("u")).alias("below"),
        F.max(F.col("v") > F.col("u")).alias("above"),
    )


def _large_star(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest neighbour (or itself)."""
    return (
        _neighbours(edges).filter("v > u")
        .join(ends.select("u", "m"), "u")
        .select(F.col("m").alias("a"), F.col("v").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them. Takes a < b."""
    least = materialize(edges.groupBy("b").agg(F.min("a").alias("m")))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return moved.filter("a < b").unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, class) for every node of ``edges`` (a, b); the class is its smallest node.

    A pair may stand in any order and be repeated; null ends and loops are left out. The
    number of rounds grows with the logarithm of the longest path. Tables that are joined
    back are written first, so that adaptive execution can split the rows of a hot node.
    """
    now = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a < b")
        .distinct()
    )
    # Done when each node has one smaller neighbour or only larger ones.
    while not (ends := materialize(_ends(now))).filter("below > 1 OR (below = 1 AND above)").isEmpty():
        now = materialize(_small_star(_large_star(now, ends)))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("class")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("class")).unionByName(roots)
