"""Bringing rows and files together by id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows that have an id, the id first and as a whole number."""
    others = [F.col(f"`{c}`") for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), *others)


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_by_id(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join: ids on one side only are dropped, repeated ids multiply."""
    return left.join(right, list(keys), "inner")


def combine_by_id(frames: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """One row per id with the columns of all frames.

    Where frames share a column, the last frame that has the id decides, also with a
    null. One grouping by id does it, whatever the number of frames.
    """
    numbered = [
        f.filter(F.col(key).isNotNull()).withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)
    ]
    columns = list(dict.fromkeys(c for f in frames for c in f.columns if c != key))

    def latest(column: str):
        having = [i for i, f in enumerate(frames) if column in f.columns]
        at = F.when(F.col("_frame").isin(having), F.col("_frame"))
        return F.max_by(F.col(f"`{column}`"), at).alias(column)

    return concat_rows(numbered).groupBy(key).agg(*[latest(c) for c in columns])


def combine_long(frames: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """As :func:`combine_by_id` for (id, feature, value) rows."""
    numbered = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    return (
        concat_rows(numbered)
        .filter(F.col(key).isNotNull())
        .groupBy(key, "feature")
        .agg(F.max_by("value", "_frame").alias("value"))
    )


def nest_features(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, features): all other columns as one record."""
    names = [F.col(f"`{c}`") for c in df.columns if c != key]
    return df.select(key, F.struct(*names).alias("features"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
