"""Cutting a dataset: stratified shares, equal parts, the head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.patterns import VALIDATION_SHARE
from inkprint.operators.distribute import lookup, with_row_number
from inkprint.session import materialize

BUCKET_BITS = 12
BUCKET_ROWS = 50_000


def draw_key(key: str = "id", seed: int = 0) -> Column:
    """A hash that orders ids at random, the same way in every run."""
    return F.xxhash64(F.col(key), F.lit(seed))


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "id",
    share: float = VALIDATION_SHARE,
    seed: int = 0,
    draw: Column | None = None,
    draw_bits: int = 64,
) -> DataFrame:
    """Add ``is_valid``: the first ``ceil(share * n)`` rows of each label by draw order.

    Exact, and no label is sorted as a whole. A histogram over draw buckets, which hold
    about ``BUCKET_ROWS`` rows whatever the size of the table, tells the
    bucket in which each label's cut lies; only that bucket is ranked, by counts of
    equal (draw, id). What remains is one cut per label, and comparing rows with it
    needs no shuffle. Rows with equal ids stay on one side; rows without a label are
    never drawn.
    """
    draw = draw_key(key, seed) if draw is None else draw
    bits = min(draw_bits, max(BUCKET_BITS, (df.count() // BUCKET_ROWS).bit_length()))
    bucket = F.shiftright(F.col("_draw"), draw_bits - bits)
    drawn = df.withColumn("_draw", draw).withColumn("_bucket", bucket)

    strata = drawn.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_label = Window.partitionBy(label)
    running = by_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    reached = strata.select(
        label,
        "_bucket",
        F.ceil(F.sum("_n").over(by_label) * F.lit(share)).alias("_wanted"),
        F.sum("_n").over(running).alias("_up_to"),
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
    )
    cut_bucket = materialize(
        reached.filter("_before < _wanted AND _up_to >= _wanted").select(
            label, "_bucket", (F.col("_wanted") - F.col("_before")).alias("_left")
        )
    )

    near_cut = lookup(drawn, cut_bucket, [label, "_bucket"], spread_by=[key], how="inner")
    tied = near_cut.groupBy(label, "_left", "_draw", F.col(key).alias("_id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    in_order = by_label.orderBy("_draw", "_id").rowsBetween(Window.unboundedPreceding, 0)
    cuts = materialize(
        tied.withColumn("_up_to", F.sum("_n").over(in_order))
        .filter("_up_to >= _left AND _up_to - _n < _left")
        .select(label, F.struct("_draw", "_id").alias("_cut"))
    )
    position = F.struct(F.col("_draw"), F.col(key).alias("_id"))
    return (
        lookup(drawn, cuts, [label], spread_by=[key])
        .withColumn("is_valid", F.coalesce(position <= F.col("_cut"), F.lit(False)))
        .drop("_draw", "_bucket", "_cut")
    )


def train_valid(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The two sides of :func:`stratified_split`."""
    marked = stratified_split(df, **options)
    return (
        marked.filter(~F.col("is_valid")).drop("is_valid"),
        marked.filter("is_valid").drop("is_valid"),
    )


def equal_parts(df: DataFrame, size: int, key: str = "id") -> DataFrame:
    """Add ``part``: rows in key order, ``size`` per part."""
    numbered = with_row_number(df, [key], "_row")
    return numbered.withColumn("part", F.floor(F.col("_row") / size)).drop("_row")


def head(df: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The first ``limit`` rows in key order."""
    return df.orderBy(key).limit(limit)
