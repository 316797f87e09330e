"""How rows meet: size-checked lookups, row numbers without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from inkprint.session import materialize

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 4096


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    Only for plain scans: a few small files would otherwise leave cores idle. A
    scan that already has enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a table (one aggregate, one row back) against the broadcast bound."""
    width = F.lit(0).cast("long")
    for field in table.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(field.dataType, T.ArrayType):
            width = width + F.coalesce(F.size(column), F.lit(0)) * 8 + 8
        else:
            width = width + 8
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join many rows with a table that is unique on ``on``.

    The table is broadcast when its measured size is within the bound. Beyond it both sides
    are shuffled. Keys that more than one row in ``HOT_SHARE`` has are counted first; they
    are few. Their rows get a salt taken from ``spread_by``, in proportion to their number,
    and only their rows of the table are repeated, so a key held by a third of all rows is
    worked on by many tasks. ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``.
    """
    on = list(on)
    if fits_broadcast(table, max_rows, max_bytes):
        return rows.join(F.broadcast(table), on, how)
    counts = materialize(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    share = total // HOT_SHARE + 1
    known = F.lit(True)
    for column in on:
        known = known & F.col(column).isNotNull()
    hot = counts.filter(known & (F.col("_n") > share)).select(
        *on, F.ceil(F.col("_n") / share).cast("long").alias("_salts")
    )
    # At most HOT_SHARE keys, and as many salts again.
    hot = F.broadcast(materialize(hot))
    # Rows without a key meet nothing; they are spread as well.
    salts = F.coalesce("_salts", F.when(known, F.lit(1)).otherwise(HOT_SHARE))
    salted = rows.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts)).drop("_salts")
    last = F.coalesce("_salts", F.lit(1)).cast("long") - 1
    copies = (
        table.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .drop("_salts")
    )
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Number all rows from 0 in the given order, without sorting them in one task.

    Rows are range-partitioned and sorted, then written to the shared folder with
    their partition and position; the position of a partition's first row is a
    running sum over one count per partition. Rows equal in ``order`` keep the order
    in which they were read, and may be cut apart, so that a key or a copied row that
    is repeated very often does not fill one partition.
    """
    position_bits = 33  # layout of monotonically_increasing_id
    names = [f"`{c}`" for c in df.columns]
    keys = [*order, "_tie"]
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_tie")
    )
    ordered = materialize(ordered).select(
        *names,
        F.shiftright("_at", position_bits).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << position_bits) - 1)).alias("_pos"),
    )
    # One row per partition: small whatever the data.
    before = (
        ordered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    return ordered.join(F.broadcast(before), "_part").select(
        *names, (F.col("_before") + F.col("_pos")).alias(name)
    )
