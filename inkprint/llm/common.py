"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDS = 5
CHUNK_CHARS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fifth that nothing is learned from.

    A null id has no remainder, so it is never held out nor learned from.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, group: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each group at most, drawn by the hash of ``by``.

    The share drawn is the same for every row of a group, and does not depend on where
    rows lie. Groups of up to ``bound`` rows are kept whole. Groups must be few (labels,
    languages): one count for each comes to the driver.
    """
    share = _share_of(rows, group, bound)
    draw = F.pmod(F.xxhash64(F.col(by), F.lit("draw")), F.lit(1 << 30))
    return rows.filter(draw < share)


def _share_of(rows: DataFrame, group: str, bound: int) -> Column:
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.lit(0)
    for row in counts:
        limit = (1 << 30) if row["n"] <= bound else int((1 << 30) * bound / row["n"])
        share = F.when(F.col(group).eqNullSafe(F.lit(row[group])), F.lit(limit)).otherwise(share)
    return share


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` consecutive numbers (none if there are fewer)."""
    n = max(0, len(h) - length + 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += h[k : k + n]
    return mixed(total)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def in_pieces(sizes: Iterable[int], bound: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``bound`` in all; one large item stands alone."""
    start, total, end = 0, 0, 0
    for size in sizes:
        if end > start and total + size > bound:
            yield start, end
            start, total = end, 0
        total += size
        end += 1
    if end > start:
        yield start, end


def running_start(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], bucket: str, size: str, name: str
) -> DataFrame:
    """Add the sum of ``size`` over all rows of the group that come before a row.

    ``bucket`` cuts a group into consecutive ranges of ``order``; only the rows of one
    range are sorted in one task, and only one sum for each range is added up over a group.
    """
    sums = rows.groupBy(*group, bucket).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
    )
    inside = (
        Window.partitionBy(*group, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    own = rows.withColumn(name, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    joined = own.join(offsets, [*same, F.col(bucket) == F.col("_b")])
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop(
        *[f"_g{i}" for i in range(len(group))], "_b", "_before"
    )
