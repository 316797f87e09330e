"""Shards by a k-d tree over metadata.

The tree starts with all documents. A node that stands for k shards is cut in two along its
widest dimension, its range compared with that of the whole table, so that the left part holds
floor(k / 2) / k of the node's bytes. Rows are ordered by the dimension, then by a number made
from the id, so a value that a third of all rows share is cut apart like any other.

All nodes of a level are cut together. The weighted median is found by narrowing: the sums of
``FAN`` ranges between bounds pick the range that the median lies in, and its least and greatest
value are the next bounds, until one row is left. Each step is one aggregate over a table of
numbers, and one row for each node comes to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.common import running_start, unused
from inkprint.session import materialize

FAN = 1024
RANGE_ROWS = 4_000
_TIE_BITS = 62


@dataclass
class _Cut:
    """The search for the cut of one node: the bounds of the value, then of the tie."""

    node: int
    dim: int
    goal: float
    low: int
    high: int
    value: int | None = None

    @property
    def found(self) -> bool:
        return self.value is not None and self.low == self.high


def as_number(text: Column, piece: int = 0) -> Column:
    """Seven bytes of a text, the ``piece``-th of them, as a number in the same order; null is -1."""
    some = F.rpad(F.hex(F.substring(text.cast("binary"), 7 * piece + 1, 7)), 14, "0")
    return F.coalesce(F.conv(some, 16, 10).cast("long"), F.lit(-1))


def text_dimensions(documents: DataFrame, *columns: str) -> dict[str, Column]:
    """Whole texts as dimensions, one for each seven bytes of the longest.

    Values that begin alike, such as ``crawl-2023-06`` and ``crawl-2023-14``, differ in a later one.
    """
    widest = documents.agg(*[F.max(F.octet_length(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {
        f"{c}_{piece}": as_number(F.col(c), piece)
        for i, c in enumerate(columns)
        for piece in range(max(1, -(-(widest[f"n{i}"] or 0) // 7)))
    }


def _narrowed(rows: DataFrame, cuts: list[_Cut]) -> dict[int, tuple]:
    """For each node the range that its goal falls into: bytes before, inside, bounds."""
    spark = rows.sparkSession
    lines = [
        (c.node, c.dim, float(c.goal), c.low, c.high, c.value, max(1, -(-(c.high - c.low + 1) // FAN)))
        for c in cuts
    ]
    bounds = spark.createDataFrame(
        lines, "node long, dim int, goal double, low long, high long, value long, step long"
    )
    at = F.expr("element_at(dims, dim + 1)")
    x = F.when(F.col("value").isNull(), at).otherwise(F.col("tie"))
    inside = (F.col("value").isNull() | (at == F.col("value"))) & x.between(F.col("low"), F.col("high"))
    # One line for each node that is being cut: fewer than there are shards.
    sums = (
        rows.join(F.broadcast(bounds), "node")
        .filter(inside)
        .select("node", "goal", "size", "low", "step", x.alias("x"))
        .withColumn("part", F.expr("(x - low) div step"))
        .groupBy("node", "goal", "part")
        .agg(F.sum("size").alias("bytes"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    upto = Window.partitionBy("node").orderBy("part")
    last = Window.partitionBy("node")
    picked = (
        sums.withColumn("total", F.sum("bytes").over(upto))
        .withColumn("end", F.max("part").over(last))
        .filter((F.col("total") >= F.col("goal")) | (F.col("part") == F.col("end")))
        .groupBy("node")
        .agg(F.min(F.struct("part", "total", "bytes", "low", "high")).alias("p"))
        .select("node", "p.*")
    )
    return {r["node"]: (r["total"] - r["bytes"], r["bytes"], r["low"], r["high"]) for r in picked.collect()}


def _cut_all(rows: DataFrame, cuts: list[_Cut]) -> None:
    """Move each cut to the last value and tie that stay left."""
    while active := [c for c in cuts if not c.found]:
        where = _narrowed(rows, active)
        for c in active:
            before, inside, low, high = where[c.node]
            c.goal -= before
            c.low, c.high = low, high
            if low == high and c.value is None:
                c.value, c.low, c.high = low, 0, (1 << _TIE_BITS) - 1
            elif low == high and c.goal < inside / 2:
                c.low = c.high = low - 1  # the row in the middle lies mostly on the right




def kd_shards(
    documents: DataFrame,
    dimensions: Mapping[str, Column],
    shards: int | None = None,
    target_bytes: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    place: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Deal documents into shards of nearly equal bytes that lie together in metadata.

    Returns the id, ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``shard`` from 0
    and ``slot``, without gaps from 0 within a shard. ``dimensions`` are numbers (see
    ``as_number``) within 2^61 of zero; a null counts as -1, and of equal widths the first
    counts. The number
    of shards is given, or the bytes that a shard should reach, or both: then there are at least
    ``shards``, and more where these would exceed ``target_bytes``. Null texts count as
    empty; a null id is an id like others; rows that repeat are dealt like any others. With
    fewer rows than shards some shards are empty; an empty table gives no row. A cut is off its
    goal by at most half a document.

    Slots follow a hash of the id, or ``place``: a range that a row lies in and its number from 0
    there, both in order (see ``mixing.written_place``); no two rows share both.
    """
    size = (F.coalesce(F.octet_length(text_column), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))
    dims = F.array(*[F.coalesce(c.cast("long"), F.lit(-1).cast("long")) for c in dimensions.values()])
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.lit("tie")), 64 - 41) * (1 << 21)
    own = F.shiftrightunsigned(F.xxhash64("_row"), 64 - 21)
    # Read before any other step: the place of a row in its file is known to the scan only.
    at = [] if place is None else [F.struct(place[0].alias("range"), place[1].alias("number")).alias("at")]
    rows = materialize(
        documents.withColumn("_row", F.monotonically_increasing_id()).select(
            F.col(id_column).alias("id"),
            size.alias("size"),
            crc.alias("text_crc32"),
            dims.alias("dims"),
            (draw + own).alias("tie"),
            F.lit(0).cast("long").alias("node"),
            *at,
        )
    )
    carried = ["at"] if at else []
    n_dims = len(dimensions)
    ranges = [f(F.col("dims")[i]).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ranges).first()
    if target_bytes is not None:
        shards = max(shards or 1, -(-(whole["bytes"] or 0) // target_bytes))
    spread = [max(1, (whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0)) for i in range(n_dims)]
    # A node is named by its first shard, with the number of shards it stands for.
    nodes = {0: shards}
    while any(k > 1 for k in nodes.values()):
        stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ranges).collect()
        cuts = []
        for r in stats:
            k = nodes[r["node"]]
            if k > 1:
                widths = [(r[f"hi{i}"] - r[f"lo{i}"]) / spread[i] for i in range(n_dims)]
                dim = widths.index(max(widths))
                goal = r["bytes"] * (k // 2) / k
                cuts.append(_Cut(r["node"], dim, goal, r[f"lo{dim}"], r[f"hi{dim}"]))
        if not cuts:
            break
        _cut_all(rows, cuts)
        lines = [(c.node, c.dim, c.value, c.low, nodes[c.node] // 2) for c in cuts]
        limits = documents.sparkSession.createDataFrame(
            lines, "node long, dim int, value long, last long, left long"
        )
        x = F.expr("element_at(dims, dim + 1)")
        right = (x > F.col("value")) | ((x == F.col("value")) & (F.col("tie") > F.col("last")))
        rows = materialize(
            rows.join(F.broadcast(limits), "node", "left").select(
                "id", "size", "text_crc32", "dims", "tie", *carried,
                (F.col("node") + F.when(right, F.col("left")).otherwise(0)).alias("node"),
            )
        )
        halves = {}
        for node, k in nodes.items():
            halves[node] = max(1, k // 2)
            if k > 1:
                halves[node + k // 2] = k - k // 2
        nodes = halves
    if place is None:
        bits = max(0, ((whole["rows"] or 0) // shards // RANGE_ROWS).bit_length())
        part, order = F.shiftright("tie", _TIE_BITS - bits), ["tie", "id", "text_crc32"]
    else:
        # Of so many consecutive rows a shard has RANGE_ROWS at most on average.
        part, order = F.struct("at.range", F.expr(f"at.number div {RANGE_ROWS * shards}").alias("part")), ["at"]
    numbered = running_start(
        rows.withColumn("part", part).withColumn("one", F.lit(1).cast("long")),
        ["node"], order, "part", "one", "slot",
    )
    return numbered.select(
        F.col("id").alias(id_column), "size", "text_crc32", F.col("node").cast("int").alias("shard"), "slot"
    )


def document_dimensions(documents: DataFrame) -> dict[str, Column]:
    """The metadata of ``documents`` as dimensions: source, language, length and id."""
    return {
        **text_dimensions(documents, "source", "lang"),
        "n_chars": F.col("n_chars"),
        "doc_id": F.col("doc_id"),
    }


def write_shards(documents: DataFrame, shards: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write the documents as one folder of Parquet files for each shard.

    Rows of an id go to the least shard that the id was dealt to.
    """
    shard, key = unused(documents, "shard"), unused(documents, "_key")
    dealt = shards.groupBy(F.col(id_column).alias(key)).agg(F.min("shard").alias(shard))
    rows = documents.join(dealt, F.col(id_column).eqNullSafe(F.col(key))).drop(key)
    rows.write.partitionBy(shard).parquet(path)
