"""Mixing of sources to target weights, by Pfair scheduling.

Each source is cut into blocks of equal bytes. Block j (from 0) of a source with weight w is
released at floor(j / w) and due at ceil((j + 1) / w); at each slot the released block with the
earliest deadline goes next. As weights add up to one and are whole shares of a period, all
deadlines are met, and at any slot each source is less than one block away from its weight.

The schedule repeats after one period, so only one period is simulated, on the driver, and each
row computes the slot of its block from it. When a source has no blocks left, a new phase begins
in which the others keep their weights in proportion; no document is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.llm.common import running_start, unused
from inkprint.operators.distribute import lookup
from inkprint.operators.identity import names_rows
from inkprint.session import materialize

#: A block has this many bytes at most, and of a smaller input one of ``BLOCKS`` parts or one document.
BLOCK_BYTES = 1 << 20
BLOCKS = 10_000
RESOLUTION = 1000
EXPONENT = 0.7
RANGE_ROWS = 4_000
_DRAW_BITS = 42


def block_size(total: int, rows: int) -> int:
    """Bytes of a block of an input of so many bytes and rows."""
    return max(1, min(BLOCK_BYTES, max(-(-total // BLOCKS), total // max(1, rows))))


@dataclass
class Phase:
    """How one source runs while a set of sources lasts."""

    first: int
    count: int
    start: int
    share: int
    period: int
    places: list[int]


def whole_shares(weights: Mapping, resolution: int) -> dict:
    """Weights as whole shares of at least 1, by largest remainder."""
    total = sum(weights.values())
    period = max(resolution, len(weights))
    exact = {s: w / total * period for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (shares[s] - exact[s], str(s)))
    for i in range(max(0, period - sum(shares.values()))):
        shares[order[i % len(order)]] += 1
    return shares


def one_period(shares: Mapping) -> dict[object, list[int]]:
    """For each source the slots of its blocks within a period, earliest deadline first."""
    period = sum(shares.values())
    places: dict[object, list[int]] = {s: [] for s in shares}
    waiting: list[list] = [[] for _ in range(period)]
    rank = {s: i for i, s in enumerate(shares)}
    names = list(shares)
    for s, a in shares.items():
        for j in range(a):
            waiting[j * period // a].append((-(-(j + 1) * period // a), rank[s]))
    ready: list[tuple[int, int]] = []
    for slot in range(period):
        for block in waiting[slot]:
            heapq.heappush(ready, block)
        deadline, number = heapq.heappop(ready)
        if deadline <= slot:
            raise ArithmeticError("a deadline was missed")
        places[names[number]].append(slot)
    return places


def phases(shares: Mapping, blocks: Mapping) -> dict[object, list[Phase]]:
    """For each source its phases, until all blocks have a slot."""
    plan: dict[object, list[Phase]] = {s: [] for s in blocks}
    done = dict.fromkeys(blocks, 0)
    start = 0
    left = {s: a for s, a in shares.items() if blocks[s] > 0}
    while left:
        period = sum(left.values())
        places = one_period(left)
        ends = {}
        for s, a in left.items():
            whole, rest = divmod(blocks[s] - done[s] - 1, a)
            ends[s] = whole * period + places[s][rest] + 1
        end = min(ends.values())
        whole, rest = divmod(end, period)
        for s, a in left.items():
            count = whole * a + sum(p < rest for p in places[s])
            if count:
                plan[s].append(Phase(done[s], count, start, a, period, places[s]))
            done[s] += count
        start += end
        left = {s: a for s, a in left.items() if done[s] < blocks[s]}
    return plan


_PLAN = T.StructType(
    [
        T.StructField("its_source", T.StringType()),
        T.StructField(
            "phases",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.LongType()) for n in ("first", "count", "start", "share", "period")]
                    + [T.StructField("places", T.ArrayType(T.IntegerType()))]
                )
            ),
        ),
    ]
)


def mixed_slots(
    documents: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    block_bytes: int | None = None,
    resolution: int = RESOLUTION,
    exponent: float = EXPONENT,
    draw_by: str | None = None,
) -> DataFrame:
    """The place of each document in the mixed order.

    Returns the id, source, ``size`` (UTF-8 bytes of the text and 1), ``block`` (number within
    the source), ``release`` and ``deadline`` (slots within the phase), ``slot`` (its block's
    place in the whole order, each used once) and ``place`` (bytes of the source before it).
    Documents of a source come in the order of a hash of their ids (or ``draw_by``) and texts; a document belongs to
    the block that its first byte falls into. Without ``block_bytes`` see ``block_size``. ``weights`` are positive; a source that they do not
    name gets the smallest of them. Without weights they are the sources' bytes to the power of
    ``exponent``. A null source is a source of its own, null texts have size 1, rows may repeat,
    and an empty table gives no row. Sources are as few as a mixing plan has: their totals and
    phases are on the driver. Rows of one source are sorted in ranges of about ``RANGE_ROWS``.
    """
    rows = materialize(
        documents.select(
            F.col(id_column).alias("id"),
            F.col(source_column).cast("string").alias("source"),
            (F.coalesce(F.octet_length(text_column), F.lit(0)) + 1).cast("long").alias("size"),
            F.shiftrightunsigned(
                # Rows without an id lie apart even if their texts are equal.
                F.xxhash64(
                    F.col(draw_by or id_column), F.xxhash64(text_column),
                    F.when(F.col(draw_by or id_column).isNull(), F.monotonically_increasing_id()), F.lit("mix"),
                ),
                64 - _DRAW_BITS,
            ).alias("draw"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    totals = {
        r["source"]: (r["bytes"], r["rows"])
        for r in rows.groupBy("source")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .collect()
    }
    ordered = sorted(totals, key=lambda s: (s is None, s or ""))
    if weights is None:
        wanted = {s: totals[s][0] ** exponent for s in ordered}
    else:
        least = min(weights.values())
        wanted = {s: weights.get(s, least) for s in ordered}
    if block_bytes is None:
        block_bytes = block_size(sum(b for b, _ in totals.values()), sum(n for _, n in totals.values()))
    blocks = {s: -(-totals[s][0] // block_bytes) for s in ordered}
    plan = phases(whole_shares(wanted, resolution), blocks) if totals else {}
    lines = [
        (s, [(p.first, p.count, p.start, p.share, p.period, p.places) for p in plan[s]])
        for s in ordered
    ]
    # One line for each source, with at most a period of places for each phase.
    table = documents.sparkSession.createDataFrame(lines, _PLAN)
    largest = max((n for _, n in totals.values()), default=1)
    bits = min(_DRAW_BITS, max(0, (largest // RANGE_ROWS).bit_length()))
    dealt = F.shiftright("draw", _DRAW_BITS - bits)
    placed = running_start(
        rows.withColumn("range", dealt), ["source"], ["draw", "tie"], "range", "size", "place"
    )
    block = F.expr(f"place div {block_bytes}")
    now = F.filter("phases", lambda p: (F.col("block") >= p["first"]) & (F.col("block") < p["first"] + p["count"]))[0]
    j = F.col("block") - F.col("now.first")
    period, share = F.col("now.period"), F.col("now.share")
    return (
        placed.withColumn("block", block)
        .join(F.broadcast(table), F.col("source").eqNullSafe(F.col("its_source")))
        .withColumn("now", now)
        .withColumn("j", j)
        .select(
            F.col("id").alias(id_column),
            F.col("source").alias(source_column),
            "size",
            "block",
            F.expr("j * now.period div now.share").alias("release"),
            F.expr("((j + 1) * now.period + now.share - 1) div now.share").alias("deadline"),
            (
                F.col("now.start")
                + F.expr("j div now.share") * period
                + F.get(F.col("now.places"), (F.col("j") % share).cast("int"))
            ).alias("slot"),
            "place",
        )
    )


def mixed(documents: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """All documents with their columns, laid out in the mixed order.

    Rows are partitioned and sorted by slot, so that files written from the result, read in the
    order of their names, follow the schedule. Each row has a place of its own: where ids repeat or
    are missing, rows are numbered first. Slots are a narrow table that meets its documents by
    ``lookup``; texts move once more, to their partition, which follows from the slot.
    """
    slot, place, key, row = (unused(documents, n) for n in ("_slot", "_place", "_key", "_row"))
    if names_rows(documents, [id_column]):
        rows, row = documents, id_column
    else:
        rows = materialize(documents.withColumn(row, F.monotonically_increasing_id()))
    at = mixed_slots(rows, id_column=row, draw_by=id_column, **settings)
    slots = materialize(at.select(F.col(row).alias(key), F.col("slot").alias(slot), F.col("place").alias(place)))
    last = slots.agg(F.max(slot)).first()[0] or 0
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.least(F.expr(f"`{slot}` * {parts} div {last + 1}"), F.lit(parts - 1)).cast("int")
    joined = lookup(rows.withColumn(key, F.col(row)), slots, [key], spread_by=[key], how="inner")
    laid = joined.repartitionById(parts, part).sortWithinPartitions(slot, place)
    return laid.select(*[F.col(f"`{c}`") for c in documents.columns])


def written_place(documents: DataFrame) -> tuple[Column, Column]:
    """Where each row of files that were written from ``mixed`` lies: the file, and the row in it.

    In the order of both, rows follow the schedule. Any other table than files as they are read
    has its rows in one range, in the order of its partitions.
    """
    plan = documents._jdf.queryExecution().analyzed()
    # A join or a projection would still name files, those of any table below it.
    if plan.nodeName().startswith("LogicalRelation"):
        file = documents.metadataColumn("_metadata")
        return file["file_name"], file["row_index"]
    return F.lit(""), F.monotonically_increasing_id()
