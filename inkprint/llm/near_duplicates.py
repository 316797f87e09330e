"""Near-duplicates by order MinHash.

A text is a sequence of words, and a sequence of shingles of five words. Each of ``SAMPLES`` hash
functions picks the ``PICKED`` smallest shingles, labelled by their occurrence, and keeps them in
text order. As the order counts, agreement of picks follows edit similarity rather than overlap
alone. Texts that agree in one of the samples are candidates. They are similar if at most
``1 - SIMILARITY`` of the longer sequence of words has to be edited, which a banded alignment
verifies. Classes are the connected components of the similar pairs.

With a share e of the words changed, (1 - e) ** 5 of the shingles are left; of texts with 5 % changed
one pair in 100,000 is never a candidate, of 8 % one in 150, of 10 % one in 20, of 15 % two in
five. Pairs of texts with 0.8 of all their shingles in common are candidates but for one in 10 ** 12.

Texts with equal words are one node. Each node is first compared with one other, the smallest of
its buckets. Then the members of a bucket that are not in its class are compared with the smallest node of
the bucket. In buckets that are still in more than one class all members are compared that are not known to
be in one class, so every candidate pair has been aligned or joined by others, but a group of copies costs rows
in proportion to its size.

Texts that share a passage and nothing else meet in buckets, too, and no comparison joins them. So
then a large bucket is cut into smaller ones by a prefix filter, which is exact: similar
texts share four fifths of the words of either, counted by occurrence. A member's words are ordered
from those that few members have to those that many have, as a table of counts with a fixed number
of cells tells; any order would do, this one has the fewest meetings. Two similar members have a word in
common before either has passed over more than it may lose. A passage of all members comes last.

Members that have such a word with another class are dealt into blocks by their number of words, and two
blocks meet in a task: one matrix product counts the words that any two of their texts share, and only pairs
that share enough, and that the links found in this task do not join yet, are aligned. So a task
has two blocks at most, and gives fewer links than it has texts, however many of their pairs are near the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.llm.alignment import banded_distance
from inkprint.llm.common import in_pieces, mixed, run_hashes, texts_of, unused
from inkprint.llm.components import components
from inkprint.llm.words import Words
from inkprint.operators.identity import ROW, TextRows, numbered_rows, text_rows
from inkprint.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES = 40
PICKED = 3
#: Buckets of more members are cut by the prefix filter; in smaller ones all may be compared.
SMALL_BUCKET = 8
#: Rounds of speakers before that; they join the groups of copies.
WHOLE_ROUNDS = 1
_MORE_SPEAKERS = 16
#: Cells that words are counted in, for the order of the prefix filter.
WORD_CELLS = 1 << 20
_CELL_RANGE = 1 << 16
#: Words of members that a task of the prefix filter should have.
_RANGE_ENTRIES = 1 << 18
#: Texts of a block, and the words it should have; a longer text is a block of its own, or nearly.
BLOCK = 256
BLOCK_WORDS = 1 << 20
#: Words that one matrix product counts.
_COUNTED = 1 << 13
_DRAWN = 1 << 21
_SEEDS = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def word_codes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text the hashes of its words, and the words joined by a space."""
    words = Words(texts)
    begin = 0
    for count in words.count.tolist():
        yield words.hashes[begin : begin + count], words.text(begin, begin + count)
        begin += count


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one run, one without words has none."""
    return run_hashes(words, min(size, len(words))) if len(words) else words


def labelled_by_occurrence(codes: np.ndarray) -> np.ndarray:
    """For each shingle a number of it and of how often it came before; no two are equal."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.ones(len(codes), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(first)
    occurrence = np.empty(len(codes), np.uint64)
    occurrence[order] = np.arange(len(codes)) - np.repeat(heads, np.diff(np.append(heads, len(codes))))
    return mixed(codes + occurrence * np.uint64(0x9E3779B97F4A7C15))


def order_minhash(codes: np.ndarray, samples: int, picked: int = PICKED) -> np.ndarray:
    """One number for each sample: its least shingles with their occurrence, in text order."""
    labelled = labelled_by_occurrence(codes)
    out = np.arange(samples, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    step = max(1, _DRAWN // len(codes))
    for first in range(0, samples, step):
        drawn = labelled[None, :] * _SEEDS[first : min(samples, first + step), None]
        rows = np.arange(len(drawn))
        places = []
        for _ in range(min(picked, len(codes))):
            places.append(drawn.argmin(1))
            drawn[rows, places[-1]] = np.iinfo(np.uint64).max
        for place in np.sort(places, axis=0):
            here = out[first : first + len(drawn)]
            here[:] = mixed(here * np.uint64(3) + labelled[place])
    return out


def _sketches(size: int, samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in in_pieces(map(len, texts)):
                keys, buckets = [], []
                for words, text in word_codes([t.encode() for t in texts[a:b]]):
                    some = len(words) > 0
                    keys.append(xxhash.xxh3_128_digest(text) if some else None)
                    picks = order_minhash(shingles_of(words, size), samples) if some else None
                    buckets.append(picks.view(np.int64).tolist() if some else None)
                yield pa.record_batch(
                    [
                        batch["node"].slice(a, b - a),
                        pa.array(keys, pa.binary()),
                        pa.array(buckets, pa.list_(pa.int64())),
                    ],
                    ["node", "words_key", "buckets"],
                )

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether at most ``1 - similarity`` of the longer sequence has to be edited."""
    longest = max(len(a), len(b))
    budget = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > budget:
        return False
    # An occurrence of a word that the other side lacks costs an edit.
    both = len(np.intersect1d(labelled_by_occurrence(a), labelled_by_occurrence(b), assume_unique=True))
    return longest - both <= budget and _within(a, b, longest - both, budget)


def _within(a: np.ndarray, b: np.ndarray, least: int, budget: int) -> bool:
    """Whether ``budget`` edits do, of which ``least`` are needed in any case."""
    # What both begin or end with is no part of the alignment.
    shortest = min(len(a), len(b))
    differ = np.flatnonzero(a[:shortest] != b[:shortest])
    head = int(differ[0]) if len(differ) else shortest
    differ = np.flatnonzero(a[len(a) - shortest + head :][::-1] != b[len(b) - shortest + head :][::-1])
    tail = int(differ[0]) if len(differ) else shortest - head
    left, right = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    # Most copies are close: a narrow band first, a wider one only where it does not do.
    width = min(budget, max(8, least, abs(len(a) - len(b))))
    while banded_distance(left, right, width) is None:
        if width == budget:
            return False
        width = min(budget, 2 * width)
    return True


def _aligned(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            text_a, text_b = batch["text_a"], batch["text_b"]
            found = []
            for i in range(batch.num_rows):
                text = text_a[i].as_py()
                if text != last:  # rows of one node follow each other
                    last, left = text, next(word_codes([text.encode()]))[0]
                right = next(word_codes([text_b[i].as_py().encode()]))[0]
                if similar(left, right, similarity):
                    found.append(i)
            yield batch.drop_columns(["text_a", "text_b"]).take(pa.array(found, pa.int64()))

    return run


#: A pair of nodes, with the root and the present class of each.
_PAIR = ("a", "b", "root_a", "root_b", "class_a", "class_b")


class _Comparison:
    """Similar pairs among candidates, over the texts that are candidates of any."""

    def __init__(self, nodes: DataFrame, candidates: DataFrame, similarity: float):
        self.texts = materialize(nodes.join(candidates.select("node").distinct(), "node", "left_semi"))
        self.run = _aligned(similarity)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        left = self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        # Each member's text travels once; the speaker's side of the join is not repeated.
        both = pairs.join(right, "b").join(left, "a").select(*_PAIR, "text_a", "text_b")
        return both.mapInArrow(self.run, ", ".join(f"{c} long" for c in _PAIR))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, labelled by their occurrence."""
    for batch in batches:
        texts = texts_of(batch["text"])
        for a, b in in_pieces(map(len, texts)):
            words = [labelled_by_occurrence(w) for w, _ in word_codes([t.encode() for t in texts[a:b]])]
            yield pa.record_batch(
                [batch["node"].slice(a, b - a), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64()))],
                ["node", "words"],
            )


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of the words of a batch, with how many words are in each: a row for each range of cells."""
    for batch in batches:
        cells, n = np.unique(batch["words"].flatten().to_numpy() & (WORD_CELLS - 1), return_counts=True)
        yield _by_range(cells // _CELL_RANGE, {"cells": cells, "n": n})


def _summed_cells(rows: pa.Table) -> pa.Table:
    first = rows["range"][0].as_py()
    counts = np.zeros(_CELL_RANGE, np.int64)
    np.add.at(counts, _flat(rows["cells"]) - first * _CELL_RANGE, _flat(rows["n"]))
    return pa.table({"range": [first], "counts": pa.array([counts], pa.list_(pa.int64()))})


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in lists.chunks])


def _by_range(ranges: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each range, with what belongs to it as lists."""
    order = np.argsort(ranges, kind="stable")
    names, starts = np.unique(ranges[order], return_index=True)
    ends = pa.array(np.append(starts, len(ranges)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int64())) for x in columns.values()]
    return pa.record_batch([pa.array(names, pa.int64()), *lists], ["range", *columns])


def _first_words(counts: Broadcast, similarity: float, ranges: int):
    """Of each text the words that come first, from rare to common: one more than may be edited.

    A word of a bucket has a key; keys are packed by range, with the node and class of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            entries = [len(w) * len(b) for w, b in zip(whole["words"], whole["buckets"], strict=True)]
            for low, high in in_pieces(entries):
                batch = whole.slice(low, high - low)
                found = []
                for i in range(batch.num_rows):
                    words = batch["words"][i].values.to_numpy(zero_copy_only=False)
                    buckets = batch["buckets"][i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    needed = int(np.ceil(len(words) * similarity - 1e-6))
                    order = np.lexsort((words, counts.value[words & (WORD_CELLS - 1)]))
                    first = words[order[: len(words) - needed + 1]].view(np.uint64)
                    found.append(mixed(first[None, :] * _SEEDS[0] + mixed(buckets)[:, None]).ravel())
                number = np.array([len(k) for k in found])
                keys = np.concatenate(found)
                nodes, classes = (np.repeat(batch[c].to_numpy(), number) for c in ("node", "class"))
                at = (keys % np.uint64(ranges)).astype(np.int64)
                yield _by_range(at, {"keys": keys.view(np.int64), "nodes": nodes, "classes": classes})

    return run


def _met(rows: pa.Table) -> pa.Table:
    """Nodes that have a key with another class."""
    keys, nodes, classes = (_flat(rows[c]) for c in ("keys", "nodes", "classes"))
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    low, high = (f.reduceat(classes[order], heads) for f in (np.minimum, np.maximum))
    several = np.repeat(low < high, np.diff(np.append(heads, len(keys))))
    return pa.table({"node": pa.array(np.unique(nodes[order][several]), pa.int64())})


def _cut_by_prefix(large: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node): members of large buckets that have one of their first words in common with another class there.

    Any two similar members of one bucket that are in different classes do.
    """
    of_node = large.groupBy("node", "root", "class").agg(F.collect_list("bucket").alias("buckets"))
    coded = texts.join(of_node.select("node"), "node", "left_semi").mapInArrow(
        _occurrences, "node long, words array<long>"
    )
    whole = materialize(coded.join(of_node, "node"))
    # Words are packed into rows: a row for each word would be many times the members.
    cells = whole.select("words").mapInArrow(_cell_counts, "range long, cells array<long>, n array<long>")
    summed = cells.groupBy("range").applyInArrow(_summed_cells, "range long, counts array<long>").toArrow()
    counts = np.zeros(WORD_CELLS, np.int64)
    for first, some in zip(summed["range"].to_pylist(), summed["counts"], strict=True):
        counts[first * _CELL_RANGE : (first + 1) * _CELL_RANGE] = some.values.to_numpy()
    entries = whole.agg(F.sum(F.size("words") * (1 - similarity) * F.size("buckets"))).first()[0] or 0
    shared = whole.sparkSession.sparkContext.broadcast(counts)
    first = whole.mapInArrow(
        _first_words(shared, similarity, 1 + int(entries // _RANGE_ENTRIES)),
        "range long, keys array<long>, nodes array<long>, classes array<long>",
    )
    return first.groupBy("range").applyInArrow(_met, "node long").distinct()


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, as numbers."""
    for batch in batches:
        texts = texts_of(batch["text"])
        for a, b in in_pieces(map(len, texts)):
            words = [w.view(np.int64) for w, _ in word_codes([t.encode() for t in texts[a:b]])]
            yield pa.record_batch(
                [batch["node"].slice(a, b - a), pa.array(words, pa.list_(pa.int64()))], ["node", "words"]
            )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of ``left`` (row) has in common with each of ``right``; none has one twice."""
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*[np.unique(x) for x in flat], assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return total.astype(np.int64)
    sides = []
    for side, codes in zip((left, right), flat, strict=True):
        at = np.minimum(np.searchsorted(both, codes), len(both) - 1)
        known = both[at] == codes
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])[known]
        order = np.argsort(at[known], kind="stable")
        sides.append((row[order], at[known][order]))
    for first in range(0, len(both), _COUNTED):
        width = min(_COUNTED, len(both) - first)
        some = []
        for side, (row, at) in zip((left, right), sides, strict=True):
            low, high = np.searchsorted(at, [first, first + width])
            some.append(np.zeros((len(side), width), np.float32))
            some[-1][row[low:high], at[low:high] - first] = 1
        total += some[0] @ some[1].T
    return total.astype(np.int64)


def _linked_blocks(similarity: float):
    """Of two blocks (or one with itself) the links that join their classes, as few as do."""

    def run(rows: pa.Table) -> pa.Table:
        column = {c: rows[c].to_numpy() for c in ("node", "root", "class", "side", "bucket")}
        words = [x.values.to_numpy().view(np.uint64) for x in rows["words"]]
        groups = [frozenset(x.values.to_pylist()) for x in rows["groups"]]
        length = np.array([len(w) for w in words])
        labelled = [labelled_by_occurrence(w) for w in words]
        left, right = np.flatnonzero(column["side"] == 0), np.flatnonzero(column["side"] == 1)
        alone = len(right) == 0
        right = left if alone else right
        both = overlaps([labelled[i] for i in left], [labelled[i] for i in right])
        longest = np.maximum(length[left][:, None], length[right][None, :])
        budget = np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)
        close = (longest - both <= budget) & (column["class"][left][:, None] != column["class"][right][None, :])
        x, y = np.nonzero(np.triu(close, 1) if alone else close)
        # The likeliest first: the more classes are joined, the fewer pairs are left.
        order = np.argsort(-both[x, y] / longest[x, y], kind="stable")
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        found = []
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            a, b = int(left[i]), int(right[j])
            of_a, of_b = top(int(column["class"][a])), top(int(column["class"][b]))
            # Pairs of several groups are those of the least one.
            if of_a == of_b or min(groups[a] & groups[b]) != column["bucket"][a]:
                continue
            if _within(words[a], words[b], int(longest[i, j] - both[i, j]), int(budget[i, j])):
                parent[max(of_a, of_b)] = min(of_a, of_b)
                found.append((a, b) if column["node"][a] < column["node"][b] else (b, a))
        ends = np.array(found, np.int64).reshape(-1, 2)
        side = {"a": ends[:, 0], "b": ends[:, 1]}
        names = [(c, column[{"a": "node", "b": "node"}.get(c, c[:-2])], side[c[-1]]) for c in _PAIR]
        return pa.table({c: pa.array(values[at], pa.int64()) for c, values, at in names})

    return run


def _in_blocks(large: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs that join all classes of members of large buckets that any of their similar pairs joins."""
    cut = materialize(_cut_by_prefix(large, texts, similarity))
    of_node = (
        large.join(cut, "node", "left_semi").groupBy("node", "root", "class").agg(F.collect_set("bucket").alias("groups"))
    )
    coded = texts.join(cut, "node", "left_semi").mapInArrow(_coded, "node long, words array<long>")
    # Lengths of similar texts are in one range or in neighbours.
    width = max(1e-3, -np.log(max(similarity, 1e-3)) * (1 + 1e-6))
    whole = materialize(
        coded.join(of_node, "node").withColumn("range", F.floor(F.log(F.size("words").cast("double")) / F.lit(float(width))))
    )
    members = whole.select("node", "class", "range", F.size("words").alias("n"), F.explode("groups").alias("bucket"))
    sizes = members.groupBy("bucket", "range").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_WORDS)).alias("blocks")
    )
    placed = materialize(
        members.join(sizes, ["bucket", "range"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .select("bucket", "range", "block", "node", "class")
    )
    blocks = placed.groupBy("bucket", "range", "block").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    one = blocks.select("bucket", *[F.col(c).alias(f"{c}_1") for c in blocks.columns[1:]])
    two = blocks.select("bucket", *[F.col(c).alias(f"{c}_2") for c in blocks.columns[1:]])
    meetings = materialize(
        one.join(two, "bucket")
        .filter("range_2 = range_1 + 1 OR (range_2 = range_1 AND block_1 <= block_2)")
        .filter("least(low_1, low_2) < greatest(high_1, high_2)")
        .withColumn("meeting", F.monotonically_increasing_id())
    )
    place = lambda i: [F.col(f"{c}_{i + 1}").alias(c) for c in ("range", "block")]
    sides = meetings.select("meeting", "bucket", *place(0), F.lit(0).alias("side")).unionByName(
        meetings.filter("range_1 < range_2 OR block_1 < block_2")
        .select("meeting", "bucket", *place(1), F.lit(1).alias("side"))
    )
    dealt = placed.drop("class").join(sides, ["bucket", "range", "block"]).join(whole.drop("range"), "node")
    return (
        dealt.select("meeting", "side", "bucket", "node", "root", "class", "groups", "words")
        .groupBy("meeting")
        .applyInArrow(_linked_blocks(similarity), ", ".join(f"{c} long" for c in _PAIR))
    )


def _sizes(live: DataFrame) -> DataFrame:
    """(bucket, n, least): members, and the least one, of the buckets that are in more than one class."""
    return materialize(
        live.groupBy("bucket")
        .agg(
            F.min("class").alias("low"), F.max("class").alias("high"),
            F.count(F.lit(1)).alias("n"), F.min("node").alias("least"),
        )
        .filter("low < high")
        .select("bucket", "n", "least")
    )


def _parted(live: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the small buckets, and of the large ones."""
    small = live.join(sizes.filter(F.col("n") <= SMALL_BUCKET).select("bucket"), "bucket")
    # Buckets with one least member are one: their members meet in any case, and once instead of often.
    big = live.join(sizes.filter(F.col("n") > SMALL_BUCKET).select("bucket", "least"), "bucket")
    large = materialize(big.select(F.col("least").alias("bucket"), "node", "root", "class").distinct())
    return materialize(small), large


def _pairs_of(meeting: DataFrame) -> DataFrame:
    """Pairs of members ``x`` and ``y`` of different classes, each once."""
    least, most = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    return (
        meeting.filter("x.class <> y.class")
        .select(least, most)
        .select(
            F.col("x.node").alias("a"), F.col("y.node").alias("b"),
            F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b"),
            F.col("x.class").alias("class_a"), F.col("y.class").alias("class_b"),
        )
        .distinct()
    )


def _roots(edges: DataFrame) -> DataFrame:
    """(node, class) of a forest: each node is the greater end (b) of one edge at most. Paths halve in each round."""
    now = materialize(edges.select(F.col("b").alias("node"), F.col("a").alias("class"), F.lit(True).alias("open")))
    while not now.filter("open").isEmpty():
        up = now.select(F.col("node").alias("class"), F.col("class").alias("further"))
        now = materialize(
            now.join(up, "class", "left").select(
                "node", F.coalesce("further", "class").alias("class"), F.col("further").isNotNull().alias("open")
            )
        )
    return materialize(now.select("node", "class").unionByName(now.select(F.col("class").alias("node"), "class").distinct()))


def _joined(found: DataFrame) -> DataFrame:
    """(root, least): the smallest root that similar pairs join a root with."""
    classes = components(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    return materialize(classes.select(F.col("node").alias("root"), F.col("class").alias("least")))


def _moves(edges: DataFrame) -> DataFrame:
    """(class, less): a smaller class that similar pairs join each class with, two steps away at most."""
    step = materialize(
        edges.groupBy(F.greatest("class_a", "class_b").alias("class"))
        .agg(F.min(F.least("class_a", "class_b")).alias("less"))
    )
    further = step.select(F.col("class").alias("less"), F.col("less").alias("least"))
    return materialize(step.join(further, "less", "left").select("class", F.coalesce("least", "less").alias("less")))


def near_duplicate_classes(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    samples: int = SAMPLES,
) -> DataFrame:
    """(id, node, class) for each row of ``documents``: near copies share a class.

    ``node`` is the id where ids are whole numbers, none null and none repeated; otherwise rows are
    numbered, and it is the row's number, so that different texts under one id are told apart. The
    class is the smallest node in it. Every occurrence of a word or shingle counts. A text with
    fewer than ``shingle`` words is one shingle. A null text, or one without a word, is alone in
    its class. Other columns are not read. An empty table gives no row.
    """
    rows = _rows(documents, id_column, [text_column])
    return rows.by_key(_classes(rows, text_column, shingle, similarity, samples))


def _rows(documents: DataFrame, id_column: str, columns: list[str]) -> TextRows:
    """Rows with a node of their own."""
    kind = documents.select(F.col(id_column)).schema[0].dataType
    if isinstance(kind, T.IntegralType):
        return text_rows(documents, id_column, columns)
    return numbered_rows(documents, [id_column], columns)


def _classes(rows: TextRows, text_column: str, shingle: int, similarity: float, samples: int) -> DataFrame:
    """(row_id, node, class) of all rows."""
    nodes = rows.rows.select(F.col(ROW).cast("long").alias("node"), F.col(text_column).alias("text"))
    signs = materialize(
        nodes.mapInArrow(
            _sketches(shingle, samples), "node long, words_key binary, buckets array<long>"
        )
    )
    worded = signs.filter("words_key IS NOT NULL")
    texts = materialize(
        worded.groupBy("words_key").agg(F.min("node").alias("first"), F.any_value("buckets").alias("buckets"))
    )
    copies = materialize(
        worded.select("node", "words_key").join(texts.select("first", "words_key"), "words_key")
        .select("node", "first").distinct()
    )
    # Picks are numbered by their sample, so that a bucket belongs to one of them.
    members = texts.select(F.col("first").alias("node"), F.explode("buckets").alias("bucket"))
    shared = materialize(
        members.groupBy("bucket")
        .agg(F.min("node").alias("speaker"), F.max("node").alias("other"))
        .filter("speaker < other")
        .select("bucket", "speaker")
    )
    live = materialize(members.join(shared, "bucket"))
    compare = _Comparison(nodes, live, similarity)
    # Most members of a group are joined by one comparison, with the least speaker of any bucket.
    pairs = materialize(
        live.filter("node <> speaker")
        .groupBy(F.col("node").alias("b"))
        .agg(F.min("speaker").alias("a"))
        .select("a", "b", *[F.col(c[-1]).alias(c) for c in _PAIR[2:]])
    )
    same = copies.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = compare(pairs).select("a", "b").unionByName(same)
    labels = _roots(edges)
    tested, found = pairs.select("a", "b"), None
    root = F.coalesce("class", "node")
    live = materialize(
        live.join(labels, "node", "left").select("bucket", "node", root.alias("root"), root.alias("class"))
    )
    own = F.struct("node", "root", "class")
    for turn in range(WHOLE_ROUNDS):
        live = materialize(live.join(_sizes(live).select("bucket"), "bucket"))
        slots = _MORE_SPEAKERS**turn
        slot = F.pmod(F.xxhash64("node", F.lit(slots)), F.lit(slots)).alias("slot")
        speakers = materialize(
            live.groupBy("bucket", slot).agg(F.min(own).alias("s")).select("bucket", F.col("s.node").alias("speaker"), "s")
        )
        meeting = live.join(speakers, "bucket").select(own.alias("x"), F.col("s").alias("y"))
        pairs = materialize(_pairs_of(meeting).join(tested, ["a", "b"], "left_anti"))
        edges = materialize(compare(pairs))
        found = edges if found is None else found.unionByName(edges)
        tested = tested.unionByName(pairs.select("a", "b"))
        # Towards smaller classes: what shares a class is connected, if not all that is.
        moves = _moves(edges)
        spoken = speakers.select("bucket", F.col("speaker").alias("node"))
        live = materialize(
            live.join(spoken, ["bucket", "node"], "left_anti")
            .join(moves, "class", "left")
            .select("bucket", "node", "root", F.coalesce("less", "class").alias("class"))
        )
    # Groups of copies are one class by now, and what they have in common does not count.
    sizes = _sizes(live)
    if not sizes.isEmpty():
        small, large = _parted(live, sizes)
        meeting = small.select("bucket", own.alias("x")).join(small.select("bucket", own.alias("y")), "bucket")
        edges = compare(materialize(_pairs_of(meeting))).unionByName(_in_blocks(large, compare.texts, similarity))
        found = edges if found is None else found.unionByName(edges)
    if found is not None:
        joined = _joined(found).withColumnRenamed("root", "class")
        labels = labels.join(joined, "class", "full").select(
            # A root that no comparison had joined before has no label of its own.
            F.coalesce("node", "class").alias("node"), F.coalesce("least", "class").alias("class")
        )
        labels = materialize(labels)
    return signs.select(F.col("node").alias(ROW), "node").join(labels, "node", "left").select(
        ROW, "node", F.coalesce("class", "node").alias("class")
    )


def without_near_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    samples: int = SAMPLES,
) -> DataFrame:
    """Keep one row of each class, the one with the smallest node, with all its columns.

    Takes the settings of ``near_duplicate_classes``, and treats nulls, empty texts and repeated
    ids like it: a row goes only if its own text is a near copy of one that stays.
    """
    rows = _rows(documents, id_column, [text_column])
    row = unused(documents, "_row")
    if rows.owners is None:
        whole = documents.withColumn(row, F.col(id_column).cast("long"))
        classes = _classes(rows, text_column, shingle, similarity, samples)
    else:
        whole = materialize(documents.withColumn(row, F.monotonically_increasing_id()))
        numbered = TextRows(whole.select(F.col(row).alias(ROW), text_column), None, (ROW,))
        classes = _classes(numbered, text_column, shingle, similarity, samples)
    gone = classes.filter("node <> class").select(F.col("node").alias(f"{row}_gone"))
    return whole.join(gone, F.col(row) == F.col(f"{row}_gone"), "left_anti").drop(row)
