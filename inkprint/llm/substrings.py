"""Removal of passages that an earlier document has, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. The minimiser of a window is the
smallest hash among its pairs of neighbouring words, so equal windows have equal minimisers,
and neighbouring windows mostly share theirs. A run of windows with one minimiser (a
super-k-mer) travels once, as one packed string, to the bucket of that minimiser. The bucket
sorts the windows of all strings it got and finds those that a smaller document has.

Documents are dealt by hash into groups of a few megabytes. A group sends each distinct
window once, for its smallest document, so copies within a group cost one string however many
there are, and a bucket answers with the numbers of the windows that a smaller document of
another group has. The group then cuts its texts. Texts are shuffled once; both passes over
them read the same exchange.
"""

from __future__ import annotations



import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import run_hashes
from inkprint.llm.words import Words

WINDOW = 13
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: An id that is null counts as larger than all others.
NO_ID = np.iinfo(np.int64).max

_PACKED = "bucket long, part long, heads binary, words binary"
_ANSWER = "part long, found binary"


class _Windows:
    """All windows of some word sequences, each sequence with a document number.

    ``start`` is the first word of each window, ``label`` is equal for equal windows only.
    """

    def __init__(self, words: Words, lengths: np.ndarray, docs: np.ndarray, window: int):
        self.words, self.window = words, window
        starts = np.cumsum(lengths) - lengths
        per = np.maximum(lengths - window + 1, 0)
        first = np.cumsum(per) - per
        self.owner = np.repeat(np.arange(len(lengths)), per)
        self.start = np.arange(per.sum()) - np.repeat(first - starts, per)
        self.docs = docs[self.owner]
        self._label()

    def _label(self) -> None:
        values = run_hashes(self.words.hashes, self.window)[self.start]
        order = np.argsort(values)
        ranked = values[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        # Equal hashes are trusted only where the words agree.
        again = np.flatnonzero(~new)
        here, before = self.start[order[again]], self.start[order[again - 1]]
        differ = ~self.words.same(here, before, self.window)
        if differ.any():
            order, new = self._apart(values, np.unique(ranked[again[differ]]))
        self.heads = np.flatnonzero(new)
        self.order = order
        self.label = np.empty(len(order), np.int64)
        self.label[order] = np.cumsum(new) - 1

    def _apart(self, values: np.ndarray, clashing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and heads when different windows share a hash: told apart by their words."""
        kind = np.zeros(len(values), np.int64)
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(values, clashing)):
            key = self.words.text(self.start[i], self.start[i] + self.window)
            kind[i] = known.setdefault(key, len(known) + 1)
        order = np.lexsort((kind, values))
        new = np.ones(len(order), bool)
        new[1:] = (values[order][1:] != values[order][:-1]) | (kind[order][1:] != kind[order][:-1])
        return order, new

    def least(self, of: np.ndarray) -> np.ndarray:
        """For each label the smallest of some numbers, one for each window."""
        if not len(of):
            return of
        return np.minimum.reduceat(of[self.order], self.heads)

    def minimisers(self) -> np.ndarray:
        low, reach = run_hashes(self.words.hashes, 2), 1
        while reach * 2 <= self.window - 1:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = self.window - 1 - reach
        return np.minimum(low[self.start], low[self.start + rest])


def _packed(numbers: np.ndarray) -> bytes:
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    return steps.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.int64))


class _Group:
    """The documents of a group, ordered by id and text, cut into words."""

    def __init__(self, table: pa.Table, window: int):
        ids = table["id"].fill_null(int(NO_ID)).to_numpy()
        texts = [(t or "").encode() for t in table["text"].to_pylist()]
        self.rows = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.words = Words([texts[i] for i in self.rows])
        docs = ids[self.rows].astype(np.int64)
        self.windows = _Windows(self.words, self.words.count, docs, window)
        # Sequences are ordered by id, so the first window of a label has its smallest id.
        self.first = self.windows.least(np.arange(len(self.windows.start)))


def _send(table: pa.Table, window: int, buckets: int) -> pa.Table:
    part = table["part"][0].as_py()
    group = _Group(table, window)
    w = group.windows
    picked = np.sort(group.first)
    out: dict[str, list] = {"bucket": [], "part": [], "heads": [], "words": []}
    if len(picked):
        low = w.minimisers()[picked]
        cut = np.ones(len(picked), bool)
        cut[1:] = (
            (low[1:] != low[:-1]) | (np.diff(picked) != 1) | (np.diff(w.owner[picked]) != 0)
        )
        begin = np.flatnonzero(cut)
        count = np.diff(np.append(begin, len(picked)))
        first = picked[begin]
        bucket = (low[begin] % np.uint64(buckets)).astype(np.int64)
        joined = group.words.bytes
        lo = group.words.start[w.start[first]]
        hi = group.words.end[w.start[first] + count + window - 2]
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        press = zstandard.ZstdCompressor(level=1)
        for i, j in zip(edges, np.append(edges[1:], len(order)), strict=True):
            runs = order[i:j]
            heads = [w.docs[first[runs]], first[runs], count[runs]]
            text = b" ".join(
                [joined[a:b] for a, b in zip(lo[runs].tolist(), hi[runs].tolist(), strict=True)]
            )
            out["bucket"].append(int(bucket[runs[0]]))
            out["part"].append(part)
            out["heads"].append(press.compress(b"".join(map(_packed, heads))))
            out["words"].append(press.compress(text))
    return pa.table(out, schema=_SEND)


def _meet(table: pa.Table, window: int) -> pa.Table:
    """The windows that a smaller document of another group has."""
    open_ = zstandard.ZstdDecompressor().decompress
    docs, ordinals, counts, words, sizes = [], [], [], [], []
    for heads, text in zip(table["heads"].to_pylist(), table["words"].to_pylist(), strict=True):
        raw = open_(heads)
        third = len(raw) // 3
        parts = [_unpacked(raw[i * third : (i + 1) * third]) for i in range(3)]
        docs.append(parts[0])
        ordinals.append(parts[1])
        counts.append(parts[2])
        sizes.append(len(parts[0]))
        words.append(open_(text))
    doc, ordinal, count = map(np.concatenate, (docs, ordinals, counts))
    w = _Windows(Words(words), count + window - 1, doc, window)
    late = np.flatnonzero(w.docs > w.least(w.docs)[w.label])
    owner = w.owner[late]
    number = ordinal[owner] + late - (np.cumsum(count) - count)[owner]
    part = np.repeat(np.arange(len(sizes)), sizes)[owner]
    press = zstandard.ZstdCompressor(level=1)
    out: dict[str, list] = {"part": [], "found": []}
    parts = table["part"].to_pylist()
    edges = np.searchsorted(part, np.arange(len(sizes) + 1))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            out["part"].append(parts[i])
            out["found"].append(press.compress(_packed(np.sort(number[a:b]))))
    return pa.table(out, schema=_FOUND)


def _cut(table: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    group = _Group(table, window)
    w = group.windows
    open_ = zstandard.ZstdDecompressor().decompress
    gone = w.docs > w.docs[group.first][w.label] if len(w.start) else np.zeros(0, bool)
    found = [_unpacked(open_(x)) for x in answers["found"].to_pylist()]
    if found:
        # Where the group's smallest document is not the first, none of the group's is.
        elsewhere = np.zeros(len(group.first), bool)
        elsewhere[w.label[np.concatenate(found)]] = True
        gone |= elsewhere[w.label]
    words = group.words
    depth = np.zeros(len(words.end) + 1, np.int64)
    np.add.at(depth, w.start[gone], 1)
    np.add.at(depth, w.start[gone] + window, -1)
    covered = np.cumsum(depth)[:-1] > 0
    out: dict[str, list] = {"id": [], "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
    ids = table["id"].to_pylist()
    begin = 0
    for row, length in zip(group.rows, words.count.tolist(), strict=True):
        mask = covered[begin : begin + length]
        spans, kept = [], words.text(begin, begin + length)
        if mask.any():
            steps = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            spans = steps.reshape(-1, 2).tolist()
            between = [0, *steps.tolist(), length]
            parts = zip(between[::2], between[1::2], strict=True)
            kept = b" ".join([words.text(begin + a, begin + b) for a, b in parts if b > a])
        begin += length
        out["id"].append(ids[row])
        out["n_words"].append(length)
        out["n_removed"].append(int(mask.sum()))
        out["kept_text"].append(kept.decode())
        out["removed"].append([{"start": a, "end": b} for a, b in spans])
    return pa.table(out, schema=_CUT)


_SEND = pa.schema(
    [("bucket", pa.int64()), ("part", pa.int64()), ("heads", pa.binary()), ("words", pa.binary())]
)
_FOUND = pa.schema([("part", pa.int64()), ("found", pa.binary())])
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_CUT = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_text", pa.string()),
        ("removed", _SPAN),
    ]
)


def without_repeats(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    group_bytes: int = GROUP_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Remove each word that lies in a window which a document with a smaller id also has.

    Words are runs of anything but ASCII white space. Returns a row for each row of
    ``documents``: the id, ``n_words``, ``n_removed``, ``kept_text`` (words joined by one
    space) and ``removed`` (ranges of words, end exclusive); other columns are not read.
    Windows are judged on the texts as they came in. A null or empty text has no words. A
    null id counts as larger than all others; rows under one id do not remove each other's
    words. The numbers of groups and buckets follow from the bytes of all texts.
    """
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // group_bytes))
    buckets = max(1, -(-3 * total // bucket_bytes))
    dealt = rows.withColumn(
        "part", F.pmod(F.xxhash64("id", "text"), F.lit(parts).cast("long"))
    ).repartition("part")

    def send(table: pa.Table) -> pa.Table:
        return _send(table, window, buckets)

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table, window)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _cut(table, answers, window)

    packed = dealt.groupBy("part").applyInArrow(send, _PACKED)
    answers = packed.groupBy("bucket").applyInArrow(meet, _ANSWER)
    result = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        cut,
        "id long, n_words long, n_removed long, kept_text string,"
        " removed array<struct<start:long,end:long>>",
    )
    return result.withColumnRenamed("id", id_column)


