"""Counting inside texts: what one text holds is counted where its row is, without a shuffle.

A text is one row, so its words and pairs need no grouping over the table. Arrow batches bring the
words of many texts to numpy, which numbers and counts them, in pieces of a bounded number of words;
a text of more words is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: Words that are counted at once.
PIECE = 1 << 20
_ITEMS = "_items"


class Piece:
    """Some texts: ``row`` and ``code`` of each item in order, ``length`` of each text."""

    def __init__(self, items: pa.ListArray):
        self.length = _sizes(items).astype(np.int64)
        named = items.flatten().dictionary_encode()
        self.names = named.dictionary
        self.row = np.repeat(np.arange(len(items)), self.length)
        self.code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def text(self, of: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(of))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, code and count of the distinct items of each text."""
        size = max(1, len(self.names))
        found, n = np.unique(self.row * size + self.code, return_counts=True)
        return found // size, found % size, n

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, code and count of the distinct items of each text, and for each item which of them it is."""
        size = max(1, len(self.names))
        found, place, n = np.unique(self.row * size + self.code, return_inverse=True, return_counts=True)
        return found // size, found % size, n, place

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Row, first and second code, and counts of the pair, of its first and of its second word."""
        row, code, n, place = self.words()
        inner = self.row[1:] == self.row[:-1]
        size = max(1, len(row))
        found, k = np.unique(place[:-1][inner] * size + place[1:][inner], return_counts=True)
        first, second = found // size, found % size
        return row[first], code[first], code[second], k, n[first], n[second]


class Trigrams(Piece):
    """The overlapping three-character substrings of some texts, as their items."""

    def __init__(self, texts: pa.StringArray):
        known = [(t or b"").decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]
        row = np.repeat(np.arange(len(known)), list(map(len, known)))
        point = np.frombuffer("".join(known).encode("utf-32-le"), "<u4").astype(np.int64)
        inner = row[2:] == row[:-2]
        self.row = row[2:][inner]
        self.length = np.bincount(self.row, minlength=len(known))
        # Three code points of 21 bits each.
        named = pa.array((point[:-2] << 42 | point[1:-1] << 21 | point[2:])[inner]).dictionary_encode()
        self.code = named.indices.to_numpy().astype(np.int64)
        found = named.dictionary.to_numpy()
        points = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], 1).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        self.names = pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())


def _sizes(items: pa.Array) -> np.ndarray:
    size = pc.list_value_length(items) if pa.types.is_list(items.type) else pc.binary_length(items)
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False)


def _pieces(batch: pa.RecordBatch, items: str = _ITEMS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``PIECE`` items; a longer text is one of its own."""
    ends = np.cumsum(_sizes(batch[items]), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def in_texts(
    df: DataFrame,
    keys: Sequence[str],
    items: Column,
    count: Callable[..., tuple[np.ndarray, list[pa.Array]]],
    added: str,
    piece: type[Piece] = Piece,
    others: Sequence[str] = (),
) -> DataFrame:
    """(keys, added): ``count`` gives rows of the texts of a piece, as their number in it and columns.

    It takes the piece, and what its texts have of the columns ``others``.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                row, columns = count(piece(part[_ITEMS]), *[part[c] for c in others])
                taken = [part[c].take(pa.array(row)) for c in names]
                yield pa.record_batch([*taken, *columns], [*names, *new])

    rows = df.select(*names, *others, items.alias(_ITEMS))
    fields = T.StructType.fromDDL(added)
    new = fields.names
    schema = T.StructType([*rows.select(*names).schema.fields, *fields.fields])
    return rows.mapInArrow(run, schema)


def item_counts(
    df: DataFrame,
    keys: Sequence[str],
    items: Column,
    name: str,
    n: str = "n",
    blank: bool = False,
    piece: type[Piece] = Piece,
) -> DataFrame:
    """(keys, name, n): the distinct items of each row's array and their counts.

    ``blank`` gives a row without items a null that occurs 0 times; else it has none.
    With ``Trigrams`` the items are those of a text.
    """

    def count(texts: Piece) -> tuple[np.ndarray, list[pa.Array]]:
        row, code, many = texts.counts()
        value, many = texts.text(code).cast(pa.string()), pa.array(many, pa.int64())
        if blank:
            without = np.flatnonzero(texts.length == 0)
            row = np.concatenate([row, without])
            value = pa.concat_arrays([value, pa.nulls(len(without), pa.string())])
            many = pa.concat_arrays([many, pa.array(np.zeros(len(without)), pa.int64())])
        return row, [value, many]

    return in_texts(df, keys, items, count, f"`{name}` string, `{n}` long", piece)
