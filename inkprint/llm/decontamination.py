"""Documents that hold passages of a benchmark, by the q-gram lemma.

Benchmark texts are cut into pieces of ``PIECE`` characters that overlap by half. A place in a
document that matches a piece of length L with at most e edits shares at least
``L - Q + 1 - Q * e`` of its q-grams, and all of them lie on e + 1 neighbouring diagonals
(place in the document less place in the piece). So shared q-grams are counted in bands of
2 e diagonals that overlap by e; bands that reach the bound are kept, and the text that they
cover is aligned with the piece.

Benchmark texts of fewer than ``MIN_CHARS`` characters leave no room for an edit. They are matched
whole, without edits and between word borders, by one automaton a block.

Texts are compared in lower case with white space reduced to single spaces. The benchmark is
read in blocks of ``BLOCK_CHARS``; the index of one block is broadcast, and documents pass all
blocks in turn within their task, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.alignment import best_inside, places
from inkprint.llm.common import in_pieces, texts_of, unused

Q = 8
PIECE = 80
ERRORS = 0.08
MIN_CHARS = 32
BLOCK_CHARS = 1 << 20
_TABLE_BITS = 22
_BASE = 0x9E3779B97F4A7C15
_HITS = "array<struct<item:string,start:long,end:long,edits:int>>"
_HITS_ARROW = pa.list_(
    pa.struct(
        [("item", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]
    )
)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of eight characters, by doubling."""
    h, width = codes.astype(np.uint64), 1
    while width < Q:
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return h


@dataclass
class Piece:
    """A part of a benchmark text, with the edits it may have and the q-grams to share."""

    item: str | None
    text: str
    budget: int
    least: int

    def __post_init__(self) -> None:
        self.forward, self.backward = places(self.text), places(self.text[::-1])


def pieces_of(item: str | None, text: str) -> Iterator[Piece]:
    text = normal(text)
    if len(text) < MIN_CHARS:
        return
    last = max(0, len(text) - PIECE)
    for start in sorted({*range(0, last, PIECE // 2), last}):
        part = text[start : start + PIECE]
        budget = int(ERRORS * len(part))
        yield Piece(item, part, budget, len(part) - Q + 1 - Q * budget)


class Index:
    """The q-grams of some pieces, and the regions of a text that match a piece."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces
        grams = [_grams(_codes(p.text)) for p in pieces]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.begin, self.count = np.unique(
            every[order], return_index=True, return_counts=True
        )
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.keys)] = True
        self.budget = np.array([p.budget for p in pieces], np.int64)
        self.least = np.array([p.least for p in pieces], np.int64)
        self.span = max(len(p.text) + 2 * p.budget for p in pieces)
        self.gap = "\n" * (int(self.budget.max()) + 1)

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of q-grams of the index, where enough lie close together, and their keys."""
        grams = _grams(codes)
        at = np.flatnonzero(self.table[self._slot(grams)])
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        known = self.keys[key] == grams[at]
        at, key = at[known], key[known]
        few = int(self.least.min())
        if len(at) < few:
            return at[:0], key[:0]
        close = at[few - 1 :] - at[: len(at) - few + 1] < self.span
        depth = np.zeros(len(at) + 1, np.int64)
        depth[: len(close)] += close
        depth[few:] -= close
        dense = np.cumsum(depth)[:-1] > 0
        return at[dense], key[dense]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, str | None, int, int, int]]:
        """(number of the text, item, start, end, edits) within normalised texts."""
        joined = self.gap.join(texts)
        at, key = self._shared(_codes(joined))
        if not len(at):
            return
        n = self.count[key]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        posting = np.repeat(self.begin[key], n) + offset
        piece = self.owner[posting]
        diagonal = np.repeat(at, n) - self.place[posting] + PIECE  # never below zero
        band = diagonal // self.budget[piece]
        total = len(self.pieces)
        found, shared = np.unique(
            np.concatenate([band * total + piece, (band - 1) * total + piece]), return_counts=True
        )
        found = found[shared >= self.least[found % total]]
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + len(self.gap)) - lengths - len(self.gap)
        for number in found.tolist():
            piece = self.pieces[number % total]
            low = number // total * piece.budget - PIECE
            begin = max(0, low)
            region = joined[begin : low + 2 * piece.budget + len(piece.text)]
            edits, end = best_inside(piece.forward, len(piece.text), region)
            if edits <= piece.budget:
                _, back = best_inside(piece.backward, len(piece.text), region[:end][::-1])
                start, end = begin + end - back, begin + end
                text = int(np.searchsorted(starts, start, "right")) - 1
                yield text, piece.item, start - int(starts[text]), end - int(starts[text]), edits


def _is_border(text: str, at: int) -> bool:
    """Whether no word of letters and digits goes on across this place."""
    return at in (0, len(text)) or not (text[at - 1].isalnum() and text[at].isalnum())


class ShortTexts:
    """Whole short texts, each under the least item that has it, and the places where they stand."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.automaton = ahocorasick.Automaton()
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or "")):
            if text not in self.automaton:
                self.automaton.add_word(text, (item, len(text)))
        self.automaton.make_automaton()

    def matches(self, texts: list[str]) -> Iterator[tuple[int, str | None, int, int, int]]:
        """(number of the text, item, start, end, edits) within normalised texts."""
        for number, text in enumerate(texts):
            for last, (item, length) in self.automaton.iter(text):
                start, end = last + 1 - length, last + 1
                if _is_border(text, start) and _is_border(text, end):
                    yield number, item, start, end, 0


def _merged(hits: list[tuple]) -> list[tuple]:
    """Overlapping matches of one item become one, with the most edits of any."""
    out: list[tuple] = []
    for item, start, end, edits in sorted(hits, key=lambda h: (h[0] or "", h[0] is None, h[1:])):
        if out and out[-1][0] == item and start <= out[-1][2]:
            _, s, e, m = out[-1]
            out[-1] = (item, s, max(e, end), max(m, edits))
        else:
            out.append((item, start, end, edits))
    return out


def _origin(text: str) -> list[int]:
    """For each character of the normalised text its place in the text, and the end."""
    at: list[int] = []
    previous_end = 0
    place = 0
    for word in text.split():
        place = text.index(word, previous_end)
        if at:
            at.append(previous_end)
        for i, character in enumerate(word):
            at += [place + i] * len(character.lower())
        previous_end = place + len(word)
    return [*at, previous_end]


def _searcher(indexes: list):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = texts_of(column)
            out = []
            for a, b in in_pieces(map(len, texts)):
                some = [normal(t) for t in texts[a:b]]
                hits: list[list[tuple]] = [[] for _ in some]
                for index in indexes:
                    for number, *hit in index.value.matches(some):
                        hits[number].append(tuple(hit))
                for text, found in zip(texts[a:b], hits, strict=True):
                    rows = []
                    if found:
                        at = _origin(text)
                        for item, start, end, edits in _merged(found):
                            if end > start:
                                rows.append(
                                    {"item": item, "start": at[start], "end": at[end - 1] + 1, "edits": edits}
                                )
                    out.append(rows)
            yield pa.array(out, _HITS_ARROW)

    return run


def benchmark_hits(
    benchmark: DataFrame,
    text: Column,
    item_column: str = "item_id",
    text_column: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> Column:
    """A column with the places in ``text`` that match a benchmark text, as an array.

    Each entry has the item (as text), start and end (code points, end exclusive) and the edits
    of its worst piece. A match is a piece of ``PIECE`` characters, or a shorter text as a
    whole, with edits of up to ``ERRORS`` of its length. A benchmark text shorter than
    ``MIN_CHARS`` matches whole between word borders, without edits; of items with one short text
    the least is reported. A benchmark text that is null or blank has no matches, nor has a null
    or empty text. An item that is null is reported as null. The column does not depend
    on other columns of the documents. The driver holds one block of the benchmark at a time.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text")
    ).filter("text IS NOT NULL")
    blocks, block, short, chars = [], [], [], 0
    share = spark.sparkContext.broadcast

    def close() -> None:
        if block:
            blocks.append(share(Index(block)))
        if short:
            blocks.append(share(ShortTexts(short)))

    for row in items.toLocalIterator():
        block += pieces_of(row["item"], row["text"])
        whole = normal(row["text"])
        if 0 < len(whole) < MIN_CHARS:
            short.append((row["item"], whole))
        chars += len(row["text"])
        if chars >= block_chars:
            close()
            block, short, chars = [], [], 0
    close()
    if not blocks:
        return F.array().cast(_HITS)
    return F.arrow_udf(_searcher(blocks), _HITS, F.ArrowUDFType.SCALAR_ITER)(text)


def without_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    least_chars: int = MIN_CHARS,
    **settings,
) -> DataFrame:
    """The documents without a match of ``least_chars`` or more characters, with all their columns.

    A benchmark may hold answers such as ``yes``; ``benchmark_hits`` finds them, and they take a
    document away only if ``least_chars`` is set to their length. A matched place counts with one
    character of each edit, and with white space as in the text.
    """
    hits = unused(documents, "_hits")
    found = benchmark_hits(benchmark, F.col(text_column), **settings)
    # A longer text may lose letters to edits and still be one; those without edits are short.
    evident = F.exists(hits, lambda h: h["end"] - h["start"] + h["edits"] >= least_chars)
    return documents.withColumn(hits, found).filter(~evident).drop(hits)
