"""Periodic runs of words: stretches in which a short passage is repeated over and over.

In a run of period q that is ``EXPONENT`` periods long every word occurs ``EXPONENT`` times at
least. So a word that is rarer than that within its segment (first the whole text) cannot be in a
run there and splits the segment; words that were frequent enough may be too rare in the smaller
segments, which are split again until nothing changes. Ordinary prose falls apart to nothing.

Segments that are left are scanned by lags. A run of lag q holds a multiple of q among its first q
places, and from there its words equal those q further on for two periods at least. So a lag is
tried at its multiples alone, by hashes of prefixes, n / q places of a segment of n words; what agrees
is compared word by word and extended to both sides. A place within a run that a smaller lag found
belongs to that run, as its lag is a multiple of that run's period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import in_pieces, mixed, texts_of
from inkprint.llm.words import Words

#: Words of a run: so many, and so many periods.
SHORTEST = 6
EXPONENT = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def segments(
    codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int, exponent: int
) -> list[tuple[int, int]]:
    """The parts of [start, end) ranges in which each code occurs ``exponent`` times or more.

    All ranges are split together. Ranges below ``shortest`` are left out. Codes that stand for
    two words make a word look more frequent, so that nothing is lost by them.
    """
    stable: list[tuple[int, int]] = []
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    while len(starts):
        sizes = ends - starts
        segment = np.repeat(np.arange(len(starts)), sizes)
        first = np.cumsum(sizes) - sizes
        at = np.arange(len(segment)) + np.repeat(starts - first, sizes)
        keys = mixed(codes[at] + segment.astype(np.uint64) * _BASE)
        _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        rare = counts[which] < exponent
        split = np.logical_or.reduceat(rare, first)
        stable += zip(starts[~split].tolist(), ends[~split].tolist(), strict=True)
        keep = ~rare & split[segment]
        # A stretch of words that stay begins where the one before goes, or at a segment's start.
        before = np.zeros(len(keep), bool)
        before[1:] = keep[:-1]
        before[first] = False
        after = np.zeros(len(keep), bool)
        after[:-1] = keep[1:]
        after[first + sizes - 1] = False
        starts, ends = at[keep & ~before], at[keep & ~after] + 1
        long = ends - starts >= shortest
        starts, ends = starts[long], ends[long]
    return sorted(stable)


def _agree_until(codes: np.ndarray, lag: int, at: int) -> int:
    """The first place from ``at`` whose code differs from that ``lag`` further on."""
    last, step = len(codes) - lag, 256
    while at < last:
        upto = min(last, at + step)
        differ = codes[at:upto] != codes[at + lag : upto + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = upto, step * 2
    return last


def _agree_since(codes: np.ndarray, lag: int, at: int) -> int:
    """The first place such that all codes from there up to ``at`` agree with those ``lag`` on."""
    step = 256
    while at > 0:
        low = max(0, at - step)
        differ = codes[low:at] != codes[low + lag : at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = low, step * 2
    return 0


def lag_scan(codes: np.ndarray, shortest: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of numbers, for an exponent from 3.

    Takes about n log n steps for n numbers, and memory for n.
    """
    n, largest = len(codes), len(codes) // exponent
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers[:n], out=prefix[1:])
    runs: list[tuple[int, int, int]] = []
    low = 1
    while low <= largest:
        # No lag of one round is a multiple of another.
        high = min(2 * low, largest + 1)
        lags = np.arange(low, high)
        tries = (n - (exponent - 1) * lags) // lags + 1
        lag = np.repeat(lags, tries)
        place = lag * (np.arange(len(lag)) - np.repeat(np.cumsum(tries) - tries, tries))
        width = (exponent - 2) * lag
        here = prefix[place + width] - prefix[place]
        there = prefix[place + lag + width] - prefix[place + lag]
        agree = here * powers[lag] == there
        lag, place = lag[agree], place[agree]
        if runs and len(lag):
            known = np.array(sorted(runs))
            reach = np.maximum.accumulate(known[:, 0] + known[:, 1])
            left_of = np.searchsorted(known[:, 0], place, "right") - 1
            inside = (left_of >= 0) & (reach[left_of] >= place + (exponent - 1) * lag)
            lag, place = lag[~inside], place[~inside]
        last_lag, last_end = 0, 0
        for q, p in zip(lag.tolist(), place.tolist(), strict=True):
            if q == last_lag and p + (exponent - 1) * q <= last_end:
                continue
            start, end = _agree_since(codes, q, p), _agree_until(codes, q, p) + q
            last_lag, last_end = q, end
            if start <= p and end - start >= max(shortest, exponent * q):
                runs.append((start, end - start, q))
        low = high
    return runs


def _exact_codes(words: Words, first: int, last: int) -> np.ndarray:
    """Numbers for words, equal where their bytes are."""
    numbers: dict[bytes, int] = {}
    spelled = words.text(first, last).split(b" ")
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in spelled), np.int64, last - first)


def _kept_text(words: Words, begin: int, end: int, runs: list[tuple[int, int, int]]) -> bytes:
    """The words from ``begin`` to ``end`` without what runs repeat; runs by start."""
    parts, at = [], begin
    for start, length, period in runs:
        cut = begin + start + period
        if cut > at:
            parts.append(words.text(at, cut))
        at = max(at, begin + start + length)
    if end > at:
        parts.append(words.text(at, end))
    return b" ".join(parts)


def _scanned(shortest: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in in_pieces(map(len, texts)):
                words = Words([t.encode() for t in texts[a:b]])
                upto = np.cumsum(words.count)
                begin = upto - words.count
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
                for first, last in segments(words.hashes, begin, upto, shortest, exponent):
                    text = int(np.searchsorted(upto, first, "right"))
                    offset = first - int(begin[text])
                    for start, length, period in lag_scan(_exact_codes(words, first, last), shortest, exponent):
                        found[text].append((offset + start, length, period))
                runs, kept = [], []
                for i, own in enumerate(found):
                    own.sort(key=lambda r: (r[0], r[2]))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    kept.append(_kept_text(words, int(begin[i]), int(upto[i]), own).decode())
                yield pa.record_batch(
                    [
                        batch["id"].slice(a, b - a),
                        pa.array(words.count, pa.int64()),
                        pa.array(runs, pa.list_(_RUN)),
                        pa.array(kept, pa.string()),
                    ],
                    ["id", "n_words", "runs", "kept_text"],
                )

    return run


def with_runs(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shortest: int = SHORTEST,
    exponent: int = EXPONENT,
) -> DataFrame:
    """The periodic runs of each text, and the text without what they repeat.

    Returns the id, ``n_words``, ``runs`` and ``kept_text`` for each row. Words are what is between
    ASCII white space. A run is a stretch of ``shortest`` words or more in which words ``period``
    apart are equal, ``exponent`` times (3 or more) that smallest period long or longer, which no
    neighbouring word extends. ``runs`` are (start, length, period) by start, then period, in words
    from 0. In ``kept_text`` words are joined by one space, and of each run only the first period
    stays; a word that several runs share goes if one of them drops it.

    A null or empty text, or one of white space, has no words, no runs and an empty kept text. Every
    row is a text of its own, if its id repeats or is null or not. Texts are read whole, with memory
    in proportion to a text. Other columns are not read. An empty table gives no row.
    """
    if exponent < 3:
        raise ValueError("a run is at least three periods long")
    kind = documents.select(F.col(id_column)).schema[0].dataType.simpleString()
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(
        _scanned(shortest, exponent),
        f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string",
    )
    return found.withColumnRenamed("id", id_column)


__all__ = ["EXPONENT", "SHORTEST", "lag_scan", "segments", "with_runs"]
