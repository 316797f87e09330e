"""Language by n-gram filters that answer with all languages at once.

For each language the n-grams of letters that occur in at least ``MIN_SHARE`` of its sample are
put into a Bloom filter. The filters are sliced by bits: one table of cells, and in each cell one
bit for each language, so one lookup of an n-gram (the cells of its hashes, and-ed) gives the
languages that hold it. For a text the bits of all its n-grams are counted by language, the share
that a filter answers by mistake is taken out, and the language with most n-grams wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import bounded_sample, in_pieces, mixed, texts_of
from inkprint.session import materialize

GRAM = 4
MIN_SHARE = 0.01
#: At most about so many documents of each language are learnt from.
SAMPLE = 3000
CELL_BITS = 20
HASHES = 3
_WORD = 64
UNKNOWN = "und"


class _Letters:
    """For code points: the lower-cased letter, or 0 for anything else. Grows as needed."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if found.size and found.min() < 0:
            for c in np.unique(codes[found < 0]).tolist():
                lower = chr(c).lower()
                self.table[c] = ord(lower[0]) if lower[0].isalpha() else 0
            found = self.table[codes]
        return found


def grams_of(texts: list[str], letters: _Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, how many each text has, and whether it has a letter.

    An n-gram is a run of four letters or single spaces, where whatever is no letter counts as
    one space and a text has a space on either side.
    """
    joined = "\x00".join(["", *texts, ""])
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes, edge = letters.of(raw), raw == 0
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.concatenate([np.repeat(np.arange(len(texts)), lengths), [len(texts)]])[: len(codes)]
    letter = codes > 0
    keep = letter | edge
    keep[1:] |= letter[:-1] & ~edge[1:]  # the first of several that are no letters
    codes, text, edge = codes[keep].astype(np.uint64), text[keep], edge[keep]
    keep = (codes > 0) | edge  # not a space before the end of a text
    keep[:-1] |= ~edge[1:]
    codes, text = codes[keep], text[keep]
    n = max(0, len(codes) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    # The space between two texts ends the first; an n-gram must not reach past it.
    inside = text[:n] == text[GRAM - 2 : GRAM - 2 + n]
    h, owner = mixed(h[inside]), text[:n][inside]
    has_letter = np.bincount(text[codes > 0], minlength=len(texts) + 1)[: len(texts)] > 0
    return h, np.bincount(owner, minlength=len(texts))[: len(texts)], has_letter


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language the n-grams of its texts, with the number of texts that have them."""
    letters = _Letters()
    for batch in batches:
        texts, langs = texts_of(batch["text"]), batch["lang"].to_pylist()
        for a, b in in_pieces(map(len, texts)):
            h, count, _ = grams_of(texts[a:b], letters)
            names = sorted(set(langs[a:b]))
            of = np.array([names.index(x) for x in langs[a:b]])
            owner = np.repeat(np.arange(b - a), count)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, lang = h[new], of[owner[new]]
            for i, name in enumerate(names):
                gram, n = np.unique(h[lang == i], return_counts=True)
                yield pa.record_batch(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )


class LanguageFilters:
    """The cells, the languages by bit, and how often each filter errs."""

    def __init__(self, languages: list[str], cells: np.ndarray):
        self.languages = languages
        self.cells = cells  # a row for each cell, a column for each 64 languages
        fill = [self._bit(cells, i).mean() for i in range(len(languages))]
        self.error = np.array(fill) ** HASHES

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // _WORD] >> np.uint64(i % _WORD)) & np.uint64(1)

    @staticmethod
    def slots(grams: np.ndarray, k: int) -> np.ndarray:
        return ((grams >> np.uint64(k * CELL_BITS)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)

    def predict(self, texts: list[str], letters: _Letters) -> tuple[list[str], list[float]]:
        h, count, has_letter = grams_of(texts, letters)
        masks = self.cells[self.slots(h, 0)]
        for k in range(1, HASHES):
            masks &= self.cells[self.slots(h, k)]
        owner = np.repeat(np.arange(len(texts)), count)
        held = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bits = self._bit(masks, i).astype(bool)
            held[:, i] = np.bincount(owner[bits], minlength=len(texts))
        held = np.maximum(0, (held - count[:, None] * self.error) / (1 - self.error))
        best = held.argmax(1)
        top, total = held.max(1), held.sum(1)
        score = np.where(total > 0, top / np.maximum(total, 1e-9), 0.0)
        names = [self.languages[i] if some else UNKNOWN for i, some in zip(best, has_letter, strict=True)]
        return names, np.where(has_letter, score, 0.0).tolist()


def fit_languages(
    labelled: DataFrame,
    lang_column: str = "lang",
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
    min_share: float = MIN_SHARE,
) -> LanguageFilters | None:
    """Learn filters from texts with a language; null languages are left out.

    Of each language about ``sample`` documents at most are read, drawn by a hash of the id.
    The driver gets the cells, 8 MB for each 64 languages, whatever the number of n-grams.
    Returns None if there is no labelled text.
    """
    rows = labelled.select(
        F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text")
    ).filter("lang IS NOT NULL")
    drawn = bounded_sample(rows, "id", "lang", sample)
    found = materialize(
        drawn.select("lang", "text").mapInArrow(_distinct, "lang string, gram long, n long")
    )
    sizes = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    least = F.lit(0.0)
    number = F.lit(0)
    for i, lang in enumerate(languages):
        least = F.when(F.col("lang") == lang, F.lit(max(1.0, min_share * sizes[lang]))).otherwise(least)
        number = F.when(F.col("lang") == lang, F.lit(i)).otherwise(number)
    held = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    slots = F.array(
        *[F.shiftrightunsigned("gram", k * CELL_BITS).bitwiseAND(F.lit((1 << CELL_BITS) - 1)) for k in range(HASHES)]
    )
    cells = (
        held.select(number.alias("i"), F.explode(slots).alias("cell"))
        .groupBy("cell", F.expr(f"i div {_WORD}").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, i % {_WORD})")).alias("mask"))
        .toArrow()
    )
    table = np.zeros((1 << CELL_BITS, -(-len(languages) // _WORD)), np.uint64)
    if cells.num_rows:
        at = (cells["cell"].to_numpy(), cells["word"].to_numpy().astype(np.int64))
        table[at] = cells["mask"].to_numpy().view(np.uint64)
    return LanguageFilters(languages, table)


_TYPE = "struct<lang:string,score:double>"


def detected(filters: LanguageFilters | None, text: Column, spark) -> Column:
    """(lang, score) of each text; ``und`` and 0 for a null text or one without a letter.

    A text whose n-grams no filter holds gets the first language with score 0; without filters
    every text is ``und``.
    """
    if filters is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(filters)  # of fixed size

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = _Letters()
        for column in columns:
            texts = texts_of(column)
            names, scores = [], []
            for a, b in in_pieces(map(len, texts)):
                some = shared.value.predict(texts[a:b], letters)
                names += some[0]
                scores += some[1]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"]
            )

    return F.arrow_udf(run, _TYPE, F.ArrowUDFType.SCALAR_ITER)(text)
