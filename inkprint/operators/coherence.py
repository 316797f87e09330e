"""Word pairs inside texts: counts, PMI, most frequent pairs.

Pairs are counted inside their text's row (``in_text``), so neither the text nor its pairs are
shuffled or sorted over the table. What is shuffled are sums: a few rows for each text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.binding import let
from inkprint.functions.patterns import BIGRAM_SLOTS
from inkprint.functions.text import pair_label, vectorizer_tokens, word_tokens
from inkprint.operators.identity import each_text
from inkprint.operators.in_text import Piece, in_texts, item_counts
from inkprint.session import materialize

COHERENCE_COLUMNS = ["avg_pmi", "avg_npmi"]


def bigram_columns(slots: int = BIGRAM_SLOTS) -> list[str]:
    return [f"bigram{i}" for i in range(slots)]


def tokens_by_text(
    df: DataFrame, keys: Sequence[str], text: str = "text", lower: bool = True
) -> DataFrame:
    """(keys, tokens)."""
    column = F.lower(F.col(text)) if lower else F.col(text)
    return df.select(*keys, word_tokens(column).alias("tokens"))


def placed(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, text), partitioned by key while the texts are still whole."""
    return df.select(*keys, text).repartition(*[F.col(k) for k in keys])


def token_rows(
    df: DataFrame, keys: Sequence[str], text: str = "text", lower: bool = True
) -> DataFrame:
    """(keys, pos, tok): one row per token, positions from 0."""
    tokens = tokens_by_text(df, keys, text, lower)
    return tokens.select(*keys, F.posexplode("tokens").alias("pos", "tok"))


def token_stats(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Token count, distinct token count and pair count of each text."""
    return tokens_by_text(df, keys, text).select(
        *keys,
        F.size("tokens").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"),
        F.greatest(F.size("tokens") - 1, F.lit(0)).cast("long").alias("n_pairs"),
    )


def adjacent_pairs(
    df: DataFrame, keys: Sequence[str], text: str = "text", lower: bool = True
) -> DataFrame:
    """(keys, pos, first, second): each token with its successor."""
    following = F.slice(F.col("tokens"), 2, F.greatest(F.size("tokens") - 1, F.lit(0)))
    both = tokens_by_text(df, keys, text, lower).select(
        *keys, F.col("tokens").alias("first"), following.alias("second")
    )
    return (
        both.select(*keys, F.posexplode(F.arrays_zip("first", "second")).alias("pos", "pair"))
        .select(*keys, "pos", "pair.first", "pair.second")
        .filter(F.col("second").isNotNull())
    )


def pair_word_counts(
    df: DataFrame, keys: Sequence[str], text: str = "text", unique: bool = False
) -> DataFrame:
    """(keys, first, second, k, c1, c2): each pair of a text with the counts of its words.

    Every row is a text of its own, whether its keys name it or not.
    """

    def count(piece: Piece) -> tuple[np.ndarray, list[pa.Array]]:
        row, first, second, *counts = piece.pairs()
        words = [piece.text(first).cast(pa.string()), piece.text(second).cast(pa.string())]
        return row, [*words, *[pa.array(c, pa.int64()) for c in counts]]

    added = "first string, second string, k long, c1 long, c2 long"
    return in_texts(df, keys, word_tokens(F.lower(F.col(text))), count, added)


def pmi(k: np.ndarray, n: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """ln of the pair probability over the product of its word probabilities."""
    return np.log((k / (n - 1)) / ((c1 / n) * (c2 / n)))


def pair_features(piece: Piece, slots: int = BIGRAM_SLOTS) -> list[pa.Array]:
    """For each text the means of PMI and NPMI over its distinct pairs, and its highest pair counts.

    A text without a pair has zeros.
    """
    row, _, _, k, c1, c2 = piece.pairs()
    n, texts = piece.length[row], len(piece.length)
    score = pmi(k, n, c1, c2)
    # A text that is one pair over and over has no information and scores 0.
    information = -np.log(np.where(k < n - 1, k / (n - 1), 1.0))
    normed = np.divide(score, information, out=np.zeros_like(score), where=k < n - 1)
    width = np.bincount(row, minlength=texts)
    means = [np.bincount(row, v, texts) / np.maximum(width, 1) for v in (score, normed)]
    falling = np.lexsort((-k, row))
    place = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    high = place < slots
    tops = np.zeros((slots, texts))
    tops[place[high], row[falling][high]] = k[falling][high]
    return [pa.array(v) for v in (*means, *tops)]


def scores_by_count(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, k, m, pmi, npmi): the m pairs that occur k times in a text, and sums of their scores.

    A text without a pair has one row, with m = 0.
    """

    def count(piece: Piece) -> tuple[np.ndarray, list[pa.Array]]:
        row, _, _, k, c1, c2 = piece.pairs()
        n = piece.length[row]
        score = pmi(k, n, c1, c2)
        # A text that is one pair over and over has no information and scores 0.
        information = -np.log(np.where(k < n - 1, k / (n - 1), 1.0))
        normed = np.divide(score, information, out=np.zeros_like(score), where=k < n - 1)
        size = int(k.max(initial=0)) + 1
        found, place, m = np.unique(row * size + k, return_inverse=True, return_counts=True)
        sums = [np.bincount(place, v, len(found)) for v in (score, normed)]
        without = np.flatnonzero(piece.length < 2)
        none = np.zeros(len(without))
        columns = [np.concatenate([c, none]) for c in (found % size, m, *sums)]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        rows = np.concatenate([found // size, without])
        return rows, [pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds)]

    added = "k long, m long, pmi double, npmi double"
    return in_texts(df, keys, word_tokens(F.lower(F.col(text))), count, added)


def top_counts(histogram: Column, slots: int | Column) -> Column:
    """Highest counts, descending, padded with zeros.

    ``histogram`` holds (k, m) structs: m pairs occur k times. It has few entries,
    as a text of n tokens cannot have more than about sqrt(2n) different counts.
    """
    slots = F.lit(slots) if isinstance(slots, int) else slots
    falling = F.sort_array(histogram, asc=False)
    counts = F.flatten(
        F.transform(
            falling, lambda h: F.array_repeat(h["k"], F.least(h["m"], slots).cast("int"))
        )
    )
    return F.slice(F.concat(counts, F.array_repeat(F.lit(0).cast("long"), slots)), 1, slots)


def coherence_features(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    slots: int = BIGRAM_SLOTS,
    unique: bool = False,
) -> DataFrame:
    """avg_pmi, avg_npmi over distinct pairs, and the highest pair counts of each text."""

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        return _coherence(scores_by_count(rows, keys, text), keys, slots)

    return each_text(df, keys, [text], work, unique)


def _coherence(by_count: DataFrame, keys: list[str], slots: int) -> DataFrame:
    total = F.sum("m")
    summary = by_count.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("pmi"), total), F.lit(0.0)).alias("avg_pmi"),
        F.coalesce(F.try_divide(F.sum("npmi"), total), F.lit(0.0)).alias("avg_npmi"),
        F.collect_list(F.when(F.col("m") > 0, F.struct("k", "m"))).alias("_histogram"),
    )
    top = summary.withColumn("_top", top_counts(F.col("_histogram"), slots))
    return top.select(
        *keys,
        "avg_pmi",
        "avg_npmi",
        *[F.get("_top", F.lit(i)).cast("double").alias(c) for i, c in enumerate(bigram_columns(slots))],
    )


def bigrams_of(text: Column, strict: bool = False) -> Column:
    """The lower-cased pairs ``a_b`` of a raw text in order; for ``strict`` see ``bigram_bag``."""
    following = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    label = lambda a, b: F.lower(pair_label(a, b))
    # The last token has no successor.
    labels = let(
        word_tokens(text),
        lambda t: F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), following(t), label),
    )
    return F.flatten(F.transform(labels, vectorizer_tokens)) if strict else labels


def bigram_bag(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    strict: bool = False,
    unique: bool = False,
) -> DataFrame:
    """(keys, bigram, n): lower-cased pairs ``a_b`` of a raw text with their counts.

    ``strict`` reads the joined pair once more the way a word vectorizer does: one
    character parts and punctuation vanish, ``don't_go`` falls apart. Every row is a text
    of its own, whether its keys name it or not.
    """
    return item_counts(df, keys, bigrams_of(F.col(text), strict), "bigram")


def top_bigram_counts(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    slots: int = BIGRAM_SLOTS,
    strict: bool = False,
    unique: bool = False,
) -> DataFrame:
    """(keys, counts): the highest counts in each text's bag of bigrams.

    The bag is a row over the corpus vocabulary, so it is padded with zeros, but
    never beyond the size of that vocabulary.
    """

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        bag = bigram_bag(rows, keys, text, strict, unique=True)
        by_count = bag.groupBy(*keys, F.col("n").alias("k")).agg(F.count(F.lit(1)).alias("m"))
        tops = materialize(by_count.groupBy(*keys).agg(F.collect_list(F.struct("k", "m")).alias("_histogram")))
        # The size of the vocabulary, as far as it matters: mostly one text alone has enough pairs.
        distinct = F.aggregate("_histogram", F.lit(0).cast("long"), lambda s, x: s + x["m"])
        widest = tops.agg(F.max(distinct)).first()[0] or 0
        known = F.lit(slots) if widest >= slots else F.lit(bag.select("bigram").distinct().limit(slots).count())
        everyone = rows.select(*keys).repartition(*[F.col(k) for k in keys])
        empty = F.array().cast("array<struct<k:bigint,m:bigint>>")
        histogram = F.coalesce(F.col("_histogram"), empty)
        return (
            everyone.join(tops, list(keys), "left")
            .select(*keys, top_counts(histogram, known.cast("int")).alias("counts"))
        )

    return each_text(df, keys, [text], work, unique)
