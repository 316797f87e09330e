"""Sentence and word statistics. Each text is measured inside its row: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.patterns import PUNCTUATION
from inkprint.functions.text import is_counted_word, sentence_lengths, word_tokens
from inkprint.operators.in_text import Piece

STYLE_COLUMNS = ["variability", "avg_sentence_length", "avg_word_length", "sentence_length_range"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def variability(lengths: Column) -> Column:
    """Population standard deviation, 0 for no sentence.

    From integer sums, so there is no rounding before the division.
    """
    n = F.size(lengths).cast("long")
    total = _total(lengths)
    squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.sqrt(n * squares - total * total) / n)


def average_sentence_length(lengths: Column) -> Column:
    return F.when(F.size(lengths) == 0, F.lit(0.0)).otherwise(_total(lengths) / F.size(lengths))


def sentence_length_range(lengths: Column) -> Column:
    return F.coalesce(F.array_max(lengths) - F.array_min(lengths), F.lit(0)).cast("double")


def average_word_length(word_lengths: Column) -> Column:
    """Mean length; null when no token counts as a word."""
    return F.when(F.size(word_lengths) > 0, _total(word_lengths) / F.size(word_lengths))


def sentence_features(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, statistics of sentence lengths) of each row."""
    measured = df.select(*keys, sentence_lengths(F.col(text)).alias("_sentences"))
    lengths = F.col("_sentences")
    return measured.select(
        *keys,
        variability(lengths).alias("variability"),
        average_sentence_length(lengths).alias("avg_sentence_length"),
        sentence_length_range(lengths).alias("sentence_length_range"),
    )


def word_lengths_of(piece: Piece) -> pa.Array:
    """For each text the mean length of its counted words; null when no token counts as one."""
    names = piece.names.cast(pa.string())
    counted = np.array([x not in PUNCTUATION for x in names.to_pylist()], bool)
    length, texts = pc.utf8_length(names).to_numpy() * counted, len(piece.length)
    n = np.bincount(piece.row, counted[piece.code], texts)
    total = np.bincount(piece.row, length[piece.code], texts)
    return pa.array(total / np.maximum(n, 1), mask=n == 0)


def style_features(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The four style statistics of each row."""
    words = F.filter(word_tokens(F.lower(F.col(text))), is_counted_word)
    measured = df.select(
        *keys,
        F.col(text).alias("_text"),
        average_word_length(F.transform(words, F.length)).alias("avg_word_length"),
    )
    return sentence_features(measured, [*keys, "avg_word_length"], "_text").select(*keys, *STYLE_COLUMNS)
