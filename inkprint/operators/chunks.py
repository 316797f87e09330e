"""Over-long texts: cut them up, and bring the scores of the pieces together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.patterns import CHUNK_SIZE
from inkprint.functions.text import chunks


def is_over_length(text: str = "text", max_size: int = CHUNK_SIZE):
    """More than ``max_size`` characters (code points)."""
    return F.length(F.col(text)) > max_size


def over_length(df: DataFrame, text: str = "text", max_size: int = CHUNK_SIZE) -> DataFrame:
    return df.filter(is_over_length(text, max_size))


def within_length(df: DataFrame, text: str = "text", max_size: int = CHUNK_SIZE) -> DataFrame:
    """The complement of :func:`over_length`; a missing text counts as short."""
    return df.filter(~F.coalesce(is_over_length(text, max_size), F.lit(False)))


def text_chunks(
    df: DataFrame, keys: Sequence[str], text: str = "text", size: int = CHUNK_SIZE
) -> DataFrame:
    """(keys, chunk_no, text): every text in slices of ``size`` characters."""
    return df.select(*keys, F.posexplode(chunks(F.col(text), size)).alias("chunk_no", text))


def split_over_length(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    max_size: int = CHUNK_SIZE,
    chunk_size: int = CHUNK_SIZE,
) -> DataFrame:
    """Rows up to ``max_size`` as they are, the others as one row per chunk.

    ``max_size`` only selects; pieces are ``chunk_size`` wide. Chunk rows keep keys,
    text and ``chunk_no``, their other columns are null.
    """
    over = F.coalesce(is_over_length(text, max_size), F.lit(False))
    pieces = F.when(over, chunks(F.col(text), chunk_size)).otherwise(F.array(F.col(text)))
    others = [
        F.when(~over, F.col(f"`{c}`")).alias(c) for c in df.columns if c not in (*keys, text)
    ]
    # One pass over the texts: a short one is its own only piece.
    return df.select(*keys, *others, F.posexplode(pieces).alias("chunk_no", text))


def mean_by_id(df: DataFrame, keys: Sequence[str], score: str = "perplexity") -> DataFrame:
    """Mean score per id; pieces count alike, nulls and NaN are left out."""
    value = F.nanvl(F.col(score).cast("double"), F.lit(None))
    return df.groupBy(*keys).agg(F.avg(value).alias(score))
