"""The whole feature table of a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.patterns import STRIDE, TAGS_MONO, TAGS_MULTI, WINDOW_TOKENS
from inkprint.functions.text import clean_text, word_tokens
from inkprint.operators import coherence
from inkprint.operators.chunks import mean_by_id, split_over_length
from inkprint.operators.identity import ROW, text_rows
from inkprint.operators.in_text import Piece, in_texts
from inkprint.operators.language import LanguageProfiles, detect_language
from inkprint.operators.lexicon import spelling_errors, tag_column, tag_shares_of
from inkprint.operators.perplexity import BigramModel, perplexity
from inkprint.operators.scaling import Stats, scale_by_max, zscore
from inkprint.operators.style import STYLE_COLUMNS, sentence_features, word_lengths_of
from inkprint.session import materialize


def feature_names(multilingual: bool) -> list[str]:
    """Feature columns in file order, without id and perplexity."""
    tags = TAGS_MULTI if multilingual else TAGS_MONO
    names = [*STYLE_COLUMNS, "avg_pmi", "avg_npmi", *coherence.bigram_columns(), *map(tag_column, tags)]
    return names if multilingual else [*names, "spelling_error"]


def raw_features(
    documents: DataFrame,
    dictionary: DataFrame | None = None,
    profiles: LanguageProfiles | None = None,
    key: str = "id",
    text: str = "text",
) -> DataFrame:
    """One row of unscaled features per document.

    With a dictionary the monolingual set (Penn tags and spelling errors), with
    language profiles the multilingual one (universal tags by detected language).
    Tokens of a text are found once for what is counted in its row. Texts are partitioned
    by row, for the join with the parts that are not.
    """
    if (dictionary is None) == (profiles is None):
        raise ValueError("give either a dictionary or language profiles")
    # A missing text is measured as an empty one.
    present = F.coalesce(F.col(text), F.lit(""))
    cleaned = documents.select(key, clean_text(present).alias("text"))
    texts = text_rows(cleaned, key, ["text"])
    keys = [ROW]
    rows = coherence.placed(texts.rows, keys)
    if profiles is not None:
        found = detect_language(rows, keys, profiles, unique=True)
        table = _counted_inside(rows.join(found, ROW), list(TAGS_MULTI), ["language"])
    else:
        table = _counted_inside(rows, list(TAGS_MONO), [])
        table = table.join(spelling_errors(rows, keys, dictionary, unique=True), ROW, "left")
    names = feature_names(profiles is not None)
    return texts.by_key(table.select(ROW, *[F.col(n).cast("double").alias(n) for n in names]))


def _counted_inside(rows: DataFrame, tags: list[str], language: list[str]) -> DataFrame:
    """(row_id, features): style, coherence and tags of each text."""

    def count(piece: Piece, cased: pa.Array, *languages: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        shares = tag_shares_of(Piece(cased), tags, *languages)
        counted = [word_lengths_of(piece), *coherence.pair_features(piece), *shares]
        return np.arange(len(piece.length)), counted

    cased = rows.select(ROW, "text", *language, word_tokens(F.col("text")).alias("_cased"))
    # Lower case changes no border of a token, and of its letters only sigma depends on others.
    lowered = F.when(F.col("text").contains("\u03a3"), word_tokens(F.lower("text"))).otherwise(
        F.transform("_cased", F.lower)
    )
    tokens = cased.withColumn("_lowered", lowered)
    styled = sentence_features(tokens, [ROW, "_cased", "_lowered", *language])
    added = ["avg_word_length", *coherence.COHERENCE_COLUMNS, *coherence.bigram_columns(), *map(tag_column, tags)]
    return in_texts(
        styled, [c for c in styled.columns if c not in ("_cased", "_lowered", *language)], F.col("_lowered"), count, ", ".join(f"{c} double" for c in added),
        others=["_cased", *language],
    )


def document_perplexity(
    documents: DataFrame,
    model: BigramModel,
    key: str = "id",
    text: str = "text",
    stride: int = STRIDE,
    width: int = WINDOW_TOKENS,
) -> DataFrame:
    """(key, perplexity): over-long texts are scored in chunks, and chunks averaged.

    Chunks of all texts under one id, or without one, are averaged into one row.
    """
    texts = text_rows(documents, key, [text])
    pieces = split_over_length(texts.rows, [ROW], text)
    scored = perplexity(pieces, [ROW, "chunk_no"], model, text, stride, width, unique=True)
    return mean_by_id(texts.by_key(scored), [key])


def feature_table(
    raw: DataFrame, perplexities: DataFrame, key: str = "id", stats: Stats | None = None
) -> DataFrame:
    """Z-scored features joined with max-scaled perplexity; ids on one side only are dropped.

    So are rows without an id, as they meet nothing.

    Each corpus is scaled by its own statistics unless ``stats`` of another are given.
    """
    raw = materialize(raw)  # read twice: once for the statistics, once to scale
    scaled = zscore(raw, [key], stats)
    return scaled.join(scale_by_max(materialize(perplexities), "perplexity"), key)

