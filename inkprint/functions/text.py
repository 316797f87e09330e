"""Text functions: column in, column out, no shuffle and no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkprint.functions.entities import unescape
from inkprint.functions.patterns import (
    CHUNK_SIZE,
    MARKUP_JAVA,
    NON_SPACE,
    PUNCTUATION,
    SENTENCE_END,
    SENTENCE_MARK,
    VECTORIZER_TOKEN,
    WORD,
)


def strip_markup(html: Column) -> Column:
    """Drop tags, comments, declarations and script, style and template content."""
    return F.when(html.contains("<"), F.regexp_replace(html, MARKUP_JAVA, "")).otherwise(html)


def clean_text(html: Column) -> Column:
    """Text of a page. References are decoded twice, so ``&amp;lt;`` ends as ``<``."""
    marked = html.contains("<") | html.contains("&")
    return F.when(marked, unescape(unescape(strip_markup(html)))).otherwise(html)


def word_tokens(text: Column) -> Column:
    """Words and punctuation marks of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences of a text; blank ones are dropped."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK, -1), lambda s: s.rlike(NON_SPACE))


def words_in(sentence: Column) -> Column:
    """Number of words separated by white space."""
    return F.regexp_count(sentence, F.lit(NON_SPACE))


def sentence_lengths(text: Column) -> Column:
    """Words per sentence."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + SENTENCE_MARK)
    lengths = F.transform(F.split(marked, SENTENCE_MARK, -1), words_in)
    return F.filter(lengths, lambda n: n > 0)


def is_counted_word(token: Column) -> Column:
    """True unless the token occurs inside the punctuation string.

    ``()`` does, ``...`` and ``--`` do not, so those two count as words.
    """
    return ~F.lit(PUNCTUATION).contains(token)


def vectorizer_tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(text, F.lit(VECTORIZER_TOKEN), F.lit(0))


def pair_label(first: Column, second: Column) -> Column:
    """``a_b`` for a pair of words."""
    return F.concat_ws("_", first, second)


def chunks(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Consecutive slices of ``size`` characters; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def first_tokens(tokens: Column, limit: int) -> Column:
    """The first ``limit`` tokens, as a model with bounded input reads them."""
    return F.slice(tokens, 1, limit)


def file_stem(path: Column) -> Column:
    """Base name of a path without its last extension."""
    base = F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def source_stem(path: Column) -> Column:
    """Stem of the source a file belongs to, a folder if a writer cut it into part files.

    Part files are named ``part-`` and a number; folders of partition values lie between.
    """
    whole = F.regexp_replace(path, r"(?:/[^/=]+=[^/]*)*/part-[0-9]+[^/]*$", "")
    return file_stem(whole)


def char_trigrams(text: Column) -> Column:
    """All overlapping three-character substrings, found in one pass."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))
