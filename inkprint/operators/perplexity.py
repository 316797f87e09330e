"""Perplexity under a bigram language model, over strided windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.patterns import STRIDE, WINDOW_TOKENS
from inkprint.functions.text import word_tokens
from inkprint.operators.coherence import tokens_by_text
from inkprint.operators.distribute import fits_broadcast, lookup
from inkprint.operators.identity import each_text
from inkprint.session import materialize


@dataclass(frozen=True)
class BigramModel:
    """``pairs`` is (prev, tok, c_pair, c_prev), ``contexts`` (prev, c_prev); both unique."""

    pairs: DataFrame
    contexts: DataFrame
    vocabulary: int


def fit_bigram_model(df: DataFrame, text: str = "text") -> BigramModel:
    """Count words and adjacent words of a training corpus.

    Both counts are sums, combined on the map side; nothing is grouped by a word alone
    without that, so a word in every text does no harm.
    """
    tokens = word_tokens(F.lower(F.col(text)))
    end = F.array(F.lit(None).cast("string"))
    both = df.select(tokens.alias("prev")).select(
        "prev", F.concat(F.slice("prev", 2, F.greatest(F.size("prev") - 1, F.lit(0))), end).alias("tok")
    )
    rows = both.select(F.inline(F.arrays_zip("prev", "tok"))).filter(F.col("prev").isNotNull())
    # The last token of a text is a word of the vocabulary, but no context.
    counts = materialize(rows.groupBy("prev", "tok").agg(F.count(F.lit(1)).alias("c_pair")))
    vocabulary = counts.select("prev").distinct().count()
    pairs = counts.filter(F.col("tok").isNotNull())
    contexts = materialize(pairs.groupBy("prev").agg(F.sum("c_pair").alias("c_prev")))
    return BigramModel(materialize(pairs.join(contexts, "prev")), contexts, vocabulary)


def window_of(pos: Column, stride: int, width: int) -> Column:
    """Number of the window that scores the token at ``pos``."""
    if stride > width:  # gaps between windows
        return F.floor(pos / stride)
    return F.greatest(F.lit(0).cast("long"), F.floor((pos - width) / stride) + 1)


def scoring_windows(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    stride: int = STRIDE,
    width: int = WINDOW_TOKENS,
) -> DataFrame:
    """(keys, begin, end, trg_len): windows every ``stride`` tokens, up to the text's end.

    ``trg_len`` counts the tokens a window adds to those before it.
    """
    n = F.size("tokens").cast("long")
    to_end = F.ceil((n - width) / stride)
    last = F.greatest(F.lit(0).cast("long"), F.least(to_end, F.floor((n - 1) / stride)))
    numbers = F.when(n > 0, F.sequence(F.lit(0).cast("long"), last))
    windows = (
        tokens_by_text(df, keys, text)
        .select(*keys, n.alias("n"), numbers.alias("_numbers"))
        .select(*keys, "n", F.explode("_numbers").alias("_w"))
    )
    begin = F.col("_w") * stride
    end = F.least(begin + width, F.col("n"))
    previous_end = F.when(F.col("_w") == 0, F.lit(0)).otherwise(begin - stride + width)
    return windows.select(
        *keys, begin.alias("begin"), end.alias("end"), (end - previous_end).alias("trg_len")
    )


def perplexity(
    df: DataFrame,
    keys: Sequence[str],
    model: BigramModel,
    text: str = "text",
    stride: int = STRIDE,
    width: int = WINDOW_TOKENS,
    unique: bool = False,
    **bounds: int,
) -> DataFrame:
    """(keys, perplexity): exp of the unweighted mean over windows of their mean loss.

    Each token is scored once, in the first window that reaches it, and a window's
    first token has no context and no score. A text with a window that scores nothing
    has no perplexity (null). ``bounds`` are those of ``lookup``.
    """

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        return _perplexity(rows, keys, model, text, stride, width, bounds)

    return each_text(df, keys, [text], work, unique)


def _perplexity(
    df: DataFrame, keys: list[str], model: BigramModel, text: str, stride: int, width: int, bounds: dict
) -> DataFrame:
    edge = F.array(F.lit(None).cast("string"))
    shifted = tokens_by_text(df, keys, text).select(
        *keys,
        F.concat(edge, F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0)))).alias("prev"),
        F.col("tokens").alias("tok"),
    )
    rows = shifted.select(
        *keys,
        F.posexplode_outer(F.when(F.size("tok") > 0, F.arrays_zip("prev", "tok"))).alias("pos", "_p"),
    ).select(*keys, "pos", "_p.prev", "_p.tok")
    window = window_of(F.col("pos"), stride, width)
    offset = F.col("pos") - F.col("window") * stride
    scored = (offset > 0) & (offset < width)
    tokens = rows.withColumn("window", window).withColumn("n", F.when(scored, 1).otherwise(0))
    if not fits_broadcast(model.pairs, **bounds):
        # Only counts of a window's pairs are shuffled to the model, not tokens.
        tokens = tokens.groupBy(*keys, "window", "prev", "tok").agg(F.sum("n").alias("n"))
    spread_by = [*keys, "window"]
    found = lookup(tokens, model.pairs, ["prev", "tok"], spread_by, **bounds)
    if fits_broadcast(model.contexts, **bounds):
        found = lookup(found, model.contexts.withColumnRenamed("c_prev", "c_alone"), ["prev"], spread_by, **bounds)
    else:
        # A pair of the model brings the count of its first word; only others look it up.
        found = materialize(found)
        unseen = found.filter(F.col("c_pair").isNull())
        contexts = model.contexts.withColumnRenamed("c_prev", "c_alone")
        found = found.filter(F.col("c_pair").isNotNull()).withColumn("c_alone", F.col("c_prev")).unionByName(
            lookup(unseen, contexts, ["prev"], spread_by, **bounds)
        )
    loss = -F.log(
        (F.coalesce("c_pair", F.lit(0)) + 1)
        / (F.coalesce("c_alone", F.lit(0)) + F.lit(model.vocabulary + 1))
    )
    by_window = found.groupBy(*keys, "window").agg(
        F.try_divide(F.sum(F.col("n") * loss), F.sum("n")).alias("loss")
    )
    complete = F.count("loss") == F.count(F.lit(1))
    return by_window.groupBy(*keys).agg(
        F.when(complete, F.exp(F.avg("loss"))).alias("perplexity")
    )
