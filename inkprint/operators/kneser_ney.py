"""Perplexity under an interpolated Kneser-Ney model of three words.

The probability of a word after two others is its discounted share among what followed them, and
for the rest that of the shorter context, where a word counts by how many different words it was
seen after and not by how often it occurred. Below one word all words, and one unseen, are alike.

All levels are worked out when the model is fitted: a table of each order has final probabilities,
and a context the weight of the shorter order. So a text is scored by lookups, longest order first.
"""

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
from inkprint.operators.perplexity import window_of
from inkprint.session import materialize

DISCOUNT = 0.75


@dataclass(frozen=True)
class TrigramModel:
    """``words`` is (w3, p1), ``pairs`` (w2, w3, p2), ``triples`` (w1, w2, w3, p3); ``pair_contexts`` and
    ``triple_contexts`` have the weights (w2, b2) and (w1, w2, b3); ``unseen`` is a new word's probability."""

    words: DataFrame
    pairs: DataFrame
    triples: DataFrame
    pair_contexts: DataFrame
    triple_contexts: DataFrame
    unseen: float


def _shifted(tokens: Column, by: int) -> Column:
    """The tokens ``by`` places further on, and nulls at the end."""
    rest = F.slice(tokens, by + 1, F.greatest(F.size(tokens) - by, F.lit(0)))
    return F.concat(rest, F.array_repeat(F.lit(None).cast("string"), by))


def _contexts(counts: DataFrame, keys: list[str], n: str, weight: str, discount: float) -> DataFrame:
    """(keys, total, weight): what follows a context, and the share left to the shorter one."""
    sums = counts.groupBy(*keys).agg(F.sum(n).alias("total"), F.count(F.lit(1)).alias("_types"))
    return materialize(sums.select(*keys, "total", (discount * F.col("_types") / F.col("total")).alias(weight)))


def fit_trigram_model(df: DataFrame, text: str = "text", discount: float = DISCOUNT) -> TrigramModel:
    """Count the triples of a corpus and work out all probabilities.

    Every count is a sum or a number of distinct rows of the table of triples, combined before it
    is shuffled; contexts that many words follow are met by ``lookup``. A corpus without three
    words in a text gives every word the same probability.
    """
    tokens = df.select(word_tokens(F.lower(F.col(text))).alias("w1"))
    vocabulary = tokens.select(F.explode("w1").alias("w")).distinct().count()
    rows = tokens.select("w1", _shifted(F.col("w1"), 1).alias("w2"), _shifted(F.col("w1"), 2).alias("w3"))
    rows = rows.select(F.inline(F.arrays_zip("w1", "w2", "w3"))).filter(F.col("w3").isNotNull())
    triples = materialize(rows.groupBy("w1", "w2", "w3").agg(F.count(F.lit(1)).alias("n")))
    # A row for each triple: the number of words that a pair was seen after.
    pairs = materialize(triples.groupBy("w2", "w3").agg(F.count(F.lit(1)).alias("n")))
    words = materialize(pairs.groupBy("w3").agg(F.count(F.lit(1)).alias("n")))
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    unseen = (discount * types / total if total else 1.0) / (vocabulary + 1)
    share = lambda n: F.greatest(F.col(n) - discount, F.lit(0.0))
    known_words = materialize(words.select("w3", (share("n") / max(total, 1) + unseen).alias("p1")))
    pair_contexts = _contexts(pairs, ["w2"], "n", "b2", discount)
    met = lookup(lookup(pairs, known_words, ["w3"], ["w2"]), pair_contexts, ["w2"], ["w3"])
    known_pairs = materialize(
        met.select("w2", "w3", (share("n") / F.col("total") + F.col("b2") * F.col("p1")).alias("p2"))
    )
    triple_contexts = _contexts(triples, ["w1", "w2"], "n", "b3", discount)
    met = lookup(lookup(triples, known_pairs, ["w2", "w3"], ["w1"]), triple_contexts, ["w1", "w2"], ["w3"])
    known_triples = materialize(
        met.select("w1", "w2", "w3", (share("n") / F.col("total") + F.col("b3") * F.col("p2")).alias("p3"))
    )
    return TrigramModel(
        known_words, known_pairs, known_triples,
        pair_contexts.drop("total"), triple_contexts.drop("total"), unseen,
    )


def probability(rows: DataFrame, model: TrigramModel, spread_by: Sequence[str], **bounds: int) -> DataFrame:
    """Add ``p`` to rows of (w1, w2, w3): the probability of w3 behind the others; null is no word."""
    by = list(spread_by)
    found = lookup(rows, model.triples, ["w1", "w2", "w3"], by, **bounds)
    found = lookup(found, model.pairs, ["w2", "w3"], by, **bounds)
    found = lookup(found, model.words, ["w3"], by, **bounds)
    found = lookup(found, model.pair_contexts, ["w2"], by, **bounds)
    found = lookup(found, model.triple_contexts, ["w1", "w2"], by, **bounds)
    one = F.coalesce("p1", F.lit(model.unseen))
    # A context that was never seen leaves everything to the shorter one.
    two = F.coalesce(F.col("p2"), F.coalesce("b2", F.lit(1.0)) * one)
    three = F.coalesce(F.col("p3"), F.coalesce("b3", F.lit(1.0)) * two)
    return found.withColumn("p", three).drop("p1", "p2", "p3", "b2", "b3")


def trigram_perplexity(
    df: DataFrame,
    keys: Sequence[str],
    model: TrigramModel,
    text: str = "text",
    stride: int = STRIDE,
    width: int = WINDOW_TOKENS,
    unique: bool = False,
    **bounds: int,
) -> DataFrame:
    """(keys, perplexity): exp of the unweighted mean over windows of their mean loss.

    Windows are those of ``perplexity.perplexity``: each token is scored once, in the first window
    that reaches it, by the two words before it in that window, the second token by one; a window's
    first token has no score. A text with a window that scores nothing, a null text among them, has no perplexity
    (null). Every row is a text of its own. ``bounds`` are those of ``lookup``.
    """

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        before = lambda by: F.slice(
            F.concat(F.array_repeat(F.lit(None).cast("string"), by), "tokens"), 1, F.size("tokens")
        )
        words = F.arrays_zip(before(2).alias("w1"), before(1).alias("w2"), F.col("tokens").alias("w3"))
        tokens = tokens_by_text(rows, keys, text).select(
            *keys, F.posexplode_outer(F.when(F.size("tokens") > 0, words)).alias("pos", "_w")
        )
        offset = F.col("pos") - F.col("window") * stride
        scored = (offset > 0) & (offset < width)
        tokens = tokens.withColumn("window", window_of(F.col("pos"), stride, width)).select(
            *keys, "window", F.when(offset > 1, F.col("_w.w1")).alias("w1"), F.col("_w.w2").alias("w2"),
            F.col("_w.w3").alias("w3"), F.when(scored, 1).otherwise(0).alias("scored"),
        )
        tables = (model.triples, model.pairs, model.words, model.pair_contexts, model.triple_contexts)
        if all(fits_broadcast(table, **bounds) for table in tables):
            # Nothing is shuffled before the sums of a window, which are combined first.
            counted = tokens.withColumnRenamed("scored", "n")
        else:
            # What a window holds more than once is looked up once.
            counted = tokens.groupBy(*keys, "window", "w1", "w2", "w3").agg(F.sum("scored").alias("n"))
        found = probability(counted, model, [*keys, "window"], **bounds)
        by_window = found.groupBy(*keys, "window").agg(
            F.try_divide(F.sum(F.col("n") * -F.log("p")), F.sum("n")).alias("loss")
        )
        complete = F.count("loss") == F.count(F.lit(1))
        return by_window.groupBy(*keys).agg(F.when(complete, F.exp(F.avg("loss"))).alias("perplexity"))

    return each_text(df, keys, [text], work, unique)


__all__ = ["DISCOUNT", "TrigramModel", "fit_trigram_model", "probability", "trigram_perplexity"]
