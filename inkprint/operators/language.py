"""Language of a text by character trigrams (naive Bayes over labelled texts)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.vectors import argmax
from inkprint.operators.distribute import fits_broadcast, lookup
from inkprint.operators.identity import each_text
from inkprint.operators.in_text import Trigrams, item_counts
from inkprint.session import materialize

FALLBACK = "en"
#: As many languages have a column of their own in the sums of a text; more have a row each.
WIDE = 64
_NONE = "array<struct<lang:string,gain:double>>"


@dataclass(frozen=True)
class LanguageProfiles:
    """What texts of each language hold.

    ``grams`` is (gram, gains): for each language that has the trigram, how much the
    logarithm of its probability exceeds that of an unseen one. ``floors`` is one row
    with the latter for all languages, in the order of their names.
    """

    grams: DataFrame
    floors: DataFrame


def fit_profiles(
    df: DataFrame,
    label: str = "lang",
    text: str = "text",
    languages: Sequence[str] | None = None,
) -> LanguageProfiles:
    """Count trigrams per language. The counts are combined before they are shuffled."""
    known = df.filter(F.col(label).isNotNull())
    if languages is not None:
        known = known.filter(F.col(label).isin(list(languages)))
    named = known.select(F.col(label).alias("lang"), F.lower(F.col(text)).alias("text"))
    grams = item_counts(named, ["lang"], F.col("text"), "gram", piece=Trigrams)
    counts = materialize(grams.groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    size = counts.select("gram").distinct().agg(F.count(F.lit(1)).alias("size"))
    # One number, one row for each language, then one row in all.
    names = known.select(F.col(label).alias("lang")).distinct()
    totals = names.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang", "left")
    floor = -F.log(F.coalesce("total", F.lit(0)) + F.col("size") + 1)
    floors = (
        totals.crossJoin(F.broadcast(size))
        .select(F.struct("lang", floor.alias("floor")).alias("f"))
        .agg(F.array_sort(F.collect_list("f")).alias("floors"))
    )
    table = counts.groupBy("gram").agg(
        F.collect_list(F.struct("lang", F.log(F.col("n") + 1).alias("gain"))).alias("gains")
    )
    return LanguageProfiles(materialize(table), materialize(floors))


def _by_language(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n, _gained): the number of trigrams, and by language the sum of their gains."""
    # A line without language carries the number of trigrams.
    every = F.array(F.struct(F.lit(None).cast("string").alias("lang"), F.lit(1.0).alias("gain")))
    gains = F.concat(every, F.coalesce("gains", F.array().cast(_NONE)))
    by_language = (
        found.select(*keys, "n", F.inline(gains))
        .groupBy(*keys, "lang")
        .agg(F.sum(F.col("n") * F.col("gain")).alias("s"))
    )
    named = F.when(F.col("lang").isNotNull(), F.struct("lang", "s"))
    return by_language.groupBy(*keys).agg(
        F.sum(F.when(F.col("lang").isNull(), F.col("s"))).alias("_n"),
        F.map_from_entries(F.collect_list(named)).alias("_gained"),
    )


def language_scores(
    df: DataFrame,
    keys: Sequence[str],
    profiles: LanguageProfiles,
    text: str = "text",
    unique: bool = False,
    **bounds: int,
) -> DataFrame:
    """(keys, scores): (lang, score) by language, the summed log probability of the text.

    The scores of a text with no trigram are null. Profiles beyond the
    bound of a broadcast are met by the counts of a text's trigrams. ``bounds`` are those of ``lookup``.
    """

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        # One row, a name for each language.
        names = [f["lang"] for f in profiles.floors.first()["floors"] or []]
        counted = item_counts(rows, keys, F.lower(F.col(text)), "gram", blank=True, piece=Trigrams)
        if len(names) <= WIDE and fits_broadcast(profiles.grams, **bounds):
            # Nothing is shuffled before the sums of a text, which are combined first.
            gains = F.map_from_entries("gains")
            wide = profiles.grams.select(
                "gram", *[F.coalesce(F.try_element_at(gains, F.lit(x)), F.lit(0.0)).alias(f"_{i}") for i, x in enumerate(names)]
            )
            found = counted.join(F.broadcast(wide), "gram", "left")
            sums = [F.coalesce(F.sum(F.col("n") * F.col(f"_{i}")), F.lit(0.0)) for i in range(len(names))]
            per_text = found.groupBy(*keys).agg(F.sum("n").alias("_n"), F.array(*sums).alias("_gained"))
            gained = lambda f, i: F.get(F.col("_gained"), i)
        else:
            found = lookup(counted, profiles.grams, ["gram"], spread_by=keys, **bounds)
            per_text = _by_language(found, keys)
            gained = lambda f, i: F.coalesce(F.try_element_at("_gained", f["lang"]), F.lit(0.0))
        score = F.transform(
            "floors",
            lambda f, i: F.struct(
                f["lang"].alias("lang"), (F.col("_n") * f["floor"] + gained(f, i)).alias("score")
            ),
        )
        # The floors are one row.
        return per_text.crossJoin(F.broadcast(profiles.floors)).select(
            *keys, F.when(F.col("_n") > 0, score).alias("scores")
        )

    return each_text(df, keys, [text], work, unique)


def detect_language(
    df: DataFrame,
    keys: Sequence[str],
    profiles: LanguageProfiles,
    text: str = "text",
    unique: bool = False,
    **bounds: int,
) -> DataFrame:
    """(keys, language): the best scoring language, ``en`` where none can be told."""
    best = argmax(F.transform("scores", lambda s: s["score"]))
    name = F.get(F.col("scores"), best)["lang"]
    return language_scores(df, keys, profiles, text, unique, **bounds).select(
        *keys, F.coalesce(name, F.lit(FALLBACK)).alias("language")
    )
