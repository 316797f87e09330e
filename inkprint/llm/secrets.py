"""Secrets in texts: patterns, and random strings by two Markov models of characters.

A chain of characters is fitted to values that the patterns find (keys and passwords) and another
to ordinary words of the same texts. A token is a secret if the first explains some stretch of it
better: if the mean over the stretch's pairs of neighbouring characters of the logarithm of both
probabilities' ratio exceeds ``LIMIT``, by the logarithm of how much rarer secrets are in all. A stretch is as long as the shortest token at least, so a
key glued to words by a slash, an underscore or a hyphen is judged without them. Everything is DataFrame expressions; the models are an array of
one number for each pair of classes of characters, part of the expression.

Positions come from cutting a text at the matches of a pattern: the pieces and matches take turns,
so running sums of their lengths are where matches begin.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.binding import let
from inkprint.llm.common import bounded_sample

#: The kinds in their order, and what each looks for.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

#: A token that the models judge: a whole run of these characters, so long at least.
SHORTEST = 16
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: An ordinary word that the second model learns from.
WORD = r"[A-Za-z0-9+/_=-]{6,}"
LIMIT = 1.4
#: What a stretch has to be ahead in all: ordinary tokens are so many times as frequent, and a longer
#: token has as many more stretches to try.
ORDINARY_TO_ONE = 1000
#: The smallest alphabet that keys are drawn from, and how many of them may have fewer characters.
ALPHABET, TOO_FEW = 16, 0.001
#: Documents that the models are learnt from, drawn by a hash of the id: so many with a match of a
#: pattern, and so many without one.
SAMPLE = 20_000
SMOOTHING = 0.5
LEANING = 10

#: All characters of tokens lie between these codes, so a pair is one place of a table.
_LOW, _WIDTH = 43, 80

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_HEXES = f"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}"
_KEYS = f"{ACCESS[:4]}[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"


def _spans(text: Column, pattern: str, kind: int, group: int, good: Callable[[Column], Column]) -> Column:
    """(start, kind, end) in code points of the matches whose group is good."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(
        whole,
        values,
        lambda m, v: F.struct(F.char_length(m).cast("long").alias("size"), good(v).alias("good")),
    )
    steps = F.zip_with(
        F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap).cast("long")),
        sizes,
        lambda gap, m: F.struct(gap.alias("gap"), m["size"].alias("size"), m["good"].alias("good")),
    )
    nothing = F.array().cast(_SPANS)

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        end = begin + F.coalesce(step["size"], F.lit(0).cast("long"))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        more = F.concat(state["found"], F.array(span).cast(_SPANS))
        return F.struct(end.alias("at"), F.when(step["good"], more).otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("found"))
    found = F.aggregate(steps, start, add, lambda state: state["found"])
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(nothing)


def _any(value: Column) -> Column:
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of all patterns of a text that is not null, by start and kind.

    A match of the assignment pattern takes its characters even if its value is too short. For
    the others a run that is too short holds no longer one, so the length is in the pattern.
    """
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, 1, lambda v: F.char_length(v) >= ASSIGN_LENGTH),
            _spans(text, _KEYS, 1, 0, _any),
            _spans(text, _HEXES, 2, 0, _any),
        )
    )


def _codes(token: Column) -> Column:
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.ascii(c) - _LOW)


def _pair_counts(tokens: DataFrame, name: str) -> DataFrame:
    """How often each pair of neighbouring characters occurs; ``tokens`` has arrays of codes."""
    pairs = F.zip_with(
        F.slice("codes", 1, F.size("codes") - 1),
        F.slice("codes", 2, F.size("codes") - 1),
        lambda a, b: a * _WIDTH + b,
    )
    exploded = tokens.filter(F.size("codes") > 1).select(F.explode(pairs).alias("pair"))
    return exploded.groupBy("pair").agg(F.count(F.lit(1)).alias(name))


def fit_ratios(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE
) -> list[float] | None:
    """Log ratios of both chains for each pair of characters; a table of fixed size.

    Values that patterns find are the sample of random strings; all other runs of word
    characters of the same texts are the sample of ordinary ones. Of the documents with such a
    value, and of those without, about ``sample`` at most are read, drawn by a hash of the id: where
    secrets are rare, the documents that have one still count. None if either sample is empty.
    """
    texts = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    values = F.concat(
        F.filter(
            F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), lambda v: F.char_length(v) >= ASSIGN_LENGTH
        ),
        F.regexp_extract_all("text", F.lit(_KEYS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(_HEXES), F.lit(0)),
    )
    labelled = texts.withColumn("matched", F.size(values) > 0)
    drawn = bounded_sample(labelled, "id", "matched", sample).select("text")
    rest = F.regexp_replace("text", f"{ASSIGN}|{_KEYS}|{_HEXES}", " ")
    words = F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))
    random = drawn.select(F.explode(values).alias("t")).select(
        # a value may hold characters that tokens do not
        _codes(F.regexp_replace("t", "[^A-Za-z0-9+/_=-]", "")).alias("codes")
    )
    ordinary = drawn.select(F.explode(words).alias("t")).select(_codes(F.col("t")).alias("codes"))
    counts = _pair_counts(random, "random").join(_pair_counts(ordinary, "ordinary"), "pair", "full")
    table = {r["pair"]: (r["random"] or 0, r["ordinary"] or 0) for r in counts.collect()}
    if not any(a for a, _ in table.values()) or not any(b for _, b in table.values()):
        return None
    random_log, ordinary_log = (
        _chain([table.get(pair, (0, 0))[k] for pair in range(_WIDTH * _WIDTH)]) for k in (0, 1)
    )
    return [round(x - y, 4) for x, y in zip(random_log, ordinary_log, strict=True)]


def _chain(counts: list[int]) -> list[float]:
    """Log probabilities of the second character given the first, leaning on the second's own."""
    total = sum(counts) + SMOOTHING * _WIDTH
    own = [(sum(counts[second::_WIDTH]) + SMOOTHING) / total for second in range(_WIDTH)]
    out = []
    for first in range(_WIDTH):
        row = counts[first * _WIDTH : (first + 1) * _WIDTH]
        weight = sum(row) + LEANING
        out += [math.log((n + LEANING * p) / weight) for n, p in zip(row, own, strict=True)]
    return out


def best_excess(token: Column, ratios: list[float], limit: float) -> Column:
    """The largest sum of log ratio less ``limit`` over a stretch of ``SHORTEST`` characters or more.

    It is positive if the mean log ratio of such a stretch exceeds the limit; a token that is
    shorter has minus infinity.
    """
    # A constant that is parsed once, when the plan is made.
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    never = F.lit(float("inf"))

    def add(state: Column, code: Column) -> Column:
        gain = F.get(table, state["before"] * _WIDTH + code) - limit
        total = F.when(state["before"] < 0, 0.0).otherwise(state["total"] + gain)
        # The sums up to the last SHORTEST characters; the first is where a stretch may begin.
        recent = F.slice(F.concat(state["recent"], F.array(total)), 2, SHORTEST)
        low = F.least(state["low"], F.get(recent, F.lit(0)))
        return F.struct(
            code.alias("before"), total.alias("total"), recent.alias("recent"), low.alias("low"),
            F.greatest(state["best"], total - low).alias("best"),
        )

    start = F.struct(
        F.lit(-1).alias("before"), F.lit(0.0).alias("total"),
        F.array_repeat(never, SHORTEST).alias("recent"), never.alias("low"), (-never).alias("best"),
    )
    return F.aggregate(_codes(token), start, add, lambda s: s["best"])


def distinct_needed(longest: int = 128) -> list[int]:
    """For each length the different characters that all but ``TOO_FEW`` of random strings have."""
    chances = [1.0] + [0.0] * ALPHABET
    out = [0]
    for _ in range(longest):
        chances = [
            chances[d] * d / ALPHABET + (chances[d - 1] * (ALPHABET - d + 1) / ALPHABET if d else 0.0)
            for d in range(ALPHABET + 1)
        ]
        below, needed = chances[0], 0
        while below <= TOO_FEW:
            needed += 1
            below += chances[needed]
        out.append(needed)
    return out


def _varied(token: Column) -> Column:
    """Whether a token has as many different characters as a random one: a ruler or a number has not."""
    needed = distinct_needed()
    length = F.least(F.char_length(token), F.lit(len(needed) - 1))
    return F.size(F.array_distinct(_codes(token))) >= F.get(F.lit(needed), length)


def random_spans(text: Column, ratios: list[float] | None, limit: float = LIMIT) -> Column:
    """Spans of the tokens with a stretch that the chain of random strings explains better.

    A span is the whole token: where a key ends and the words around it begin is not certain.
    """
    if ratios is None:
        return F.array().cast(_SPANS)
    needed = lambda v: F.log(F.lit(ORDINARY_TO_ONE) * F.char_length(v) / SHORTEST)
    return _spans(text, TOKEN, 3, 0, lambda v: _varied(v) & (best_excess(v, ratios, limit) > needed(v)))


def secret_spans(text: Column, ratios: list[float] | None, limit: float = LIMIT) -> Column:
    """(base, spans) of a text: spans of the patterns, and these with the models' added.

    Spans are ordered by start, then kind (a number of ``KINDS``). A token that overlaps a span
    of a pattern is not added. A null or empty text has no spans.
    """
    filled = F.coalesce(text, F.lit(""))

    def apart(base: Column) -> Callable[[Column], Column]:
        return lambda r: ~F.exists(base, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))

    def both(base: Column) -> Column:
        more = F.filter(random_spans(filled, ratios, limit), apart(base))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))

    return let(base_spans(filled), both)


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
