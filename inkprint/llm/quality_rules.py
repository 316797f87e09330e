"""Rules with cutoffs that reject few good documents, with a guarantee for each stratum.

Every rule is a score of a text; a document is rejected where a score exceeds the cutoff of the
rule in the document's stratum. Cutoffs come from fixed grids. A cutoff is certified if, on the
good documents of a labelled holdout, the exact binomial test rejects "more than ``ALPHA`` over
the number of rules of the good are lost". Cutoffs of a rule are tested from the mildest down to
the first that fails, so a chain needs no correction of its own; over all chains (strata times
rules) the level ``DELTA`` is divided (Bonferroni). So with probability of at least 1 - DELTA,
in every stratum at most ``ALPHA`` of the good documents are rejected by all rules together.

Among the certified cutoffs of a chain the one is used that rejects most bad documents of the
holdout, less ``COST`` for each good one; the mildest wins a tie. A chain that gains nothing or
has no certified cutoff rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import texts_of, unused
from inkprint.session import materialize

ALPHA = 0.02
DELTA = 0.05
COST = 5
MIN_WORDS = 50

#: Scores in thousandths, and the cutoffs that are tried, mildest first.
GRID = [1000, 800, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 25, 20, 15, 10, 5, 2]
RULES = {
    "symbols": "1000 * n_symbols div greatest(1, word_chars)",
    "dup_lines": "1000 * n_dup_lines div greatest(1, n_lines)",
    "repeats": "1000 * n_repeat_words div greatest(1, n_words)",
    "capitals": "1000 * n_upper div greatest(1, word_chars)",
    "exclaims": "1000 * n_exclaims div greatest(1, word_chars)",
}

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims",
)
_TYPE = "struct<" + ",".join(f"{m}:long" for m in MEASURES) + ">"
_ARROW = pa.struct([(m, pa.int64()) for m in MEASURES])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def repeated_words(words: list[bytes]) -> int:
    """Words in runs of three that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(numbers) + ids[1:]
    _, pair = np.unique(pairs, return_inverse=True)
    runs = pair[:-1] * len(numbers) + ids[2:]
    _, run, count = np.unique(runs, return_inverse=True, return_counts=True)
    again = count[run] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def measures(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    size = len(data)
    seen: set[bytes] = set()
    lines = again = 0
    for line in data.split(b"\n"):
        if line.strip(_SPACE):
            lines += 1
            again += line in seen
        seen.add(line)
    less = lambda drop: size - len(data.translate(None, drop))
    return (
        len(words), len(text) - less(_SPACE), less(_SYMBOLS), lines, again,
        repeated_words(words), less(_UPPER), data.count(b"!"),
    )


def _measured(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        rows = [measures(t) for t in texts_of(column)]
        fields = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [
            pa.array([], pa.int64()) for _ in MEASURES
        ]
        yield pa.StructArray.from_arrays(fields, list(MEASURES))


def text_measures(text: Column) -> Column:
    """The counts that rules are made of; a null text has none of anything."""
    return F.arrow_udf(_measured, _TYPE, F.ArrowUDFType.SCALAR_ITER)(text)


def base_failed(min_words: int = MIN_WORDS) -> Column:
    few = F.col("n_words") < min_words
    return few | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """The probability of at most k of n, each with probability p."""
    log = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    most = max(log)
    return min(1.0, math.exp(most) * math.fsum(math.exp(x - most) for x in log))


def certified_cutoff(
    good: list[int], bad: list[int], n_good: int, share: float, level: float, cost: int = COST
) -> int | None:
    """Index of the cutoff to use, from good and bad documents rejected at each, or None."""
    best, gain = None, 0
    for i, (lost, caught) in enumerate(zip(good, bad, strict=True)):
        if n_good == 0 or binomial_tail(lost, n_good, share) > level:
            break
        if caught - cost * lost > gain:
            best, gain = i, caught - cost * lost
    return best


def cutoffs(
    scored: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cost: int = COST
) -> dict[str, dict[str, int]]:
    """For each stratum the cutoffs of its rules.

    ``scored`` is a holdout with ``stratum``, ``label`` (1 good, 0 bad) and a column of whole
    numbers for each rule. Strata are few: one row of counts for each comes to the driver.
    """
    is_good, is_bad = F.col("label") == 1, F.col("label") == 0
    counts = [F.count(F.when(is_good, 1)).alias("n_good")]
    for rule in RULES:
        for kind, of in (("good", is_good), ("bad", is_bad)):
            over = [F.count(F.when(of & (F.col(rule) > c), 1)) for c in GRID]
            counts.append(F.array(*over).alias(f"{rule}_{kind}"))
    rows = scored.groupBy("stratum").agg(*counts).collect()
    level = delta / max(1, len(rows) * len(RULES))
    found: dict[str, dict[str, int]] = {}
    for row in rows:
        for rule in RULES:
            i = certified_cutoff(
                row[f"{rule}_good"], row[f"{rule}_bad"], row["n_good"], alpha / len(RULES), level, cost
            )
            if i is not None:
                found.setdefault(row["stratum"], {})[rule] = GRID[i]
    return found


def judged(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    stratum_column: str = "lang",
    label_column: str = "quality",
    **settings,
) -> DataFrame:
    """The measures of each document, ``base_failed``, ``kept`` and ``rejected_by``.

    Measures are counted over whole texts; null and empty texts have no word and fail the base
    rules. Labelled documents that pass the base rules are the holdout; null labels and ids are
    left out of it, and a document with several labels counts once for each. A null stratum is
    a stratum of its own. Without labels nothing but the base rules rejects. Rows may repeat;
    an empty table gives no row.
    """
    rows = documents.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(stratum_column).cast("string"), F.lit("")).alias("stratum"),
        text_measures(F.col(text_column)).alias("m"),
    ).select("id", "stratum", "m.*")
    rows = rows.withColumn("base_failed", base_failed())
    scored = materialize(rows.select("*", *[F.expr(x).alias(rule) for rule, x in RULES.items()]))
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    holdout = scored.filter("NOT base_failed").join(known.filter("label IN (0, 1)"), "id")
    chosen = cutoffs(holdout, **settings)
    rejected = F.array().cast("array<string>")
    for stratum, limits in sorted(chosen.items()):
        over = [
            F.when((F.col("stratum") == stratum) & (F.col(rule) > c), F.lit(rule)) for rule, c in limits.items()
        ]
        rejected = F.array_union(rejected, F.array_compact(F.array(*over)))
    name = unused(documents.select(id_column), "rejected_by")
    return scored.withColumn(name, rejected).select(
        F.col("id").alias(id_column),
        *MEASURES,
        "base_failed",
        (~F.col("base_failed") & (F.size(name) == 0)).alias("kept"),
        name,
    )
