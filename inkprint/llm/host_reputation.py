"""Judgement of urls by rules, and beyond them by the reputation of their hosts.

Outcomes of labelled pages (bad or not) are counted by host. A host's rate of bad pages is shrunk
towards its registered domain's, that towards its suffix's, and that towards the rate of all
pages: each level is a beta prior around the mean of the level above, with a strength estimated
from how much the rates of that level differ (the analysis-of-variance estimate of a
beta-binomial's correlation). A host is blocked if the lower bound of its posterior lies above
the limit, so little evidence blocks nobody.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.operators.distribute import lookup

LIMIT = 0.3
DEVIATIONS = 1.645
LEAST_CORRELATION = 0.001
MOST_CORRELATION = 0.999

#: Action, host and start of the path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, in lower case."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels: the domain that was registered under a suffix of one label."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as (length, rule, action), or null.

    A rule fits its host and all hosts below it where the path starts with the rule's. The list
    of rules is a setting: it becomes part of the expression.
    """
    fits = [
        F.when(
            ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start)),
            F.struct(
                F.lit(len(at + start)).alias("length"),
                F.lit(at + start).alias("rule"),
                F.lit(action).alias("action"),
            ),
        )
        for action, at, start in rules
    ]
    return F.array_max(F.array(*fits))


def _level(counts: DataFrame, key: str, above: str | None) -> tuple[DataFrame, DataFrame]:
    """Sums of a level, and its strength as one row."""
    keys = [key] if above is None else [key, above]
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate = F.col("bad") / F.col("n")
    mean = F.col("all_bad") / F.col("all_n")
    parts = sums.filter("n > 0").crossJoin(
        F.broadcast(sums.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad")))  # one row
    )
    total = parts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("all_n"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("between"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("within"),
    )
    msb = F.col("between") / (F.col("k") - 1)
    msw = F.col("within") / (F.col("all_n") - F.col("k"))
    size = (F.col("all_n") - F.col("squares") / F.col("all_n")) / (F.col("k") - 1)
    several = (F.col("k") > 1) & (F.col("all_n") > F.col("k"))
    below = msb + (size - 1) * msw
    raw = F.when(several & (below > 0), (msb - msw) / below).otherwise(0.0)
    rho = F.least(F.greatest(raw, F.lit(LEAST_CORRELATION)), F.lit(MOST_CORRELATION))
    return sums, total.select(((1 - rho) / rho).alias("strength"))


def host_reputation(hosts: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """Posterior of each host from its counts (host, n, bad).

    Returns host, n, bad, ``mean`` and ``low``, the mean less ``deviations`` standard deviations
    of the beta posterior. A host without outcomes has the posterior of its domain's prior.
    Without any outcome the mean is null, and nothing is blocked.
    """
    levels = hosts.select(
        "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"
    )
    whole = hosts.agg((F.sum("bad") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    suffixes, strength = _level(levels, "suffix", None)
    # The whole and each strength are one row.
    suffixes = suffixes.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(strength)).select(
        "suffix",
        ((F.col("bad") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))).alias("mean"),
    )
    domains, strength = _level(levels, "domain", "suffix")
    domains = domains.join(suffixes, "suffix").crossJoin(F.broadcast(strength)).select(
        "domain",
        ((F.col("bad") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))).alias("mean"),
    )
    _, strength = _level(levels, "host", "domain")
    a = F.col("bad") + F.col("strength") * F.col("prior")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    return (
        levels.join(domains.withColumnRenamed("mean", "prior"), "domain")
        .crossJoin(F.broadcast(strength))
        .select("host", "n", "bad", a.alias("a"), b.alias("b"))
        .withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        .withColumn(
            "low",
            F.col("mean")
            - deviations * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1)),
        )
        .select("host", "n", "bad", "mean", "low")
    )


def judged_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    limit: float = LIMIT,
    deviations: float = DEVIATIONS,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """Host, path, rule and verdict of each page, with the bound of its host.

    ``outcomes`` has (host, bad): a row for each labelled page, bad being 1 or 0; nulls are left
    out. The longest rule that fits decides; where none does, the host is blocked if its bound is
    above ``limit``. A null url or one without ``://`` has an empty host and path, fits no rule
    and is allowed unless pages without a host have a bad name. Rows may repeat; an empty table
    gives no row. Outcomes are counted by host before anything moves.
    """
    rows = pages.select(
        F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    )
    labelled = outcomes.filter("host IS NOT NULL AND bad IS NOT NULL")
    counts = labelled.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")
    )
    known = (
        rows.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
        .unionByName(counts)
        .groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    )
    names = host_reputation(known, deviations).select("host", "n", "bad", "mean", "low")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = lookup(rows, names, ["host"], ["path"])
    verdict = F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("_rule", rule).select(
        F.col(id_column),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.action"), verdict).alias("verdict"),
        F.col("n").alias("n_labelled"),
        F.col("bad").alias("n_bad"),
    )
