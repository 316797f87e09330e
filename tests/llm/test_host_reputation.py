import math

import pytest

from inkprint.llm.host_reputation import host_of, host_reputation, judged_urls, path_of, rule_of, RULES
from pyspark.sql import functions as F

URLS = [
    ("http://A.Net", "a.net", "", None),
    ("http://a.net/", "a.net", "/", "net/"),
    ("https://x.example.net/en/1#t", "x.example.net", "/en/1", "example.net/en/"),
    ("https://example.net/en", "example.net", "/en", "net/"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None),
    ("http://EXAMPLE.com/de/?q=http://x", "example.com", "/de/", "example.com/de/"),
    ("ftp://u.org/fr/a?b#c", "u.org", "/fr/a", "org/fr/"),
    ("//a.net/", "", "", None),
    ("a\nb://É.net?x/", "É.net", "", None),
    ("x://", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(u,) for u, *_ in URLS], "url string").withColumn("host", host_of(F.col("url")))
    df = df.withColumn("path", path_of(F.col("url")))
    rows = df.withColumn("r", rule_of(F.col("host"), F.col("path"), RULES)).collect()
    assert [(r["url"], r["host"], r["path"], r["r"] and r["r"]["rule"]) for r in rows] == URLS


def strength(groups):
    groups = [(n, b) for n, b in groups if n]
    n_all, k = sum(n for n, _ in groups), len(groups)
    if not n_all:
        return (1 - 0.001) / 0.001
    mean = sum(b for _, b in groups) / n_all
    rho = 0.0
    if k > 1 and n_all > k:
        msb = sum(n * (b / n - mean) ** 2 for n, b in groups) / (k - 1)
        msw = sum(n * (b / n) * (1 - b / n) for n, b in groups) / (n_all - k)
        size = (n_all - sum(n * n for n, _ in groups) / n_all) / (k - 1)
        if msb + (size - 1) * msw > 0:
            rho = (msb - msw) / (msb + (size - 1) * msw)
    rho = min(max(rho, 0.001), 0.999)
    return (1 - rho) / rho


def brute(hosts):
    def level(depth):
        sums = {}
        for h, n, b in hosts:
            key = ".".join(h.split(".")[-depth:]) if depth else h
            a, c = sums.get(key, (0, 0))
            sums[key] = (a + n, c + b)
        return sums, strength(sums.values())

    mean = sum(b for *_, b in hosts) / sum(n for _, n, _ in hosts)
    suffix, s = level(1)
    up = {k: (b + s * mean) / (n + s) for k, (n, b) in suffix.items()}
    domain, s = level(2)
    up = {k: (b + s * up[k.split(".")[-1]]) / (n + s) for k, (n, b) in domain.items()}
    _, s = level(0)
    out = {}
    for h, n, b in hosts:
        prior = up[".".join(h.split(".")[-2:])]
        one, two = b + s * prior, n - b + s * (1 - prior)
        m = one / (one + two)
        out[h] = (m, m - 1.645 * math.sqrt(m * (1 - m) / (one + two + 1)))
    return out


def test_posteriors(spark):
    hosts = [("a.x.com", 50, 45), ("b.x.com", 40, 2), ("x.com", 0, 0), ("c.y.com", 3, 3), ("z.org", 200, 10), ("", 5, 1), ("q.org", 30, 30)]
    df = spark.createDataFrame(hosts, "host string, n long, bad long")
    expected = brute(hosts)
    rows = host_reputation(df).collect()
    assert len(rows) == len(hosts)
    for r in rows:
        assert (r["mean"], r["low"]) == pytest.approx(expected[r["host"]], rel=1e-9)


def test_verdicts(spark):
    pages = [(i, f"http://bad.com/{i}") for i in range(40)] + [(100 + i, f"http://good.com/{i}") for i in range(40)]
    pages += [(200, "http://new.com/1"), (201, None), (201, None), (None, "http://bad.com/z"), (202, "http://bad.org/fr/")]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' host", "1 n", "2 low", "3 `rule`")
    outcomes = [("bad.com", 1)] * 30 + [("good.com", 0)] * 30 + [(None, 1), ("good.com", None)]
    found = judged_urls(df, spark.createDataFrame(outcomes, "host string, bad int")).collect()
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert len(found) == len(pages)
    assert verdict[0] == verdict[None] == "block" and verdict[100] == verdict[202] == "allow"
    assert verdict[201] == "allow"


def test_no_outcomes_and_empty_table(spark):
    none = spark.createDataFrame([], "host string, bad int")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judged_urls(pages, none).first()["verdict"] == "allow"
    assert judged_urls(pages.limit(0), none).collect() == []
