import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from inkprint.llm.periodic_runs import lag_scan, segments, with_runs
from inkprint.llm.queries import QUERIES, made_periodic
from pyspark.sql import functions as F


def periods(words):
    """All periods of a stretch, from the definition."""
    return [q for q in range(1, len(words)) if words[q:] == words[:-q]]


def brute(words):
    """For each stretch: its smallest period, its length, and that neither neighbour extends it."""
    n, found = len(words), []
    for start in range(n):
        for end in range(start + 6, n + 1):
            q = min(periods(words[start:end]), default=None)
            if q is None or end - start < max(6, 4 * q):
                continue
            if start and words[start - 1] == words[start - 1 + q] or end < n and words[end] == words[end - q]:
                continue
            found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def by_lags(words):
    """The same for longer texts: maximal stretches of each lag, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def drawn(seed):
    draw = random.Random(seed)
    words = []
    while len(words) < 40:
        passage = draw.choices("abcd", k=draw.randint(1, 5))
        words += (passage * draw.randint(1, 6))[: draw.randint(1, 20)]
    return words[:40]


@pytest.mark.parametrize("seed", range(60))
def test_definition(seed):
    words = drawn(seed)
    expected = brute(words)
    assert by_lags(words) == expected
    codes = np.array([ord(w) for w in words])
    assert sorted(lag_scan(codes, 6, 4), key=lambda r: (r[0], r[2])) == expected
    parts = segments(codes.astype(np.uint64), np.array([0]), np.array([len(words)]), 6, 4)
    for start, length, _ in expected:
        assert any(a <= start and start + length <= b for a, b in parts)


def test_segments_split_until_stable():
    # x is frequent in the whole text, but not between the rare words.
    words = "x x r1 x x r2 y y y y y y r3 x y x y x y x y".split()
    codes = np.array([hash(w) & 0xFFFFFFFF for w in words], np.uint64)
    parts = segments(codes, np.array([0]), np.array([len(words)]), 6, 4)
    assert parts == [(6, 12), (13, 21)]
    twice = segments(np.tile(codes, 2), np.array([0, 21]), np.array([21, 42]), 6, 4)
    assert twice == [(6, 12), (13, 21), (27, 33), (34, 42)]


def found(df):
    return [
        (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in with_runs(df).collect()
    ]


def test_rows(corpus, prose):
    loop = "one two three " * 30
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a a"), (4, "a a a a a"), (None, f"{prose(9, 1)} {loop}{prose(5, 2)}")]
    rows += [(5, "ab c " * 8), (6, "x" * 100_000), (7, loop), (7, loop)]
    rows += [(100 + i, " ".join(drawn(i))) for i in range(40)]
    result = found(corpus(rows, "runs id kept_text"))
    expected = []
    for doc_id, text in rows:
        words = text.encode().split() if text else []
        words = [w.decode() for w in words]
        runs = by_lags(words)
        expected.append((doc_id, len(words), runs, kept(words, runs)))
    order = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(result, key=order) == sorted(expected, key=order)
    assert found(corpus([])) == []


def test_very_long_texts(corpus, prose):
    begin = time.time()
    same = found(corpus([(1, "a " * 1_000_000)]))
    assert same[0][1:] == (1_000_000, [(0, 1_000_000, 1)], "a")
    passage = prose(20_000, 3)
    long = found(corpus([(1, f"{prose(500, 4)} {' '.join([passage] * 8)} {prose(500, 5)}")]))
    assert [r[1:] for r in long[0][2]] == [(160_000, 20_000)]
    nested = found(corpus([(1, (("a b " * 50 + "c ") * 50 + "d ") * 20)]))
    assert (0, 20 * 5051, 5051) in nested[0][2] and len(nested[0][2]) == 1 + 20 + 1000
    assert time.time() - begin < 120


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(documents)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for d in documents:
        words = [w.decode() for w in (d["text"] or "").encode().split()]
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, row = by_lags(words), rows[d["doc_id"]]
        assert row["n_runs"] == len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == sha("".join(f"{a},{b},{q}\n" for a, b, q in runs))
        assert row["collapsed_sha256"] == sha(kept(words, runs))


def test_texts_made_periodic_handle_nulls(corpus):
    rows = [(i, t) for i in range(60) for t in (None, "", "  ", "one", "one two three four five six")] + [(None, "x y")]
    out = corpus(rows).select("doc_id", "text", made_periodic(F.col("doc_id"), F.col("text")).alias("made")).collect()
    assert len(out) == len(rows) and all((r["text"] is None) == (r["made"] is None) for r in out)
