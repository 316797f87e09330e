import math
import random

import pytest

from inkprint.llm.quality_rules import (
    ALPHA,
    COST,
    DELTA,
    GRID,
    RULES,
    binomial_tail,
    certified_cutoff,
    judged,
    measures,
)


def plain(text):
    words = [w.decode() for w in text.encode().split()]
    runs = list(zip(words, words[1:], words[2:]))
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
        sum("A" <= c <= "Z" for c in text), text.count("!"),
    )


def test_measures():
    draw = random.Random(2)
    texts = ["", " \n", "a", "é b c", "a a a a", "x\n\nx\n x\nx \ny"]
    for _ in range(200):
        n = draw.randint(0, 60)
        texts.append("".join(draw.choice(["a", "b ", "c\n", "é", "#", "A!", " \t"]) for _ in range(n)))
    for text in texts:
        assert measures(text) == plain(text), text


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.02), (20, 400, 0.05), (10, 10, 0.5)])
def test_binomial_tail(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoffs_stop_at_the_first_failure():
    good = [0, 0, 0, 300, 0]
    assert certified_cutoff(good, [0, 5, 9, 50, 90], 5000, 0.01, 0.01) == 2
    assert certified_cutoff([0, 0], [0, 0], 5000, 0.01, 0.01) is None
    assert certified_cutoff([0, 0], [5, 6], 10, 0.01, 0.01) is None  # too few to be sure
    assert certified_cutoff([], [], 0, 0.01, 0.01) is None


def brute(rows, labels):
    measured = [(i, lang or "", plain(t or "")) for i, t, lang in rows]
    scores = []
    for i, lang, (n, chars, sym, lines, dup, rep, up, bang) in measured:
        failed = n < 50 or 100 * rep > 50 * n
        chars = max(1, chars)
        of = {
            "symbols": 1000 * sym // chars, "dup_lines": 1000 * dup // max(1, lines),
            "repeats": 1000 * rep // max(1, n), "capitals": 1000 * up // chars, "exclaims": 1000 * bang // chars,
        }
        scores.append((i, lang, failed, of))
    holdout = [(s, q) for s in scores for j, q in labels if j == s[0] and q is not None and not s[2]]
    strata = {s[1] for s, _ in holdout}
    limit = {}
    for lang in strata:
        good = [s[3] for s, q in holdout if s[1] == lang and q == 1]
        bad = [s[3] for s, q in holdout if s[1] == lang and q == 0]
        for rule in RULES:
            best = 0
            for c in GRID:
                lost, caught = sum(x[rule] > c for x in good), sum(x[rule] > c for x in bad)
                level = DELTA / (len(strata) * len(RULES))
                if not good or binomial_tail(lost, len(good), ALPHA / len(RULES)) > level:
                    break
                if caught - COST * lost > best:
                    best = caught - COST * lost
                    limit[lang, rule] = c
    return sorted(
        [(i, failed, not failed and not any(of[r] > limit.get((lang, r), 10**9) for r in RULES)) for i, lang, failed, of in scores],
        key=str,
    )


def test_brute_force(spark, corpus, prose):
    rows, labels = [], []
    for i in range(2400):
        text = prose(60, i)
        bad = i % 8 == 0
        if bad:
            text = text.replace(" ", "### ")
        elif i % 311 == 0:
            text += " #### ####"
        rows.append((i, text, "en" if i % 10 else "fr"))
        labels.append((i, 0 if bad else 1))
    rows += [(9001, None, "en"), (9002, "", None), (9003, prose(99, 1) + "$" * 300, None), (None, prose(70, 3), "en")]
    rows += [(9004, "a b c " * 40, "en"), (0, rows[0][1], "en")]
    labels += [(9003, 1), (5, None), (None, 1), (9999, 0)]
    df = corpus([(*r, "a") for r in rows], "stratum label m n_words_")
    found = judged(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sorted([(r["doc_id"], r["base_failed"], r["kept"]) for r in found], key=str) == brute(rows, labels)
    assert any(r["rejected_by"] for r in found)


def test_no_labels_and_empty_table(spark, corpus, prose):
    none = spark.createDataFrame([], "doc_id long, quality int")
    (row,) = judged(corpus([(1, prose(60, 1) + " ####" * 9)]), none).collect()
    assert row["kept"] and not row["base_failed"]
    assert judged(corpus([]), none).collect() == []
