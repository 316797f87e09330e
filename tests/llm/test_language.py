import random

import numpy as np
from pyspark.sql import functions as F

from inkprint.llm import language
from inkprint.llm.language import LanguageFilters, detected, fit_languages, grams_of

ALPHABETS = {"aa": "abcdefg", "bb": "hijklmn", "çç": "opqéüß"}


def texts(prose, n, seed):
    draw = random.Random(seed)
    for i in range(n):
        lang = draw.choice(list(ALPHABETS))
        yield lang, prose(60, seed * 1000 + i, ALPHABETS[lang])


def brute_grams(text):
    letters = "".join(c.lower()[0] if c.lower()[0].isalpha() else " " for c in text)
    padded = " " + " ".join(letters.split()) + " " if letters.strip() else " "
    return [padded[i : i + 4] for i in range(len(padded) - 3)]


def test_grams():
    some = ["", "a", "ab", "abc", "Ab,, cd!", "...", " x\x00y ", "ÉÉß 12 ab", "abcd" * 5]
    letters = language._Letters()
    h, count, has = grams_of(some, letters)
    assert count.tolist() == [len(brute_grams(t)) for t in some]
    assert has.tolist() == [any(c.isalpha() for c in t) for t in some]
    every = [g for t in some for g in brute_grams(t)]
    assert all((a == b) == (x == y) for a, x in zip(every, h) for b, y in zip(every, h))


def test_held_out_accuracy_and_cases(spark, corpus, prose):
    learnt = [(i, t, lang, "s") for i, (lang, t) in enumerate(texts(prose, 240, 1))]
    learnt += [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, prose(30, 4), None, "s"), (None, prose(9, 4), "aa", "s")]
    filters = fit_languages(corpus(learnt, "gram n"))
    assert filters.languages == sorted(ALPHABETS)
    new = list(texts(prose, 200, 2))
    rows = [(i, t) for i, (_, t) in enumerate(new)]
    rows += [(1000, None), (1001, ""), (1002, "12 34 !"), (1003, new[0][1] * 300), (None, "漢字")]
    found = corpus(rows, "found lang_pred").select("doc_id", detected(filters, F.col("text"), spark).alias("f")).collect()
    by_id = {r["doc_id"]: (r["f"]["lang"], r["f"]["score"]) for r in found}
    assert np.mean([by_id[i][0] == lang for i, (lang, _) in enumerate(new)]) > 0.97
    assert by_id[1000] == by_id[1001] == by_id[1002] == ("und", 0.0)
    assert by_id[1003][0] == new[0][0] and by_id[None] == ("aa", 0.0)
    assert all(0 <= s <= 1 for _, s in by_id.values())


def test_filters_answer_like_sets():
    draw = np.random.default_rng(1)
    grams = draw.integers(0, 2**63, 3000).astype(np.uint64)
    member = draw.random((3000, 70)) < 0.3
    cells = np.zeros((1 << language.CELL_BITS, 2), np.uint64)
    for i in range(70):
        for k in range(language.HASHES):
            at = LanguageFilters.slots(grams[member[:, i]], k)
            np.bitwise_or.at(cells[:, i // 64], at, np.uint64(1) << np.uint64(i % 64))
    filters = LanguageFilters([f"l{i:02}" for i in range(70)], cells)
    masks = cells[filters.slots(grams, 0)] & cells[filters.slots(grams, 1)] & cells[filters.slots(grams, 2)]
    answer = np.array([filters._bit(masks, i).astype(bool) for i in range(70)]).T
    assert (answer | ~member).all()  # nothing that is held is missed
    assert (answer & ~member).mean() < 0.001


def test_nothing_to_learn(spark, corpus):
    assert fit_languages(corpus([(1, "a", None, "s")])) is None
    row = corpus([(1, "a")]).select(detected(None, F.col("text"), spark).alias("f")).first()
    assert row["f"]["lang"] == "und"
