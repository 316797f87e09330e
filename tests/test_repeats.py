"""Texts under one id, or none, are measured one by one, as they are under ids of their own."""

import pytest

from inkprint.operators import coherence, evaluate, lexicon
from inkprint.operators.language import detect_language, fit_profiles
from inkprint.operators.perplexity import fit_bigram_model, perplexity

TEXTS = ["a b a b c", "x y z", "", "the cat is on the mat, the dog is not", "un chat est sur le lit"]
IDS = [1, 1, 1, None, None]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("en", "the dog is on the mat and a cat is not"), ("fr", "le chat est sur un lit et le chien"), ("en", "x y a b")]
    return spark.createDataFrame(rows, "lang string, text string")


def operators(corpus):
    dictionary, model, profiles = lexicon.dictionary_of(corpus), fit_bigram_model(corpus), fit_profiles(corpus)
    return {
        "coherence": lambda df: coherence.coherence_features(df, ["id"]),
        "bag": lambda df: coherence.bigram_bag(df, ["id"]),
        "top": lambda df: coherence.top_bigram_counts(df, ["id"]),
        "pairs": lambda df: coherence.pair_word_counts(df, ["id"]),
        "tags": lambda df: lexicon.tag_proportions(df, ["id"]),
        "spelling": lambda df: lexicon.spelling_errors(df, ["id"], dictionary),
        "unknown": lambda df: lexicon.unknown_words(df, ["id"], dictionary),
        "language": lambda df: detect_language(df, ["id"], profiles),
        "language, shuffled": lambda df: detect_language(df, ["id"], profiles, max_rows=0),
        "perplexity": lambda df: perplexity(df, ["id"], model, stride=2, width=4),
        "perplexity, shuffled": lambda df: perplexity(df, ["id"], model, stride=2, width=4, max_rows=0),
    }


def values(df, owner):
    others = sorted(c for c in df.columns if c != "id")
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(str((owner(r["id"]), *[plain(r[c]) for c in others])) for r in df.collect())


def test_repeated_and_missing_ids(spark, corpus):
    together = spark.createDataFrame(list(zip(IDS, TEXTS)), "id long, text string")
    apart = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for name, work in operators(corpus).items():
        assert values(work(together), lambda i: i) == values(work(apart), lambda i: IDS[i]), name


def test_texts_without_tokens_have_zero_shares(spark):
    df = spark.createDataFrame([(1, ""), (2, "the")], "id long, text string")
    rows = {r["id"]: r for r in lexicon.tag_proportions(df, ["id"]).collect()}
    assert set(rows) == {1, 2} and sum(rows[1][1:]) == 0 and sum(rows[2][1:]) == 1


def test_grid_comes_from_gold(spark):
    pred = spark.createDataFrame([(1, 0), (2, 2)], "id long, label int")
    gold = spark.createDataFrame([(1, 0), (5, 1), (6, None)], "id long, label int")
    rows = sorted(tuple(r) for r in evaluate.confusion_matrix(pred, gold).collect())
    assert rows == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


