"""Style, coherence, word lists and perplexity against plain Python."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkprint.functions.patterns import PUNCTUATION, TAGS_MONO, TAGS_MULTI
from inkprint.operators import coherence, in_text, language, lexicon
from inkprint.operators.language import detect_language, fit_profiles
from inkprint.operators.perplexity import fit_bigram_model, perplexity, scoring_windows
from inkprint.operators.style import style_features
from inkprint.plans import features as plan

WORDS = re.compile(r"\.\.\.|--|\w+|[^\w\s]")


def by_id(df):
    return {row["id"]: row for row in df.collect()}


def random_texts(count, seed=1, longest=60):
    draw = random.Random(seed)
    words = ["a", "b", "c", "The", "cat", "sat", ".", ",", "!", "...", "42", "Cat"]
    return [" ".join(draw.choices(words, k=draw.randint(0, longest))) for _ in range(count)]


# ------------------------------------------------------------------------- style


def test_style_edges(docs):
    rows = by_id(style_features(docs("", "One two. Three four five six.", "()", "Hi ... there"), ["id"]))
    assert rows[0][1:] == (0.0, 0.0, None, 0.0)
    assert rows[1].variability == 1.0 and rows[1].avg_sentence_length == 3.0
    assert rows[1].sentence_length_range == 2.0
    assert rows[1].avg_word_length == pytest.approx((3 + 3 + 5 + 4 + 4 + 3) / 6)
    assert rows[2].avg_word_length is None
    assert rows[3].avg_word_length == pytest.approx((2 + 3 + 5) / 3)


# --------------------------------------------------------------------- coherence


def plain_coherence(text):
    tokens = WORDS.findall(text.lower())
    words, pairs = Counter(tokens), Counter(zip(tokens, tokens[1:]))
    n, m = len(tokens), max(len(tokens) - 1, 0)
    pmi, npmi = [], []
    for (x, y), k in pairs.items():
        value = math.log((k / m) / (words[x] / n * words[y] / n))
        pmi.append(value)
        npmi.append(0 if k == m else value / -math.log(k / m))
    top = [k for _, k in pairs.most_common(10)]
    mean = [sum(v) / len(v) if v else 0 for v in (pmi, npmi)]
    return mean + top + [0] * (10 - len(top))


def test_coherence_of_random_texts(docs):
    texts = random_texts(60) + ["", "a", "a b", "a a a a", "a b a b a b", "a b c"]
    rows = by_id(coherence.coherence_features(docs(*texts), ["id"]))
    for i, text in enumerate(texts):
        assert list(rows[i][1:]) == pytest.approx(plain_coherence(text), abs=1e-9)


def test_known_pmi_values(docs):
    rows = by_id(coherence.coherence_features(docs("a b", "a b c", "a"), ["id"]))
    assert rows[0].avg_pmi == pytest.approx(math.log(4)) and rows[0].avg_npmi == 0
    assert rows[1].avg_npmi == pytest.approx(math.log(4.5) / math.log(2))
    assert (rows[2].avg_pmi, rows[2].avg_npmi) == (0, 0)


def test_texts_are_shuffled_once(docs):
    frame = coherence.coherence_features(docs("a b c", "d e"), ["id"])
    executed = frame._jdf.queryExecution().sparkPlan()
    planned = frame._jdf.queryExecution().executedPlan().toString()
    assert executed is not None and planned.count("Exchange hashpartitioning") == 1


def test_token_stats(docs):
    rows = by_id(coherence.token_stats(docs("a b a", "", "x"), ["id"]))
    assert [tuple(rows[i][1:]) for i in range(3)] == [(3, 2, 2), (0, 0, 0), (1, 1, 0)]


def test_adjacent_pairs(docs):
    rows = coherence.adjacent_pairs(docs("A b c", "x", ""), ["id"]).orderBy("pos").collect()
    assert [(r.id, r.pos, r.first, r.second) for r in rows] == [(0, 0, "a", "b"), (0, 1, "b", "c")]


def test_bag_and_its_strict_form(docs):
    texts = docs("The cat, the CAT", "don't go")
    whole = coherence.bigram_bag(texts, ["id"]).collect()
    assert {(r.id, r.bigram): r.n for r in whole} == {
        (0, "the_cat"): 2, (0, "cat_,"): 1, (0, ",_the"): 1, (1, "don't_go"): 1
    }
    strict = coherence.bigram_bag(texts, ["id"], strict=True).collect()
    assert {(r.id, r.bigram): r.n for r in strict} == {
        (0, "the_cat"): 2, (0, "cat_"): 1, (0, "_the"): 1, (1, "don"): 1, (1, "t_go"): 1
    }


def test_top_counts_pad_to_the_vocabulary(docs):
    small = by_id(coherence.top_bigram_counts(docs("a b a b", "c", "a b"), ["id"]))
    assert [small[i].counts for i in range(3)] == [[2, 1], [0, 0], [1, 0]]
    large = by_id(coherence.top_bigram_counts(docs(" ".join("abcdefghijklmnop"), "a b a b"), ["id"]))
    assert large[0].counts == [1] * 10 and large[1].counts == [2, 1] + [0] * 8


# --------------------------------------------------------------------- word lists


def test_unknown_words(docs):
    known = lexicon.dictionary_of(docs("The cat sat, 99 times"))
    texts = docs("The dog, the dog 12 nan 1e-5 ... !", "cat", "", "cat" * 10 + " abcdefgh abcdefghi")
    counts = by_id(lexicon.spelling_errors(texts, ["id"], known))
    # "..." is long enough to be looked up, and no word is too long.
    assert [counts[i].spelling_error for i in range(4)] == [2, 0, 0, 3]
    words = lexicon.unknown_words(texts, ["id"], known).collect()
    assert {(r.id, r.word) for r in words} == {
        (0, "dog"), (0, "..."), (3, "abcdefgh"), (3, "abcdefghi"), (3, "cat" * 10)
    }


def test_tags(docs):
    rows = lexicon.token_tags(docs("The dog quickly barked , 42 London ."), ["id"]).orderBy("pos").collect()
    assert [r.tag for r in rows] == ["DT", "NN", "RB", "VBD", ",", "CD", "NNP", "."]


def test_tag_shares_sum_to_one_at_most(docs):
    shares = lexicon.tag_proportions(docs(*random_texts(20, 3), "She runs ( fast ) ."), ["id"])
    assert len(shares.columns) == 46
    for row in shares.collect():
        assert 0 < sum(row[1:]) <= 1 + 1e-9


def test_universal_tags_follow_the_language(spark):
    rows = spark.createDataFrame(
        [(1, "der Hund", "de"), (2, "der Hund", "xx"), (3, "the Hund", "xx")],
        "id long, text string, language string",
    )
    shares = by_id(lexicon.tag_proportions(rows, ["id"], TAGS_MULTI, language="language"))
    assert shares[1].tag_DET == 0.5 and shares[2].tag_DET == 0 and shares[3].tag_DET == 0.5


def test_plain_tag_names(spark):
    frame = spark.range(1).select(*[F.lit(0.0).alias(lexicon.tag_column(t)) for t in TAGS_MONO])
    assert lexicon.with_plain_tag_names(frame).columns == TAGS_MONO


def test_tags_by_form_cover_the_universal_set():
    for _, _, tag in lexicon.FORM_RULES:
        assert lexicon.UNIVERSAL_BY_PENN[tag] in TAGS_MULTI and tag in TAGS_MONO
    assert all(mark in PUNCTUATION for mark in "()[]{}")


# ---------------------------------------------------------------------- language


def test_language(spark):
    train = spark.createDataFrame(
        [("the cat and the dog with the bird", "en"), ("der hund und die katze mit dem vogel", "de")],
        "text string, lang string",
    )
    profiles = fit_profiles(train)
    texts = spark.createDataFrame(
        [(0, "the dog and the cat"), (1, "die katze und der hund"), (2, ""), (3, "ab")],
        "id long, text string",
    )
    rows = by_id(detect_language(texts, ["id"], profiles))
    assert [rows[i].language for i in range(4)] == ["en", "de", "en", "en"]


# -------------------------------------------------------------------- perplexity


def plain_windows(n, stride, width):
    windows, previous = [], 0
    for begin in range(0, n, stride):
        end = min(begin + width, n)
        windows.append((begin, end, end - previous))
        previous = end
        if end == n:
            break
    return windows


def plain_perplexity(tokens, pairs, contexts, size, stride, width):
    losses = []
    for begin, end, target in plain_windows(len(tokens), stride, width):
        first = max(end - target, begin)
        scored = [
            -math.log(
                (pairs[tokens[p - 1], tokens[p]] + 1) / (contexts[tokens[p - 1]] + size + 1)
            )
            for p in range(first, end)
            if p > begin
        ]
        if not scored:
            return None
        losses.append(sum(scored) / len(scored))
    return math.exp(sum(losses) / len(losses)) if losses else None


@pytest.mark.parametrize("stride, width", [(4, 8), (5, 5), (3, 7), (9, 4), (512, 1024)])
def test_perplexity(docs, stride, width):
    corpus = random_texts(12, 7)
    texts = random_texts(25, 8, 40) + ["", "a", "zzz unseen", "a " * 11, "a " * 6]
    pairs, contexts, vocabulary = Counter(), Counter(), set()
    for text in corpus:
        tokens = WORDS.findall(text.lower())
        pairs.update(zip(tokens, tokens[1:]))
        contexts.update(tokens[:-1])
        vocabulary.update(tokens)
    model = fit_bigram_model(docs(*corpus))
    assert model.vocabulary == len(vocabulary)
    rows = by_id(perplexity(docs(*texts), ["id"], model, stride=stride, width=width))
    for i, text in enumerate(texts):
        wanted = plain_perplexity(
            WORDS.findall(text.lower()), pairs, contexts, len(vocabulary), stride, width
        )
        assert rows[i].perplexity == (None if wanted is None else pytest.approx(wanted)), text


@pytest.mark.parametrize("stride, width", [(4, 8), (5, 5), (3, 7), (9, 4)])
def test_scoring_windows(docs, stride, width):
    texts = ["a " * n for n in range(0, 30)]
    rows = scoring_windows(docs(*texts), ["id"], stride=stride, width=width).collect()
    for i in range(30):
        mine = sorted((r.begin, r.end, r.trg_len) for r in rows if r.id == i)
        assert mine == plain_windows(i, stride, width)


# ------------------------------------------------------------------ feature table


def test_feature_table(docs):
    texts = ["The cat sat. The dog ran!", "", "One.", "A cat & a dog... <b>bold</b>"]
    frame, corpus = docs(*texts), docs("The cat sat on the mat.")
    raw = plan.raw_features(frame, lexicon.dictionary_of(corpus))
    assert raw.columns == ["id", *plan.feature_names(False)] and len(raw.columns) == 62 + 1
    assert raw.count() == 4
    empty = raw.filter("id = 1").first().asDict()
    assert empty.pop("id") == 1 and empty.pop("avg_word_length") is None
    assert set(empty.values()) == {0.0}
    scores = plan.document_perplexity(frame, fit_bigram_model(corpus))
    table = plan.feature_table(raw, scores)
    assert table.columns[-1] == "perplexity" and table.count() == 4
    sums = table.agg(*[F.sum(c).alias(c) for c in plan.feature_names(False)]).first()
    assert all(abs(v) < 1e-9 for v in sums)


def test_multilingual_feature_table(spark, docs):
    train = spark.createDataFrame([("the cat", "en"), ("der hund", "de")], "text string, lang string")
    raw = plan.raw_features(docs("der hund ist da", "the cat"), profiles=fit_profiles(train))
    assert raw.columns == ["id", *plan.feature_names(True)] and len(raw.columns) == 33 + 1
    assert by_id(raw)[0].tag_DET == 0.25


def test_missing_text_and_missing_id(spark):
    rows = spark.createDataFrame([(1, None), (2, "a b c"), (None, "a")], "id long, text string")
    corpus = spark.createDataFrame([("a b",)], "text string")
    raw = by_id(plan.raw_features(rows, lexicon.dictionary_of(corpus)))
    assert set(raw) == {None, 1, 2} and raw[1].variability == 0 and raw[1].spelling_error == 0
    scores = by_id(plan.document_perplexity(rows, fit_bigram_model(corpus)))
    assert scores[1].perplexity is None and scores[2].perplexity > 1


def test_feature_sets_exclude_each_other(docs):
    with pytest.raises(ValueError):
        plan.raw_features(docs("a"))


def test_texts_under_one_id_are_measured_apart(spark):
    # A third of the rows shares an id, some of them are copies.
    texts = random_texts(10, 11) + ["a b a b"] * 5
    rows = [(7 if i % 3 == 0 else 100 + i, t) for i, t in enumerate(texts)]
    repeated = spark.createDataFrame(rows, "id long, text string").repartition(3)
    apart = spark.createDataFrame(list(enumerate(t for _, t in rows)), "id long, text string")
    corpus = spark.createDataFrame([("a b c cat",)], "text string")
    known = lexicon.dictionary_of(corpus)
    mine = plan.raw_features(repeated, known).collect()
    wanted = plan.raw_features(apart, known).collect()

    def without_id(found):
        return sorted(([round(v, 9) + 0.0 for v in r[1:] if v is not None] for r in found), key=str)

    assert without_id(mine) == without_id(wanted)
    assert Counter(r.id for r in mine) == Counter(i for i, _ in rows)

    model = fit_bigram_model(corpus)
    single = {r.id: r.perplexity for r in plan.document_perplexity(apart, model).collect()}
    merged = {r.id: r.perplexity for r in plan.document_perplexity(repeated, model).collect()}
    hot = [single[i] for i, (key, _) in enumerate(rows) if key == 7 and single[i] is not None]
    assert merged[7] == pytest.approx(sum(hot) / len(hot)) and len(merged) == len({i for i, _ in rows})


def test_same_results_without_broadcasts(docs, monkeypatch):
    texts, corpus = docs(*random_texts(30, 12)), docs(*random_texts(5, 13, 20))
    model, known = fit_bigram_model(corpus), lexicon.dictionary_of(corpus)

    def results():
        scores = by_id(perplexity(texts, ["id"], model, stride=4, width=8))
        errors = by_id(lexicon.spelling_errors(texts, ["id"], known))
        return [
            (errors[i].spelling_error, scores[i].perplexity and round(scores[i].perplexity, 9))
            for i in range(30)
        ]

    small = results()
    monkeypatch.setattr("inkprint.operators.distribute.fits_broadcast", lambda *a: False)
    assert results() == small


# --------------------------------------------------------------- counting inside rows


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: coherence.pair_word_counts(df, ["id"], unique=True),
        lambda df: coherence.bigram_bag(df, ["id"], unique=True),
        lambda df: coherence.bigram_bag(df, ["id"], strict=True, unique=True),
    ],
)
def test_pairs_of_a_text_are_counted_without_a_shuffle_or_a_sort(docs, operator):
    planned = plan_of(operator(docs("a b c", "d e")))
    assert "Exchange" not in planned and "Sort" not in planned and "Aggregate" not in planned


def test_coherence_shuffles_sums_and_no_pairs(docs):
    planned = plan_of(coherence.coherence_features(docs("a b c", "d e"), ["id"], unique=True))
    # The plan's last lines are its first steps: all that is shuffled comes from counts of pairs.
    below = planned[planned.index("MapInArrow") :]
    assert "Exchange" not in below and "Window" not in planned


def test_texts_of_different_lengths_are_counted_piece_by_piece(monkeypatch):
    monkeypatch.setattr(in_text, "PIECE", 4)
    rows = [["a", "b"], [], ["a"] * 9, None, ["b", "a", "b"], ["c"], ["a", "b", "a", "b"]]
    batch = pa.record_batch([pa.array(rows, pa.list_(pa.string()))], [in_text._ITEMS])
    parts = list(in_text._pieces(batch))
    assert [p.num_rows for p in parts] == [2, 1, 3, 1]
    assert [x for p in parts for x in p[in_text._ITEMS].to_pylist()] == rows
    row, first, second, k, c1, c2 = in_text.Piece(parts[3][in_text._ITEMS]).pairs()
    assert sorted(zip(first.tolist(), second.tolist(), k.tolist(), c1.tolist(), c2.tolist())) == [
        (0, 1, 2, 2, 2), (1, 0, 1, 2, 2)
    ]
    assert all(len(c) == 0 for c in in_text.Piece(parts[0][in_text._ITEMS].slice(1)).pairs())


def test_tags_shuffle_sums_and_no_tokens(docs):
    planned = plan_of(lexicon.tag_proportions(docs("The cat", "", "a b"), ["id"], unique=True))
    assert "hashpartitioning" not in planned[planned.index("MapInArrow") :]
    rows = by_id(lexicon.tag_proportions(docs("The cat", "", "the the a cat").select("id", F.nullif("text", F.lit("")).alias("text")), ["id"]))
    assert [rows[i].tag_DT for i in range(3)] == [0.5, 0.0, 0.75]


def test_trigrams_are_those_of_the_text(docs):
    texts = ["ab😀c", "ab", "", "aaaa", "a\nb\x00é", "abcabc"]
    rows = docs(*texts).withColumn("text", F.nullif("text", F.lit("")))
    found = in_text.item_counts(rows, ["id"], F.col("text"), "gram", blank=True, piece=in_text.Trigrams)
    plain = {(i, t[j : j + 3]): 0 for i, t in enumerate(texts) for j in range(len(t) - 2)}
    for i, t in enumerate(texts):
        for j in range(len(t) - 2):
            plain[i, t[j : j + 3]] += 1
    plain |= {(i, None): 0 for i in (1, 2)}
    assert {(r.id, r.gram): r.n for r in found.collect()} == plain


def test_more_languages_than_columns_give_the_same_scores(docs, monkeypatch):
    known = docs("the cat is here", "le chat est ici", "die katze").withColumn("lang", F.concat(F.lit("l"), "id"))
    profiles = fit_profiles(known)
    scores = lambda: by_id(language.language_scores(docs("the cat", "", "xy", "le chat"), ["id"], profiles))
    wide = scores()
    monkeypatch.setattr(language, "WIDE", 0)
    rows = scores()
    for i in range(4):
        assert (wide[i].scores is None) == (rows[i].scores is None) == (i in (1, 2))
        assert [tuple(x) for x in wide[i].scores or []] == [pytest.approx(tuple(x)) for x in rows[i].scores or []]


def test_features_of_a_text_are_counted_in_its_row(docs):
    """Features of all parts come from one pass over a text, and equal those of the parts."""
    texts = ["ΑΣ.Α ΣΑΣ ΑΣ'Α, İs THE cat. The cat", "", None, "( )", *random_texts(20, 5)]
    df = docs(*texts)
    dictionary = lexicon.dictionary_of(docs("the cat"))
    raw = plan.raw_features(df, dictionary)
    assert plan_of(raw).count("MapInArrow") == 1
    found = by_id(raw.select("id", "avg_word_length", "avg_pmi", "avg_npmi", "bigram0", "tag_DT", "tag_NNP"))
    present = df.select("id", F.coalesce("text", F.lit("")).alias("text"))
    style = by_id(style_features(present, ["id"]).select("id", "avg_word_length"))
    pairs = by_id(coherence.coherence_features(present, ["id"]).select("id", "avg_pmi", "avg_npmi", "bigram0"))
    tags = by_id(lexicon.tag_proportions(present, ["id"]).select("id", "tag_DT", "tag_NNP"))
    for i in range(len(texts)):
        assert found[i][1:] == pytest.approx((*style[i][1:], *pairs[i][1:], *tags[i][1:]), abs=1e-12, nan_ok=True)
