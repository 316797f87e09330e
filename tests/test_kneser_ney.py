"""Kneser-Ney of three words, against its definition in plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest

from inkprint.operators.kneser_ney import fit_trigram_model, probability, trigram_perplexity
from inkprint.operators.perplexity import fit_bigram_model, perplexity

CORPUS = ["a b c a b d", "a b c", "b c a, b c d.", "d", "", None, "c a b c a b"]


class Plain:
    def __init__(self, texts, d=0.75):
        words = [re.findall(r"\w+|[^\w\s]", (t or "").lower()) for t in texts]
        self.d, self.v = d, len({w for t in words for w in t})
        self.three = Counter(x for t in words for x in zip(t, t[1:], t[2:]))
        self.two = Counter(x[1:] for x in self.three)
        self.one = Counter(x[1] for x in self.two)

    def level(self, counts, context, word, lower):
        follow = {k[-1]: n for k, n in counts.items() if k[:-1] == context}
        if not follow:
            return lower
        total = sum(follow.values())
        return max(follow.get(word, 0) - self.d, 0) / total + self.d * len(follow) / total * lower

    def p(self, u, v, w):
        flat = {(k,): n for k, n in self.one.items()}
        p = self.level(flat, (), w, 1 / (self.v + 1))
        p = self.level(self.two, (v,), w, p)
        return p if u is None else self.level(self.three, (u, v), w, p)


@pytest.fixture(scope="module")
def model(spark):
    return fit_trigram_model(spark.createDataFrame(list(enumerate(CORPUS)), "id long, text string"))


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 0}])
def test_probabilities(spark, model, bounds):
    plain = Plain(CORPUS)
    words = ["a", "b", "c", "d", ",", "new"]
    rows = [(u, v, w) for u in [None, *words] for v in words for w in words]
    found = probability(spark.createDataFrame(rows, "w1 string, w2 string, w3 string"), model, ["w1"], **bounds).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["p"] == pytest.approx(plain.p(r["w1"], r["w2"], r["w3"]), abs=1e-12)
    # All words and one unseen share the whole.
    by_context = defaultdict(float)
    known = [*sorted({w for t in CORPUS for w in re.findall(r"\w+|[^\w\s]", (t or "").lower())}), "new"]
    for v in ("a", "b", "new"):
        by_context[v] = sum(plain.p("a", v, w) for w in known)
    assert all(p == pytest.approx(1) for p in by_context.values())


def test_perplexity_of_texts(spark, model):
    plain = Plain(CORPUS)
    texts = ["a b c d", "a new b c a b", "a", "", None, "c a b d b c a b c"]
    rows = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "id long, text string")
    found = sorted((r["id"], r["perplexity"]) for r in trigram_perplexity(rows, ["id"], model, stride=2, width=4).collect() if r["perplexity"])

    def brute(text):
        words, losses, done = text.split(), [], 0
        for begin in range(0, len(words), 2):
            end = min(begin + 4, len(words))
            if begin and done >= end:
                break
            own = [
                -math.log(plain.p(words[i - 2] if i > begin + 1 else None, words[i - 1], words[i]))
                for i in range(max(done, begin + 1), end)
            ]
            losses.append(sum(own) / len(own))
            done = end
        return math.exp(sum(losses) / len(losses))

    expected = sorted((i % 5, brute(t)) for i, t in enumerate(texts) if t and len(t.split()) > 1)
    assert [i for i, _ in found] == [i for i, _ in expected]
    assert [p for _, p in found] == pytest.approx([p for _, p in expected])


def test_nothing_to_learn(spark):
    empty = fit_trigram_model(spark.createDataFrame([(1, "one two"), (2, None)], "id long, text string"))
    texts = spark.createDataFrame([(1, "x y z")], "id long, text string")
    assert trigram_perplexity(texts, ["id"], empty).first()["perplexity"] == pytest.approx(3)


def test_better_than_two_words_with_one_added(spark, sf_dir):
    """Held-out turns of the same kind of talk."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("xxhash64(conv_id, turn) AS id", "conv_id", "text")
    train, held = turns.filter("conv_id % 5 <> 0"), turns.filter("conv_id % 5 = 0")
    mean = lambda df: df.selectExpr("avg(ln(perplexity)) AS m").first()["m"]
    three = mean(trigram_perplexity(held, ["id"], fit_trigram_model(train)))
    two = mean(perplexity(held, ["id"], fit_bigram_model(train)))
    assert three < two


def test_words_are_not_shuffled_to_a_small_model(docs):
    frame = trigram_perplexity(docs("a b c d", "d e"), ["id"], fit_trigram_model(docs("a b c a b d")), unique=True)
    planned = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in planned and "w1" not in "".join(x for x in planned.splitlines() if "hashpartitioning" in x)
