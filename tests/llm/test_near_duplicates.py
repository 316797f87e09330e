import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.llm import near_duplicates
from inkprint.llm.near_duplicates import near_duplicate_classes, similar, without_near_duplicates


def edited(text, share, seed):
    draw = random.Random(seed)
    words = text.split()
    for i in draw.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = draw.choice(["new", words[i] + "x", words[i] + " more"])
    return " ".join(words)


def distance(a, b):
    """Edits between two sequences, by a table of its own."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def near(a, b):
    """Whether at most a fifth of the longer sequence of words has to be edited."""
    budget = len(max(a, b, key=len)) // 5
    if not a or not b or abs(len(a) - len(b)) > budget:
        return False
    if max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > budget:
        return False
    return a == b or distance(a, b) <= budget


def brute(rows):
    """(id, class) by aligning all pairs of texts whose words allow it; the class is its first row."""
    words = [(t or "").encode().split() for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if label[i] != label[j] and near(words[i], words[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return sorted((rows[i][0], rows[x][0]) for i, x in enumerate(label))


def classes(df):
    """The id of each row, and that of the first row of its class."""
    found = near_duplicate_classes(df).collect()
    ids = {r["node"]: r["doc_id"] for r in found}
    return sorted((r["doc_id"], ids[r["class"]]) for r in found)


def test_brute_force(corpus, prose):
    rows = []
    for base in range(12):
        text = prose(120, base)
        rows += [(base * 20 + k, edited(text, 0.01 * (k % 4 + 1), base * 100 + k)) for k in range(6)]
        rows.append((base * 20 + 10, prose(60, 900 + base) + " " + text[:150]))
    rows += [(1000 + k, rows[0][1]) for k in range(30)]  # exact copies
    rows += [(2000 + k, edited(rows[7][1], 0.02, k)) for k in range(40)]  # a large group
    rows += [(3000, "one two"), (3001, "one two"), (3002, "one  two\n"), (3003, "one")]
    rows += [(4000, ""), (4001, None), (4002, " \n")]
    rows.sort()
    assert classes(corpus(rows, "node class a b bucket row_id")) == brute(rows)


def test_repeated_and_null_ids(corpus, prose):
    text = prose(20_000, 1)
    rows = [(1, text), (1, prose(70, 5)), (2, edited(text, 0.01, 2)), (None, text), (None, "alone in the world of words"), (None, None)]
    found = near_duplicate_classes(corpus(rows)).collect()
    groups = Counter(r["class"] for r in found)
    assert len({r["node"] for r in found}) == 6 and sorted(groups.values()) == [1, 1, 1, 3]
    assert sorted(str(r["doc_id"]) for r in found if groups[r["class"]] == 3) == ["1", "2", "None"]


@pytest.mark.parametrize("share, recall", [(0.02, 1.0), (0.05, 0.99), (0.08, 0.95), (0.1, 0.9)])
def test_recall_by_share_of_edited_words(corpus, prose, share, recall):
    rows = []
    for i in range(200):
        text = prose(200, 7000 + i)
        rows += [(2 * i, text), (2 * i + 1, edited(text, share, i))]
    found = dict(classes(corpus(rows)))
    caught = [found[2 * i + 1] == 2 * i for i in range(200)]
    assert sum(caught) >= recall * len(caught)


def test_one_of_each_class_stays(corpus, prose):
    a, b = prose(80, 1), prose(80, 2)
    rows = [(5, a), (3, edited(a, 0.01, 1)), (9, a), (3, b), (4, b), (6, None), (6, None), (7, "")]
    kept = without_near_duplicates(corpus(rows, "_row _other node"))
    assert kept.columns[-3:] == ["_row", "_other", "node"]
    # Two texts under the id 3: one of each class stays, whatever its id is.
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == 5 and sum(near((t or "").split(), b.split()) for _, t in found) == 1
    assert sum(near((t or "").split(), a.split()) for _, t in found) == 1
    assert sorted(i for i, t in found if not t) == [6, 6, 7]
    once = without_near_duplicates(corpus([(5, a), (3, edited(a, 0.01, 1)), (4, b)], "_row"))
    assert sorted(r["doc_id"] for r in once.collect()) == [3, 4]
    assert kept.filter(F.col("node") == "kept").count() == 5


def test_repeated_lines_count(corpus, prose):
    line = " the same two words" * 150
    rows = [(i, prose(60, i) + line) for i in range(12)] + [(15, prose(300, 15) + line)]
    rows += [(20, "on and on it goes " * 30), (21, "on and on it goes " * 60)]
    assert classes(corpus(rows)) == brute(rows) == [(i, 0) for i in range(12)] + [(15, 15), (20, 20), (21, 21)]


@pytest.mark.parametrize("rounds", [0, 1])
def test_large_buckets_are_cut(corpus, prose, monkeypatch, rounds):
    """Texts with one passage and nothing else in common, some of them near copies of each other."""
    monkeypatch.setattr(near_duplicates, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_duplicates, "WHOLE_ROUNDS", rounds)
    cut, before = [], near_duplicates._cut_by_prefix

    def counted(large, texts, similarity):
        after = near_duplicates.materialize(before(large, texts, similarity))
        cut.append((large.select("node").distinct().count(), after.select("node").distinct().count()))
        return after

    monkeypatch.setattr(near_duplicates, "_cut_by_prefix", counted)
    passage = " " + prose(70, 1) + " "
    rows = []
    for i in range(40):
        text = prose(60, 100 + i) + passage + prose(50, 200 + i)
        rows.append((2 * i, text))
        if i % 4 == 0:
            rows.append((2 * i + 1, edited(text, 0.05 + 0.01 * (i % 8), i)))
    assert classes(corpus(rows)) == brute(rows)
    assert len(cut) == 1 and cut[0][0] >= 30 and cut[0][1] < cut[0][0]


def test_empty_table(corpus):
    assert near_duplicate_classes(corpus([])).collect() == []
    assert without_near_duplicates(corpus([])).collect() == []


def test_order_counts(corpus):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:] + words[:100]))]
    assert classes(corpus(rows)) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("seed", range(20))
def test_similar_against_the_whole_table(seed):
    draw = random.Random(seed)
    a = [draw.choice("abcdefgh") for _ in range(draw.randint(1, 60))]
    b = list(a)
    for _ in range(draw.randint(0, 16)):
        at = draw.randrange(len(b) + 1)
        b[at : at + draw.randint(0, 1)] = draw.choices("abcdefgh", k=draw.randint(0, 2))
    codes = [np.array([ord(c) for c in x], np.uint64) for x in (a, b)]
    if len(b):
        assert similar(*codes, 0.8) == (distance(a, b) <= max(len(a), len(b)) // 5)


def test_a_group_near_the_limit(corpus, prose, monkeypatch):
    """Texts that share four fifths of their words and hardly more: pairs are not rows of a join."""
    joined, before = [], near_duplicates._Comparison.__call__

    def counted(self, pairs):
        joined.append(pairs.count())
        return before(self, pairs)

    monkeypatch.setattr(near_duplicates._Comparison, "__call__", counted)
    monkeypatch.setattr(near_duplicates, "BLOCK", 32)
    line = " the same" * 80
    rows = [(i, prose(34 + i % 24, i, "abc") + line) for i in range(160)]
    assert classes(corpus(rows)) == brute(rows)
    assert sum(joined) < 4 * len(rows)


def test_overlaps_by_products(monkeypatch):
    monkeypatch.setattr(near_duplicates, "_COUNTED", 7)
    draw = np.random.default_rng(1)
    sides = [[np.unique(draw.integers(0, 60, n)).astype(np.uint64) for n in (1, 9, 40, 0)] for _ in range(2)]
    expected = [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    assert near_duplicates.overlaps(*sides).tolist() == expected
    assert near_duplicates.overlaps(sides[0][:1], [np.array([99], np.uint64)]).tolist() == [[0]]
