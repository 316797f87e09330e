import random
from collections import defaultdict

import numpy as np
import pytest

from inkprint.llm import substrings
from inkprint.llm.substrings import without_repeats
from inkprint.llm.words import Words


def brute(rows, window):
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    first = defaultdict(lambda: float("inf"))
    rank = lambda i: float("inf") if i is None else i
    for i, w in cut:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first[key], rank(i))
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((i, len(w), sum(gone), kept))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()], key=str)


@pytest.mark.parametrize("group_bytes", [200, 1 << 20])
def test_brute_force(corpus, group_bytes):
    draw = random.Random(5)
    phrases = [[draw.choice("abc") * draw.randint(1, 3) for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(60):
        words = [draw.choice("abcd") for _ in range(draw.randint(0, 12))]
        for _ in range(draw.randint(0, 2)):
            words += draw.choice(phrases)
        rows.append((i, draw.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(7, rows[20][1]), (None, rows[30][1]), (None, None), (90, ""), (91, " \n "), (5, rows[5][1])]
    rows += [(100 + i, rows[3][1] + " x") for i in range(20)] + [(200, "é ü  ß " * 9)]
    df = corpus(rows, "part bucket id")
    found = without_repeats(df, window=4, group_bytes=group_bytes, bucket_bytes=300)
    assert got(found) == brute(rows, 4)


def test_removed_ranges(corpus):
    df = corpus([(1, "a b c d e"), (2, "x a b c y b c d e")])
    row = without_repeats(df, window=3).filter("doc_id = 2").first()
    assert [tuple(s) for s in row["removed"]] == [(1, 4), (5, 9)] and row["kept_text"] == "x y"


def test_empty_table(corpus):
    assert without_repeats(corpus([])).collect() == []


def test_a_long_text_and_clashing_hashes(corpus, prose, monkeypatch):
    text = prose(30_000, 1)
    rows = [(1, text), (2, "start " + text + " end")]
    assert got(without_repeats(corpus(rows))) == brute(rows, 13)
    words = Words([b"a b c d a b c d a b x d"])
    monkeypatch.setattr(substrings, "run_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    windows = substrings._Windows(words, words.count, np.array([1]), 3)
    texts = [words.text(s, s + 3) for s in windows.start]
    assert all((texts[i] == texts[j]) == (windows.label[i] == windows.label[j]) for i in range(10) for j in range(10))


def test_words_and_their_hashes(monkeypatch):
    texts = [b"", b"one two\t one", b"  two\r\n", b"\xc3\xa9 one"]
    monkeypatch.setattr("inkprint.llm.words.PIECE_BYTES", 5)
    words = Words(texts)
    cut = [w for t in texts for w in t.split()]
    assert [words.text(i, i + 1) for i in range(len(cut))] == cut
    assert words.count.tolist() == [len(t.split()) for t in texts]
    assert all((a == b) == (x == y) for a, x in zip(cut, words.hashes) for b, y in zip(cut, words.hashes))
