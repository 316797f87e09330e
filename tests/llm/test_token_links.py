import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from inkprint.llm import token_links
from inkprint.llm.queries import op13_token_links
from inkprint.llm.sparse import Csr, product
from inkprint.llm.token_links import TOKENIZERS, overlap_links, token_groups, two_tokenizers


@pytest.fixture(scope="module")
def whole():
    """Tokens of a whole text by both libraries, with their bytes."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    alphabet = token_links.byte_alphabet()
    assert decoders.ByteLevel().decode(["Ġé"]) != ""

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            data = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
            right.append((i, data))
        return left, right

    return tokens


def brute(tokens, text):
    """(groups, links) of a text: each group has ids of A and of B; from the definition."""
    if not text:
        return []
    left, right = tokens(text)
    data = b" " + text.encode()
    if b"".join(d for _, d in left) != data or b"".join(d for _, d in right) != data:
        return []

    def ends(side):
        at, out = 0, []
        for i, d in side:
            at += len(d)
            out.append((at, i))
        return out

    both = {e for e, _ in ends(left)} & {e for e, _ in ends(right)}
    sides = []
    for side in (left, right):
        cut = [[]]
        for e, i in ends(side):
            cut[-1].append(i)
            if e in both:
                cut.append([])
        assert cut.pop() == []
        sides.append(cut)
    return list(zip(*sides, strict=True))


def spelled(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def links(groups):
    return [(x, y) for a, b in groups for x in a for y in b]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b ", "\n", "a\nb", "a \nb", "a\n b", "\t x\r\n y", "<|endoftext|>", "x <|endoftext|> y",
    "<s> and </s> <unk>", "<0x41> é", "ﬁ ﬃ", "é e", "　x y", "a b c", "a​b ​ c", "日本語 テキスト です", "🙂 🙂🙂 a🙂",
    "don't can't 'll x'll 's", "1234567890 12 345", "=" * 300 + " " + "-" * 77, "a" * 1000, "ab" * 500, " " * 50 + "x", "x" + " " * 50,
    "▁ a ▁b", "a ▁", "﻿bom a", "\x1cq \x1d w", "q\x85 w\x85x y", "a \x00 b", "ÀÉ Õ ñ", "naïve café", "́ x ́y", "a  b", "ǅ Ω Ωx",
]


def letters(seed):
    draw = random.Random(seed)
    pool = ["a", "b", "the", " ", " ", " ", "  ", "\n", "é", "日", "🙂", "'s", "1", "23", "=", "==", ".", "▁", " ", "​", "́", "Ab", "ing", "\t"]
    return "".join(draw.choices(pool, k=draw.randint(1, 60)))


def test_pieces_are_tokenized_like_whole_texts(whole):
    both = two_tokenizers(TOKENIZERS)
    assert both.parts
    texts = [t for t in ODD if t] + [letters(i) for i in range(1500)]
    for text in texts:
        pieces = token_links._CUT.split(text)
        assert " ".join(pieces) == text
        ids_a, ids_b = both.encoded(pieces)
        left, right = whole(text)
        assert [i for x in ids_a for i in x] == [i for i, _ in left], repr(text)
        if "▁" in text:  # B takes it for a space, so that the text has no tokens
            assert brute(whole, text) == []
        else:
            assert [i for x in ids_b for i in x] == [i for i, _ in right], repr(text)


def test_groups_and_links(corpus, whole, tmp_path, spark, monkeypatch):
    monkeypatch.setattr(token_links, "in_pieces", lambda sizes, bound=300: in_small_pieces(sizes, min(bound, 300)))
    texts = ODD + [letters(i) for i in range(60)] + ["the same words", "the same words", "the  same words"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again and again"), (None, "again"), (None, None)]
    df = corpus(rows, "chunk pairs groups n_a id")
    groups = [brute(whole, t) for _, t in rows]
    made = {(r["doc_id"], r["groups"]): r for r in token_groups(df).collect()}
    assert {(i, spelled(g)) for (i, _), g in zip(rows, groups, strict=True)} == set(made)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    expect(op13_token_links(spark, str(tmp_path)).collect(), rows, groups)


def in_small_pieces(sizes, bound):
    from inkprint.llm.common import in_pieces

    return in_pieces(sizes, bound)


def expect(found, rows, groups):
    counts = Counter(p for g in groups for p in set(links(g)))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    expected = []
    for (doc_id, _), g in zip(rows, groups, strict=True):
        own = links(g)
        sha = hashlib.sha256(spelled(g).encode()).hexdigest() if g else ""
        best = sum(counts[p] == most[p[0]] for p in own)
        expected.append((
            doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), best,
            sum(counts[p] for p in own), sha,
        ))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted(expected, key=str)


def test_query(spark, sf_dir, whole):
    documents = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expect(op13_token_links(spark, sf_dir).collect(), documents, [brute(whole, t) for _, t in documents])


def test_overlaps(whole):
    texts = [t for t in ODD if t] + [letters(i) for i in range(100)]
    good = [t for t in texts if brute(whole, t)]
    assert len(good) > 60
    for text, found in zip(good, overlap_links(good, two_tokenizers(TOKENIZERS)), strict=True):
        left, right = whole(text)
        expected, at = [], 0
        for i, (_, x) in enumerate(left):
            low = 0
            for j, (_, y) in enumerate(right):
                shared = min(at + len(x), low + len(y)) - max(at, low)
                if shared > 0:
                    expected.append((i, j, shared))
                low += len(y)
            at += len(x)
        assert found == expected


def test_long_texts(corpus, whole, prose):
    rows = [(1, "=-" * 150_000), (2, prose(30_000, 1)), (3, "日本" * 40_000)]
    found = {r["doc_id"]: r for r in token_groups(corpus(rows)).collect()}
    for i, text in rows:
        left, right = whole(text)
        assert (found[i]["n_a"], found[i]["n_b"]) == (len(left), len(right))


def test_empty_table(corpus, spark, tmp_path):
    assert token_groups(corpus([])).collect() == []
    corpus([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert op13_token_links(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("bound", [1, 7, 10_000])
def test_products(bound):
    draw = np.random.default_rng(bound)
    for _ in range(20):
        n, m, k = draw.integers(1, 12, 3)
        a, b = (draw.integers(0, 3, s) * (draw.random(s) < 0.4) for s in ((n, m), (m, k)))
        sparse = [Csr.of(*np.nonzero(x), x[np.nonzero(x)], *x.shape) for x in (a, b)]
        c = product(*sparse, bound=bound)
        dense = np.zeros((n, k), int)
        dense[c.rows(), c.indices] = c.data
        assert (dense == a @ b).all()
        t = sparse[0].transposed()
        assert (np.diff(t.starts) == np.count_nonzero(a, axis=0)).all()


def test_columns_of_overlaps_are_stretches(monkeypatch):
    """Overlaps need a column for each stretch between ends of tokens, not for each byte."""
    both, widths, before = two_tokenizers(TOKENIZERS), [], token_links.product

    def counted(a, b, **more):
        widths.append((a.width, b.height))
        return before(a, b, **more)

    links = token_links.PieceLinks(["=" * 300, "the same words"], both)
    monkeypatch.setattr(token_links, "product", counted)
    shared = links.overlaps()
    ends = {*links.a.end.tolist(), *links.b.end.tolist()}
    assert widths == [(len(ends), len(ends))] and len(ends) < 100
    assert shared.data.sum() == 301 + 15
