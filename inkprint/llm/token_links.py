"""Links between the tokens of two tokenizers, by products of sparse incidence matrices.

Tokens of A and of B cover the same bytes. With a row for each token and a column for each byte,
A times B transposed counts the bytes that a token of A and one of B share: the overlap links. Bytes between two
neighbouring ends of any tokens have equal columns, and are one column with their number.
Bytes at which tokens of both end cut text into groups; with a row for each pair of piece and token
id and a column for each group, A times B transposed counts the shared-group links of each pair of
ids. Matrices are built and multiplied by rows (``sparse``).

Neither tokenizer merges over a single space between two characters that are not white space: A
cuts there before it merges, and no entry of B has a space behind another character. So a text is
cut there into pieces, each with its space in front, and a chunk of texts tokenizes and multiplies
each distinct piece once. The links of its documents are another product, of documents by pieces
with pieces by pairs of ids. A piece ends a token of both, so groups never reach over two pieces.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import in_pieces
from inkprint.llm.sparse import Csr, product
from inkprint.session import materialize

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: An id of A times this plus one of B is the number of a pair.
PAIR_BASE = 1 << 20
ENCODED_CHARS = 1 << 18

_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves; the others follow from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TwoTokenizers:
    """Ids of texts by both, and the bytes of each id."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self._a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self._a.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self._b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        size = self._b.get_piece_size()
        pieces = [self._b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.names = pa.array([str(i) for i in range(max(len(self.bytes_a), size))])
        # Whether a piece may be cut out before a space.
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encoded(self, texts: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A for a space and the text, and of B, which adds that space."""
        ids_a = self._a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        return [e.ids for e in ids_a], self._b.encode(list(texts), num_threads=1)

    def spelled_a(self, ids: Sequence[int]) -> bytes:
        return b"".join([self.bytes_a[i] for i in ids])

    def spelled_b(self, ids: Sequence[int]) -> bytes:
        return b"".join([self.bytes_b[i] for i in ids])

    def pieces(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the tokens of a piece spell it, and the ids of all that do, one after the other.

        Pieces that meet at a space between other characters are encoded together by A, as they were
        in a text, and one by one only where tokens do not spell them.
        """
        good = np.ones(len(pieces), bool)
        alone = np.fromiter(map(_alone, pieces), bool, len(pieces))
        flat_a: list[int] = []
        flat_b: list[int] = []
        for first, last in in_pieces(map(len, pieces), ENCODED_CHARS):
            some = pieces[first:last]
            if self.parts and not alone[first:last].any():
                text = f" {' '.join(some)}"
                ids_a = self._a.encode_batch_fast([text], add_special_tokens=False)[0].ids
                # B is faster on short texts, and puts the space before each of them.
                ids_b = list(itertools.chain.from_iterable(self._b.encode(list(some), num_threads=1)))
                data = text.encode()
                if self.spelled_a(ids_a) == data and self.spelled_b(ids_b) == data:
                    flat_a += ids_a
                    flat_b += ids_b
                    continue
            for i, (p, ids_a, ids_b) in enumerate(zip(some, *self.encoded(some), strict=True), first):
                data = f" {p}".encode()
                good[i] = self.spelled_a(ids_a) == data and self.spelled_b(ids_b) == data
                if good[i]:
                    flat_a += ids_a
                    flat_b += ids_b
        return good, np.array(flat_a, np.int64), np.array(flat_b, np.int64)


@functools.lru_cache(maxsize=2)
def two_tokenizers(folder: str) -> TwoTokenizers:
    """Loaded once for each process."""
    return TwoTokenizers(folder)


@dataclass
class Tokens:
    """Tokens of pieces one after the other: the piece, id, length and end of each, in bytes."""

    piece: np.ndarray
    ids: np.ndarray
    length: np.ndarray
    end: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, sizes: np.ndarray, piece_ends: np.ndarray) -> Tokens:
        length = sizes[ids]
        end = np.cumsum(length)
        return Tokens(np.searchsorted(piece_ends, end), ids, length, end)

    def by_stretch(self, stretch_ends: np.ndarray, weights: np.ndarray) -> Csr:
        """A row for each token, a column for each stretch of bytes between ends of any token, with its weight."""
        starts = np.concatenate([[0], np.searchsorted(stretch_ends, self.end) + 1])
        return Csr(starts, np.arange(len(stretch_ends)), weights, len(stretch_ends))


class PieceLinks:
    """Tokens, groups and links of distinct pieces of text."""

    def __init__(self, pieces: Sequence[str], both: TwoTokenizers):
        self.good, ids_a, ids_b = both.pieces(pieces)
        count = len(pieces)
        # A piece without tokens ends where the one before does, and no token is its own.
        piece_ends = np.cumsum([len(p.encode()) + 1 if g else 0 for p, g in zip(pieces, self.good.tolist(), strict=True)])
        self.a = Tokens.of(ids_a, both.sizes_a, piece_ends)
        self.b = Tokens.of(ids_b, both.sizes_b, piece_ends)
        in_b = np.searchsorted(self.b.end, self.a.end)
        self.common = self.a.end[self.b.end[in_b] == self.a.end]
        self.group_a = np.searchsorted(self.common, self.a.end)
        self.group_b = np.searchsorted(self.common, self.b.end)
        self.n_a = np.bincount(self.a.piece, minlength=count)
        self.n_b = np.bincount(self.b.piece, minlength=count)
        # The group's piece is that of its tokens.
        of_group = np.zeros(len(self.common), np.int64)
        of_group[self.group_a] = self.a.piece
        self.group_piece = of_group
        self.n_groups = np.bincount(of_group, minlength=count)
        self.pairs = self._pairs(count)
        self.n_links = np.zeros(count, np.int64)
        np.add.at(self.n_links, self.pairs.rows(), self.pairs.data)

    def overlaps(self) -> Csr:
        """Bytes that a token of A (row) shares with one of B (column)."""
        ends = np.sort(np.concatenate([self.a.end, self.b.end]), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
        lengths = np.diff(ends, prepend=0)
        return product(
            self.a.by_stretch(ends, lengths), self.b.by_stretch(ends, np.ones_like(lengths)).transposed()
        )

    def _pairs(self, count: int) -> Csr:
        """How many links each piece (row) has of each pair of ids (column, a number of ``self.codes``)."""
        groups = len(self.common)
        rows_a, at_a = np.unique(self.a.piece * PAIR_BASE + self.a.ids, return_inverse=True)
        rows_b, at_b = np.unique(self.b.ids, return_inverse=True)
        ones_a, ones_b = np.ones(len(at_a), np.int64), np.ones(len(at_b), np.int64)
        in_a = Csr.of(at_a, self.group_a, ones_a, len(rows_a), groups)
        in_b = Csr.of(self.group_b, at_b, ones_b, groups, len(rows_b))
        # A group lies in one piece, so a row of piece and id of A meets ids of B in that piece only.
        linked = product(in_a, in_b)
        row = linked.rows()
        codes = (rows_a[row] % PAIR_BASE) * PAIR_BASE + rows_b[linked.indices]
        self.codes, which = np.unique(codes, return_inverse=True)
        return Csr.of(rows_a[row] // PAIR_BASE, which, linked.data, count, max(1, len(self.codes)))

    def spelled(self, names: pa.Array) -> pa.Array:
        """The groups of each piece: ids of A, a bar, ids of B; semicolons in between."""
        groups = np.arange(len(self.common))
        sides = []
        for group, tokens in ((self.group_a, self.a), (self.group_b, self.b)):
            ends = np.append(np.searchsorted(group, groups, "left"), len(group))
            sides.append(_joined_lists(ends, names.take(pa.array(tokens.ids)), ","))
        spelled = pa.compute.binary_join_element_wise(*sides, "|")
        return _joined_lists(np.concatenate([[0], np.cumsum(self.n_groups)]), spelled, ";")


def _joined_lists(ends: np.ndarray, texts: pa.Array, between: str) -> pa.Array:
    """The texts from each end up to the next, with ``between`` in between."""
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), between)


def _alone(piece: str) -> bool:
    """Whether a piece has a white space at an end, or is not what tokens of B spell."""
    return piece[0].isspace() or piece[-1].isspace() or "▁" in piece


def _lists(matrix: Csr, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(matrix.starts, pa.int32()), pa.array(values, kind))


def _chunk(ids: pa.Array, texts: list[str | None], both: TwoTokenizers, chunk: int) -> pa.RecordBatch:
    parts = [[] if not text else _CUT.split(text) if both.parts else [text] for text in texts]
    index = pa.array([p for x in parts for p in x], pa.string()).dictionary_encode()
    # Pieces that have to be encoded one by one come last.
    distinct = index.dictionary.to_pylist()
    alone = np.fromiter(map(_alone, distinct), bool, len(distinct))
    order = np.argsort(alone, kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(len(distinct))
    links = PieceLinks([distinct[i] for i in order.tolist()], both)
    count = np.array([len(x) for x in parts], np.int64)
    document = np.repeat(np.arange(len(parts)), count)
    piece = place[index.indices.to_numpy()]
    bad = np.zeros(len(parts), bool)
    bad[document[~links.good[piece]]] = True
    usable = ~bad[document]
    document, piece = document[usable], piece[usable]
    pieces = Csr.of(document, piece, np.ones(len(piece), np.int64), len(parts), max(1, len(distinct)))
    pairs = product(pieces, links.pairs) if len(distinct) else Csr(np.zeros(len(parts) + 1, np.int64), piece, piece, 1)

    def total(numbers: np.ndarray) -> pa.Array:
        out = np.zeros(len(parts), np.int64)
        np.add.at(out, document, numbers[piece])
        return pa.array(out)

    overlapping = np.zeros(max(1, len(distinct)), np.int64)
    if len(distinct):
        shared = links.overlaps()
        np.add.at(overlapping, links.a.piece, np.diff(shared.starts))
    # Pieces of documents without tokens are left out, and their groups are empty.
    own = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=len(parts)))])
    groups = _joined_lists(own, links.spelled(both.names).take(pa.array(piece)), ";")
    # The first document of a chunk carries what holds for the chunk.
    used, place = np.unique(pairs.indices, return_inverse=True)
    first = np.zeros(len(parts) + 1, np.int64)
    first[1:] = len(used)
    once = Csr(first, used, used, 1)
    return pa.record_batch(
        [
            ids,
            total(links.n_a), total(links.n_b), total(links.n_groups), total(links.n_links), total(overlapping),
            groups,
            pa.array(np.full(len(parts), chunk, np.int64)),
            _lists(pairs, place, pa.int32()),
            _lists(pairs, pairs.data, pa.int64()),
            _lists(once, links.codes[used], pa.int64()),
            _lists(once, np.bincount(place, minlength=len(used)), pa.int64()),
        ],
        ["id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups", "chunk",
         "pairs", "pair_links", "chunk_pairs", "chunk_documents"],
    )


def _linked(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(folder)
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in in_pieces(len(t or "") for t in texts):
                yield _chunk(batch["id"].slice(a, b - a), texts[a:b], both, chunk)
                chunk += 1

    return run


def token_groups(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizers: str = TOKENIZERS
) -> DataFrame:
    """Both tokenizations of each text, its groups and the pairs of ids that it links.

    Returns the id; the numbers of tokens ``n_a`` and ``n_b``, ``n_groups``, ``n_links`` (pairs of
    occurrences of a token of A and one of B in one group) and ``n_overlaps`` (those that share a
    byte); ``groups``, spelled ``a1,a2|b1;a3|b2,b3``; and what ``link_counts`` reads: ``chunk``, numbers ``pairs``
    into the chunk's pairs with ``pair_links`` of each, and on the first document of a chunk
    ``chunk_pairs`` (id of A times ``PAIR_BASE``, plus id of B) with the ``chunk_documents`` of each. A
    chunk is some two million characters of consecutive documents, or one longer document.

    A text that is null, empty, or not what the tokens of A or of B spell behind a space has no
    tokens. Strings of special tokens are plain text. Every row is a document of its own. Other
    columns are not read, and an empty table gives no row. Write the result before ``link_counts``:
    the numbers of chunks hold within one run.
    """
    kind = documents.select(F.col(id_column)).schema[0].dataType.simpleString()
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(
        _linked(tokenizers),
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups string, "
        "chunk long, pairs array<int>, pair_links array<long>, chunk_pairs array<long>, chunk_documents array<long>",
    )
    return found.withColumnRenamed("id", id_column)


def _summed(names: Sequence[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = np.zeros(right.num_rows, np.int64)
        counts[right["place"].to_numpy()] = right["counted"].to_numpy()
        ends = np.cumsum(pa.compute.list_value_length(left["pairs"]).to_numpy())
        pairs = pa.compute.list_flatten(left["pairs"]).to_numpy()
        links = pa.compute.list_flatten(left["pair_links"]).to_numpy()
        found = counts[pairs]
        upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        table = left.select(names)
        table = table.append_column("n_best", pa.array(upto(links * (found < 0)).astype(np.int64)))
        return table.append_column("count_sum", pa.array(upto(links * np.abs(found)).astype(np.int64)))

    return run


def pair_counts(linked: DataFrame) -> DataFrame:
    """(code, n_documents, best) of each linked pair of ids: is it the commonest of its id of A?"""
    counts = materialize(
        linked.filter(F.size("chunk_pairs") > 0)
        .select(F.explode(F.arrays_zip("chunk_pairs", "chunk_documents")).alias("p"))
        .groupBy(F.col("p.chunk_pairs").alias("code"))
        .agg(F.sum("p.chunk_documents").alias("n_documents"))
    )
    of_a = F.expr(f"code div {PAIR_BASE}")
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("n_documents").alias("most"))
    # At most as many rows as the vocabulary has entries.
    joined = counts.join(F.broadcast(highest), of_a == F.col("a"))
    return joined.select("code", "n_documents", (F.col("n_documents") == F.col("most")).alias("best"))


def link_counts(linked: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of a written ``token_groups``, with ``n_best`` and ``count_sum``.

    The count of a pair of ids is in how many documents of the whole table they are linked.
    ``n_best`` is the number of links whose count is the highest of their id of A, ties included;
    ``count_sum`` adds up the counts of all links. Only the distinct pairs of a chunk are joined with
    the counts and come back to the chunk, not those of each document.
    """
    counted = pair_counts(linked).select(
        "code", F.when(F.col("best"), -F.col("n_documents")).otherwise(F.col("n_documents")).alias("counted")
    )
    asked = linked.filter(F.size("chunk_pairs") > 0).select(
        F.col("chunk").alias("its_chunk"), F.posexplode("chunk_pairs").alias("place", "code")
    )
    answered = asked.join(counted, "code").select("its_chunk", "place", "counted")
    left = linked.select(*keep, "chunk", "pairs", "pair_links")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in linked.select(*keep).schema)
    return (
        left.groupBy("chunk")
        .cogroup(answered.groupBy("its_chunk"))
        .applyInArrow(_summed(list(keep)), f"{fields}, n_best long, count_sum long")
    )


def overlap_links(texts: Sequence[str], both: TwoTokenizers) -> list[list[tuple[int, int, int]]]:
    """For each text (number of the token of A, of B, bytes they share), by whole texts."""
    links = PieceLinks([t for t in texts], both)
    shared = links.overlaps()
    first_a = np.concatenate([[0], np.cumsum(links.n_a)])
    first_b = np.concatenate([[0], np.cumsum(links.n_b)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b, n in zip(shared.rows().tolist(), shared.indices.tolist(), shared.data.tolist(), strict=True):
        piece = int(links.a.piece[a])
        out[piece].append((a - int(first_a[piece]), b - int(first_b[piece]), n))
    return out


__all__ = ["TOKENIZERS", "link_counts", "overlap_links", "pair_counts", "token_groups", "two_tokenizers"]
