"""Quality by attention over passages, learnt from labels of whole documents.

Each text is cut into passages of ``PASSAGE`` bytes, and a passage is encoded by how often its
classes of bytes follow each other. A hidden layer reads the encoding; a gated attention layer
gives each passage of a document a weight, the weighted mean of the hidden layers stands for the
document, and a logistic unit scores it. All layers are learnt together, from the labels of
documents only (multiple-instance learning).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import bounded_sample, in_pieces, texts_of
from inkprint.session import materialize

PASSAGE = 1024
HIDDEN = 24
GATES = 12
#: At most about so many labelled documents of each class are learnt from.
SAMPLE = 4000
#: Of a longer document in that sample, so many passages, evenly spread, are learnt from.
LEARNT_PASSAGES = 64
EPOCHS = 30
BATCH = 128
ACCEPT = 0.3

_KINDS = 16


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, 14, np.uint8)  # control characters
    groups = [
        b" ", b"\n", b"\t\r\v\f", b"0123456789", b"#*$%&|<>", b"!?", b".", b",;:",
        b"\"'`()[]{}", b"+-/=@\\^_~", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"aeiou",
        b"bcdfghjklmnpqrstvwxyz",
    ]
    for kind, group in enumerate(groups):
        kinds[list(group)] = kind
    kinds[128:] = 15
    return kinds


_KIND = _byte_kinds()
WIDTH = _KINDS * _KINDS + 1


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages, and the number of passages of each text.

    An entry is the square root of the share of a pair of byte classes; the last one is the
    logarithm of the length. An empty text has one passage without pairs.
    """
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    count = np.maximum(1, -(-sizes // PASSAGE))
    kinds = _KIND[np.frombuffer(b"".join(data), np.uint8)].astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(kinds)) - np.repeat(begin, sizes)
    passage = at // PASSAGE + np.repeat(np.cumsum(count) - count, sizes)
    total = int(count.sum())
    same = passage[1:] == passage[:-1]
    pair = passage[:-1] * (_KINDS * _KINDS) + kinds[:-1] * _KINDS + kinds[1:]
    counts = np.bincount(pair[same], minlength=total * _KINDS * _KINDS).reshape(total, -1)
    length = np.bincount(passage, minlength=total)
    out = np.empty((total, WIDTH), np.float32)
    out[:, :-1] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    out[:, -1] = np.log1p(length) / 8
    return out, count


class AttentionModel:
    """Passage layer, gated attention and the score of the weighted mean."""

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = lambda rows, cols: draw.normal(0, rows**-0.5, (rows, cols)).astype(np.float32)
        self.w, self.b = scale(WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.v, self.u = scale(HIDDEN, GATES), scale(HIDDEN, GATES)
        self.a = scale(GATES, 1)[:, 0]
        self.c, self.d = scale(HIDDEN, 1)[:, 0], np.zeros(1, np.float32)

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        begin = np.cumsum(count) - count
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), count))
        alpha = e / np.repeat(np.add.reduceat(e, begin), count)
        z = np.add.reduceat(alpha[:, None] * h, begin, axis=0)
        y = 1 / (1 + np.exp(-(z @ self.c + self.d[0])))
        return {"begin": begin, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "y": y}

    def gradients(self, x, count, label, weight) -> dict[str, np.ndarray]:
        f = self.forward(x, count)
        dy = (weight * (f["y"] - label) / len(label)).astype(np.float32)
        dz = dy[:, None] * self.c
        each = np.repeat(dz, count, axis=0)
        dalpha = (each * f["h"]).sum(1)
        mean = np.add.reduceat(f["alpha"] * dalpha, f["begin"])
        de = f["alpha"] * (dalpha - np.repeat(mean, count))
        gated = de[:, None] * self.a
        dt = gated * f["g"] * (1 - f["t"] ** 2)
        dg = gated * f["t"] * f["g"] * (1 - f["g"])
        dh = f["alpha"][:, None] * each + dt @ self.v.T + dg @ self.u.T
        dx = dh * (1 - f["h"] ** 2)
        return {
            "w": x.T @ dx, "b": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
            "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, seed: int = 7) -> None:
        """Adam over shuffled batches, with a rate that falls to zero."""
        draw = np.random.default_rng(seed)
        first = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        second = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        steps = EPOCHS * -(-len(bags) // BATCH)
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                count = np.array([len(bags[k]) for k in some])
                x = np.concatenate([bags[k] for k in some]).astype(np.float32)
                slope = self.gradients(x, count, label[some], weight[some])
                rate = 0.01 * (1 - step / steps)
                step += 1
                for n in self.NAMES:
                    first[n] = 0.9 * first[n] + 0.1 * slope[n]
                    second[n] = 0.999 * second[n] + 0.001 * slope[n] ** 2
                    up = first[n] / (1 - 0.9**step)
                    down = np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8
                    setattr(self, n, (getattr(self, n) - rate * up / down).astype(np.float32))

    def state(self) -> bytes:
        return b"".join(getattr(self, n).astype(np.float32).tobytes() for n in self.NAMES)

    @classmethod
    def of(cls, state: bytes) -> AttentionModel:
        model, at = cls(), 0
        numbers = np.frombuffer(state, np.float32)
        for n in cls.NAMES:
            old = getattr(model, n)
            setattr(model, n, numbers[at : at + old.size].reshape(old.shape))
            at += old.size
        return model

    def scores(self, texts: list[str]) -> np.ndarray:
        x, count = encode(texts)
        return self.forward(x, count)["y"].astype(np.float64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch["text"])
        for a, b in in_pieces(map(len, texts)):
            x, count = encode(texts[a:b])
            begin = np.cumsum(count) - count
            bags = []
            for i, n in zip(begin.tolist(), count.tolist(), strict=True):
                if n > LEARNT_PASSAGES:
                    pick = np.linspace(0, n - 1, LEARNT_PASSAGES).astype(int)
                else:
                    pick = np.arange(n)
                bags.append(x[i + pick].astype(np.float16).tobytes())
            yield pa.record_batch(
                [batch["id"].slice(a, b - a), batch["label"].slice(a, b - a), pa.array(bags, pa.binary())],
                ["id", "label", "bag"],
            )


def _fitted(share: dict[int, float]):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        raw = table["bag"].to_pylist()
        bags = [np.frombuffer(raw[i], np.float16).reshape(-1, WIDTH) for i in order]
        label = table["label"].to_numpy()[order].astype(np.float32)
        weight = np.array([share[int(x)] for x in label], np.float32)
        model = AttentionModel()
        model.fit(bags, label, weight / weight.mean())
        return pa.table({"state": pa.array([model.state()], pa.binary())})

    return run


def fit_quality(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
) -> bytes | None:
    """Learn from labelled documents; returns the weights of the model, a few kilobytes.

    ``labels`` has the id and a label of 0 or 1. Of each label about ``sample`` documents at
    most are learnt from, drawn by a hash of the id, and weighted so that labels count as often
    as they occur. Null labels and ids are left out. Without a sample of both labels there is
    no model.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)")
    drawn = materialize(bounded_sample(known, "id", "label", sample))
    whole = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("id").alias("n")).collect()}
    some = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count("id").alias("n")).collect()}
    if len(some) < 2:
        return None
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # The sample is bounded by its parameter: numbers of about 2 * sample documents.
    bags = texts.join(F.broadcast(drawn), "id").select("id", "label", "text").mapInArrow(
        _bags, "id long, label int, bag binary"
    )
    share = {k: whole[k] / some[k] for k in some}
    fitted = bags.groupBy(F.lit(0).alias("all")).applyInArrow(_without_key(_fitted(share)), "state binary")
    row = fitted.first()
    return None if row is None else bytes(row["state"])


def _without_key(run):
    def of_table(table: pa.Table) -> pa.Table:
        return run(table.select(["id", "label", "bag"]))

    return of_table


def quality_score(state: bytes | None, text: Column) -> Column:
    """A score from 0 to 1 for each text, null and empty ones included; 0.5 without a model."""
    if state is None:
        return F.lit(0.5)
    return F.arrow_udf(_scorer(state), "double", F.ArrowUDFType.SCALAR_ITER)(text)


def _scorer(state: bytes):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = AttentionModel.of(state)
        for column in columns:
            texts = texts_of(column)
            parts = [model.scores(texts[a:b]) for a, b in in_pieces(map(len, texts))]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return run
