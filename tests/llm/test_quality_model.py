import numpy as np
from pyspark.sql import functions as F

from inkprint.llm.quality_model import PASSAGE, AttentionModel, encode, fit_quality, quality_score


def test_encoding():
    x, count = encode(["", "a" * (PASSAGE + 1), "ab!! 12"])
    assert count.tolist() == [1, 2, 1] and x.shape[0] == 4
    assert np.allclose((x[:, :-1] ** 2).sum(1), [0, 1, 0, 1])


def test_gradients():
    draw = np.random.default_rng(0)
    model = AttentionModel()
    for n in model.NAMES:
        setattr(model, n, getattr(model, n).astype(np.float64))
    x, count = draw.random((7, model.w.shape[0])), np.array([3, 1, 3])
    label, weight = np.array([1.0, 0.0, 0.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        y = model.forward(x, count)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).mean()

    slopes = model.gradients(x, count, label, weight)
    for n in model.NAMES:
        flat = getattr(model, n).reshape(-1)
        for i in draw.integers(0, flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - slopes[n].reshape(-1)[i]) < 1e-5, n


def test_learns_passages_and_handles_cases(spark, corpus, prose):
    rows, labels = [], []
    for i in range(400):
        text = prose(300, i)
        if i % 4 == 0:  # one bad passage among good ones
            text = text[:1500] + " ### $$$ !!!" * 90 + text[1500:]
        rows.append((i, text))
        labels.append((i, int(i % 4 != 0)))
    rows += [(900, None), (901, ""), (902, prose(40_000, 1)), (None, "x"), (3, rows[3][1])]
    df = corpus(rows, "label bag _score")
    known = spark.createDataFrame([r for r in labels if r[0] % 5] + [(1, None), (None, 1)], "doc_id long, quality int")
    state = fit_quality(df, known, sample=150)
    found = df.select("doc_id", quality_score(state, F.col("text")).alias("s")).collect()
    score = {r["doc_id"]: r["s"] for r in found}
    right = [(score[i] >= 0.5) == bool(q) for i, q in labels if i % 5 == 0]
    assert np.mean(right) > 0.95 and len(found) == len(rows)
    assert all(0 <= s <= 1 for s in score.values()) and score[900] == score[901]
    assert fit_quality(df, known, sample=150) == state  # the same again


def test_no_model(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_quality(corpus([(1, "a")]), none) is None
    assert corpus([(1, "a")]).select(quality_score(None, F.col("text")).alias("s")).first()["s"] == 0.5
    assert corpus([]).select(quality_score(AttentionModel().state(), F.col("text"))).collect() == []
