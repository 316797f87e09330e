"""Scaling, joining, splitting, scoring, files."""

import json
import math
import os
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkprint.functions import vectors as vx
from inkprint.functions.patterns import LABELS_SIX_CLASS, LABELS_TWO_CLASS
from inkprint.operators import chunks, classify, combine, evaluate, scaling, split
from inkprint.operators.distribute import fits_broadcast, lookup, with_row_number
from inkprint.plans.prediction import check_submission, score_submission, train_and_predict
from inkprint.sources import jsonl


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------------------ scaling


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame(
        [(1, 1.0, 5, None, "x"), (2, 2.0, 5, 4.0, "y"), (3, 6.0, 5, math.nan, None)],
        "id long, a double, c int, n double, s string",
    )


def test_zscore(numbers):
    rows = tuples(scaling.zscore(numbers, ["id"]))
    std = math.sqrt(((1 - 3) ** 2 + 1 + 9) / 2)
    assert [r[1] for r in rows] == pytest.approx([-2 / std, -1 / std, 3 / std])
    assert [r[2] for r in rows] == [0, 0, 0] and [r[3] for r in rows] == [0, 0, 0]


def test_single_row_scales_to_zero(numbers):
    assert tuples(scaling.zscore(numbers.filter("id = 1"), ["id"])) == [(1, 0.0, 0.0, 0.0, "x")]


def test_statistics_of_another_corpus(numbers):
    stats = scaling.fit_zscore(numbers, ["a"])
    scaled = scaling.zscore(numbers.filter("id = 3"), ["id"], stats).first()
    assert scaled.a == pytest.approx(3 / math.sqrt(7))


def test_population_and_minmax(numbers):
    std = math.sqrt(14 / 3)
    population = tuples(scaling.scale_features(numbers, ["id"]))
    assert [r[1] for r in population] == pytest.approx([-2 / std, -1 / std, 3 / std])
    rows = tuples(scaling.scale_features(numbers, ["id"], "min-max"))
    assert [r[1] for r in rows] == pytest.approx([0, 0.2, 1]) and [r[2] for r in rows] == [0, 0, 0]
    assert [r[4] for r in rows] == ["x", "y", None]
    with pytest.raises(ValueError):
        scaling.scale_features(numbers, ["id"], "other")


def test_maxabs(spark):
    rows = spark.createDataFrame([(1, -4.0), (2, 2.0), (3, None)], "id long, p double")
    assert tuples(scaling.scale_by_max(rows, "p")) == [(1, -1.0), (2, 0.5), (3, None)]
    zero = spark.createDataFrame([(1, 0.0)], "id long, p double")
    assert tuples(scaling.scale_by_max(zero, "p")) == [(1, None)]


# ----------------------------------------------------------------- lookups, numbers


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_is_the_same_beyond_the_broadcast_bound(spark, how):
    # One key holds a third of the rows.
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("long").alias("k")
    )
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup(rows, table, ["k"], spread_by=["id"], how=how)
    salted = lookup(rows, table, ["k"], spread_by=["id"], how=how, max_rows=1)
    assert "_salt" not in salted.columns
    assert tuples(small.select(sorted(small.columns))) == tuples(salted.select(sorted(salted.columns)))


def test_broadcast_bound(spark):
    table = spark.createDataFrame([("a" * 100,), ("b",)], "w string")
    assert fits_broadcast(table) and not fits_broadcast(table, max_rows=1)
    assert not fits_broadcast(table, max_bytes=100)


def test_row_numbers(spark):
    # Copies of one row make up a third.
    ids = [7] * 100 + [random.Random(4).randrange(1000) for _ in range(200)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    numbered = sorted((r.n, r.id) for r in with_row_number(rows, ["id"], "n").collect())
    assert [n for n, _ in numbered] == list(range(300))
    assert [i for _, i in numbered] == sorted(ids)


# -------------------------------------------------------------------------- splits


def test_equal_parts(spark):
    rows = spark.range(0, 1000, 3)
    parts = Counter(r.part for r in split.equal_parts(rows, 100).collect())
    assert parts == {0: 100, 1: 100, 2: 100, 3: 34}


@pytest.mark.parametrize("seed", [0, 1])
def test_stratified_split(spark, seed):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    marked = split.stratified_split(rows, seed=seed)
    counts = {(r.label, r.is_valid): r["count"] for r in marked.groupBy("label", "is_valid").count().collect()}
    for label, n in (("a", 667), ("b", 1333)):
        assert counts[label, True] == math.ceil(n * 0.2) and counts[label, False] == n - math.ceil(n * 0.2)
    # The rows are the first in draw order.
    order = marked.filter("label = 'a'").withColumn("d", split.draw_key(seed=seed)).orderBy("d").collect()
    assert [r.is_valid for r in order] == [True] * 134 + [False] * 533
    train, valid = split.train_valid(rows, seed=seed)
    assert train.count() + valid.count() == 2000 and train.join(valid, "id").count() == 0


def test_split_draws_differ_by_seed(spark):
    rows = spark.range(500).select("id", F.lit(1).alias("label"))
    a, b = (tuples(split.stratified_split(rows, seed=s).filter("is_valid").select("id")) for s in (0, 1))
    assert len(a) == len(b) == 100 and a != b


def test_split_with_copies_and_missing_labels(spark):
    rows = spark.createDataFrame([(1, "a")] * 50 + [(i, "a") for i in range(2, 52)] + [(99, None)],
                                 "id long, label string")
    marked = split.stratified_split(rows)
    sides = {r.id: set() for r in marked.collect()}
    for r in marked.collect():
        sides[r.id].add(r.is_valid)
    assert all(len(s) == 1 for s in sides.values()) and sides[99] == {False}


def test_head(spark):
    assert [r.id for r in split.head(spark.range(50).repartition(4), 3).collect()] == [0, 1, 2]


# ------------------------------------------------------------------------- chunks


def test_split_over_length(spark):
    rows = spark.createDataFrame(
        [(1, "x" * 10_000, 0), (2, "y" * 10_001, 1), (3, None, 1), (4, "", 0)],
        "id long, text string, label int",
    )
    pieces = chunks.split_over_length(rows, ["id"]).collect()
    found = sorted((r.id, r.chunk_no, None if r.text is None else len(r.text), r.label) for r in pieces)
    assert found == [(1, 0, 10_000, 0), (2, 0, 10_000, None), (2, 1, 1, None), (3, 0, None, 1), (4, 0, 0, 0)]
    # The limit only selects: pieces keep their width.
    lower = chunks.split_over_length(rows, ["id"], max_size=5000)
    assert sorted(len(r.text) for r in lower.filter("id < 3").collect()) == [1, 10_000, 10_000]


def test_mean_by_id(spark):
    rows = spark.createDataFrame(
        [(1, 2.0), (1, 4.0), (1, math.nan), (2, None)], "id long, perplexity double"
    )
    assert tuples(chunks.mean_by_id(rows, ["id"])) == [(1, 3.0), (2, None)]


# ------------------------------------------------------------------------- combine


def test_last_frame_wins(spark):
    first = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (None, 9.0, 9.0)], "id long, a double, b double")
    second = spark.createDataFrame([(1, None, "x"), (3, 5.0, "y")], "id long, b double, s string")
    rows = combine.combine_by_id([first, second]).select("id", "a", "b", "s")
    assert tuples(rows) == [(1, 1.0, None, "x"), (2, 2.0, 2.0, None), (3, None, 5.0, "y")]


def test_long_combination(spark):
    schema = "id long, feature string, value double"
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], schema)
    b = spark.createDataFrame([(1, "y", None), (2, "y", 3.0)], schema)
    assert tuples(combine.combine_long([a, b])) == [(1, "x", 1.0), (1, "y", None), (2, "y", 3.0)]


def test_join_drops_and_multiplies(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "id long, f double")
    b = spark.createDataFrame([(1, 0.5), (3, 0.1)], "id long, perplexity double")
    assert tuples(combine.join_by_id(a, b, ["id"])) == [(1, 1.0, 0.5), (1, 2.0, 0.5)]


def test_with_ids(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None)], "s string, id double")
    assert tuples(combine.with_ids(rows)) == [(1, "a")]


# ------------------------------------------------------------------------- scoring


def plain_scores(pairs):
    labels = sorted({x for p in pairs for x in p})
    f1 = []
    for label in labels:
        tp = sum(g == p == label for g, p in pairs)
        wrong = sum((g == label) != (p == label) for g, p in pairs)
        f1.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0)
    accuracy = sum(g == p for g, p in pairs) / len(pairs)
    return [sum(f1) / len(f1), accuracy, accuracy]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label int")


def test_scores(spark):
    draw = random.Random(2)
    gold = [(i, draw.randrange(4)) for i in range(200)]
    pred = [(i, draw.randrange(5)) for i in range(50, 250)]
    found = evaluate.evaluate(frame(spark, pred), frame(spark, gold)).first()
    known = dict(gold)
    assert list(found) == pytest.approx(plain_scores([(known[i], p) for i, p in pred if i in known]))


def test_repeated_ids_multiply(spark):
    pred, gold = frame(spark, [(1, 0), (1, 1), (2, 1)]), frame(spark, [(1, 0), (1, 0), (2, 1), (3, 1)])
    assert evaluate.match_gold(pred, gold).count() == 5
    pairs = {(r.label_gold, r.label_pred): r.n for r in evaluate.label_pairs(pred, gold).collect()}
    assert pairs == {(0, 0): 2, (0, 1): 2, (1, 1): 1}
    assert tuples(evaluate.repeated_ids(pred)) == [(1, 2)]


def test_class_only_in_predictions(spark):
    pred, gold = frame(spark, [(1, 0), (2, 2), (3, 1)]), frame(spark, [(1, 0), (2, 1), (3, 1)])
    scores = evaluate.evaluate(pred, gold).first()
    assert scores.macro_f1 == pytest.approx((1 + 2 / 3 + 0) / 3)
    matrix = tuples(evaluate.confusion_matrix(pred, gold))
    assert matrix == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)]


def test_report(spark):
    pred, gold = frame(spark, [(1, 0), (2, 0), (3, 1)]), frame(spark, [(1, 0), (2, 1), (3, 1)])
    rows = {r.row: tuple(r)[1:] for r in evaluate.classification_report(pred, gold).collect()}
    assert rows["0"] == pytest.approx((0.5, 1.0, 2 / 3, 1))
    assert rows["1"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert rows["accuracy"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, 3))
    assert rows["macro avg"] == pytest.approx((0.75, 0.75, 2 / 3, 3))
    assert rows["weighted avg"] == pytest.approx((2.5 / 3, 2 / 3, 2 / 3, 3))


def test_format_check(spark):
    good = frame(spark, [(1, 0), (2, 1)])
    assert evaluate.first_failure(good, LABELS_TWO_CLASS) is None
    assert evaluate.first_failure(frame(spark, [(None, 0), (2, 7)]), LABELS_TWO_CLASS) == "id is null"
    assert evaluate.first_failure(frame(spark, [(1, None)]), LABELS_TWO_CLASS) == "label is null"
    assert evaluate.first_failure(frame(spark, [(1, 2)]), LABELS_TWO_CLASS) == "unknown label"
    assert evaluate.first_failure(frame(spark, [(1, 5)]), LABELS_SIX_CLASS) is None
    assert evaluate.first_failure(frame(spark, [(1, 6)]), LABELS_SIX_CLASS) == "unknown label"
    with pytest.raises(ValueError):
        evaluate.check_format(good.drop("label"), LABELS_TWO_CLASS)
    assert evaluate.validate_and_score(good, good, LABELS_TWO_CLASS).first().accuracy == 1
    bad = frame(spark, [(1, 2)])
    assert evaluate.validate_and_score(bad, good, LABELS_TWO_CLASS).count() == 0


def test_label_names(spark):
    rows = frame(spark, [(1, 0), (2, 5), (3, 9)])
    assert {r.id: r.name for r in evaluate.with_label_names(rows, LABELS_SIX_CLASS).collect()} == {
        1: "human", 2: "dolly", 3: None
    }


# ------------------------------------------------------------------------- vectors


@pytest.fixture
def layers(spark):
    return spark.createDataFrame(
        [(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]), (2, [[0.0, None], [1.0, 1.0], [2.0, 2.0]])],
        "id long, layers array<array<double>>",
    )


def test_assemble(spark, layers):
    features = spark.createDataFrame([(2, 7.0, None), (1, 8.0, 9.0), (3, 0.0, 0.0)], "id long, a double, b double")
    vectors = {r.id: r["values"] for r in classify.assemble(features, layers, 2).collect()}
    assert vectors == {1: [1, 2, 3, 4, 8, 9], 2: [0, 0, 1, 1, 7, 0]}
    with_id = {r.id: r["values"] for r in classify.assemble(features, layers, 1, include_id=True).collect()}
    assert with_id[1] == [1, 2, 1, 8, 9]
    with pytest.raises(PySparkException):
        classify.assemble(features, layers, 4).collect()


def test_softmax_and_argmax(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, 0.0],)], "s array<double>")
    found = rows.select(vx.softmax(F.col("s")).alias("p"), vx.argmax(F.col("s")).alias("c")).collect()
    total = math.e + 2 * math.e**3
    assert found[0].p == pytest.approx([math.e / total, math.e**3 / total, math.e**3 / total])
    assert found[1].p == pytest.approx([1, 0, 0]) and [r.c for r in found] == [1, 0]


def test_nested_vector(spark):
    row = spark.createDataFrame([(1.0, [3, 2], {"B": 0.5})], "a double, g array<int>, t map<string,double>")
    vector = vx.nested_vector([F.col("a")], F.col("g"), F.col("t"), ["A", "B"])
    assert row.select(vector.alias("v")).first().v == [1.0, 3.0, 2.0, 0.0, 0.5]


def test_train_and_predict(spark):
    rows = spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("label"))
    layers = rows.select(
        "id", F.array(F.array(*[(F.col("label") == i).cast("double") for i in range(3)])).alias("layers")
    )
    features = rows.select("id", (F.col("id") % 7 / 100).alias("noise"))
    pred = train_and_predict(rows, features, layers, features, layers, 1)
    assert pred.columns == ["id", "label"]
    assert pred.join(rows, ["id", "label"]).count() == 90


def test_labels_are_optional(spark, layers):
    assert classify.labelled(layers, spark.range(2)).filter("label IS NULL").count() == 2


# --------------------------------------------------------------------------- files


def test_tolerant_scan(spark, tmp_path):
    first, second = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    first.write_text('{"id": 1, "f": 0.5}\nnot json\n{"f": 2}\n\n{"id": 2, "f": null}\n{"id": 3, "f": "x"}\n')
    second.write_text('{"id": 4}\n')
    good, bad = jsonl.read_with_quarantine(
        spark, [str(first), str(second), str(tmp_path / "absent.jsonl")], "id long, f double"
    )
    assert tuples(good) == [(1, 0.5), (2, None), (4, None)]
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "malformed", "no id"]
    empty, none = jsonl.read_with_quarantine(spark, [str(tmp_path / "absent")], "id long")
    assert empty.count() == none.count() == 0


def test_strict_scan_fails_on_a_bad_line(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1}\nnope\n')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        jsonl.read_jsonl(spark, str(path), "id long").collect()


def test_files_of_different_columns(spark, tmp_path):
    a, b = tmp_path / "a.x.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"id": 1, "text": "t"}\n')
    b.write_text('{"id": 2, "label": 0}\n')
    rows = jsonl.read_files(spark, {str(a): "id long, text string", str(b): "id long, label int"}, "src")
    assert tuples(rows.select("id", "text", "label", "src")) == [(1, "t", None, "a.x"), (2, None, 0, "b")]


def test_round_trip_of_predictions_and_parts(spark, tmp_path):
    rows = frame(spark, [(i, i % 2) for i in range(10)])
    jsonl.write_jsonl(rows, str(tmp_path / "p"))
    assert tuples(jsonl.read_jsonl(spark, str(tmp_path / "p"), jsonl.PREDICTION)) == tuples(rows)
    jsonl.write_parts(split.equal_parts(rows, 4), str(tmp_path / "parts"))
    assert sorted(d for d in os.listdir(tmp_path / "parts") if d[0] == "p") == ["part=0", "part=1", "part=2"]
    back = jsonl.read_parts(spark, str(tmp_path / "parts"), jsonl.PREDICTION)
    assert [r["count"] for r in back.groupBy("part").count().orderBy("part").collect()] == [4, 4, 2]


def test_nulls_are_written(spark, tmp_path):
    jsonl.write_jsonl(frame(spark, [(1, None)]).coalesce(1), str(tmp_path / "n"))
    lines = [open(tmp_path / "n" / f).read() for f in os.listdir(tmp_path / "n") if f.endswith(".json")]
    assert json.loads("".join(lines)) == {"id": 1, "label": None}


def test_required_columns(spark):
    with pytest.raises(ValueError):
        jsonl.required(spark.range(1), ["id", "label"])


def test_submission_files(spark, tmp_path):
    def file(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    good = file("good", '{"id": 1, "label": 0}', '{"id": 2, "label": 1.0, "extra": "x"}')
    problems = {
        good: None,
        str(tmp_path / "absent"): "file is missing",
        file("json", '{"id": 1, "label": 0}', "oops"): "malformed line",
        file("id", '{"label": 0}'): "id is null",
        file("label", '{"id": 1}', '{"id": 2, "label": 7}'): "label is null",
        file("domain", '{"id": 1, "label": 2}'): "unknown label",
        file("half", '{"id": 1, "label": 0.5}'): "unknown label",
    }
    for path, problem in problems.items():
        assert check_submission(spark, path, LABELS_TWO_CLASS) == problem
    gold = frame(spark, [(1, 0), (2, 0)])
    assert score_submission(spark, good, gold, LABELS_TWO_CLASS).first().accuracy == 0.5
    with pytest.raises(ValueError):
        score_submission(spark, str(tmp_path / "json"), gold, LABELS_TWO_CLASS)


def test_layer_columns(spark, layers):
    wide = jsonl.layers_to_columns(layers, 3)
    assert wide.columns == ["id", "0", "1", "2"]
    assert jsonl.layers_from_columns(wide, 3).orderBy("id").collect() == layers.orderBy("id").collect()
    with pytest.raises(ValueError):
        jsonl.layers_from_columns(wide, 4)


def test_nested_record(spark):
    nested = combine.nest_features(spark.createDataFrame([(1, 2.0, "s")], "id long, a double, b string"))
    assert nested.select("id", "features.*").first() == (1, 2.0, "s")
