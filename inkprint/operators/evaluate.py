"""Checking and scoring of predictions.

Every score derives from one small table, the number of joined rows per (gold,
predicted) label: the data is joined and counted once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.session import materialize


def id_and_label(df: DataFrame) -> DataFrame:
    """The two columns of a submission; fails if one is absent."""
    return df.select("id", "label")


def label_table(spark: SparkSession, names: Mapping[int, str]) -> DataFrame:
    """(label, name) of a task."""
    return spark.createDataFrame(list(names.items()), "label int, name string")


def with_label_names(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Add the class name of each row's label, null for an unknown one."""
    table = label_table(df.sparkSession, names)
    return df.join(F.broadcast(table), "label", "left")


def with_label_numbers(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Add the label of each row's class name."""
    table = label_table(df.sparkSession, names)
    return df.join(F.broadcast(table), "name", "left")


def match_gold(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, label_pred, label_gold) for ids on both sides; others are not scored."""
    left = id_and_label(pred).withColumnRenamed("label", "label_pred")
    right = id_and_label(gold).withColumnRenamed("label", "label_gold")
    return left.join(right, "id", "inner")


def label_pairs(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(label_gold, label_pred, n): joined rows per pair of labels.

    Repeated ids multiply in the join. They are counted on each side before it and
    the counts multiplied, so an id that is repeated very often stays one row.
    """
    left = id_and_label(pred).groupBy("id", F.col("label").alias("label_pred"))
    right = id_and_label(gold).groupBy("id", F.col("label").alias("label_gold"))
    matched = left.agg(F.count(F.lit(1)).alias("n_pred")).join(
        right.agg(F.count(F.lit(1)).alias("n_gold")), "id"
    )
    return matched.groupBy("label_gold", "label_pred").agg(
        F.sum(F.col("n_pred") * F.col("n_gold")).alias("n")
    )


def class_counts(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) for every label in gold or predictions."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    right = F.col("label_gold") == F.col("label_pred")
    as_gold = F.struct(
        F.col("label_gold").alias("label"),
        F.when(right, n).otherwise(zero).alias("tp"),
        zero.alias("fp"),
        F.when(right, zero).otherwise(n).alias("fn"),
    )
    as_pred = F.struct(
        F.col("label_pred").alias("label"),
        zero.alias("tp"),
        F.when(right, zero).otherwise(n).alias("fp"),
        zero.alias("fn"),
    )
    rows = pairs.select(F.inline(F.array(as_gold, as_pred)))
    return rows.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def with_class_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and support; a zero division counts as 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        "label",
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
    )


def _micro_f1():
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def _accuracy():
    return F.try_divide(F.sum("tp"), F.sum("support"))


def evaluate(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: macro_f1, micro_f1, accuracy."""
    scores = with_class_scores(class_counts(label_pairs(pred, gold)))
    return scores.agg(
        F.avg("f1").alias("macro_f1"), _micro_f1().alias("micro_f1"), _accuracy().alias("accuracy")
    )


def classification_report(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(row, precision, recall, f1, support) per class, then accuracy and averages."""
    # A few rows, read four times below.
    scores = with_class_scores(class_counts(materialize(label_pairs(pred, gold))))
    parts = ["precision", "recall", "f1"]
    classes = scores.select(F.col("label").cast("string").alias("row"), *parts, "support")
    total = F.sum("support")
    accuracy = scores.agg(*[_accuracy().alias(c) for c in parts], total.alias("support"))
    macro = scores.agg(*[F.avg(c).alias(c) for c in parts], total.alias("support"))
    weighted = scores.agg(
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in parts],
        total.alias("support"),
    )
    named = [
        part.select(F.lit(name).alias("row"), *parts, "support")
        for name, part in (
            ("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)
        )
    ]
    report = classes
    for part in named:
        report = report.unionByName(part)
    return report


def confusion_matrix(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(label_gold, label_pred, n) for all pairs of labels in gold, zeros included.

    Predicted labels that gold does not have are left out, and so is a null in gold.
    """
    labels = materialize(gold.select("label").filter("label IS NOT NULL").distinct())
    # The result has a row for each pair of classes; this is that grid.
    grid = labels.select(F.col("label").alias("label_gold")).crossJoin(
        labels.select(F.col("label").alias("label_pred"))
    )
    counted = grid.join(label_pairs(pred, gold), ["label_gold", "label_pred"], "left")
    return counted.select("label_gold", "label_pred", F.coalesce("n", F.lit(0)).alias("n"))


def check_format(pred: DataFrame, domain: Sequence[int]) -> DataFrame:
    """(check_no, check, n_bad, ok): null ids, null labels, labels outside the task's."""
    for column in ("id", "label"):
        if column not in pred.columns:
            raise ValueError(f"column {column!r} is missing")
    label = F.col("label")
    known = F.coalesce(label.isin(list(domain)), F.lit(False))
    counts = pred.agg(
        F.count_if(F.col("id").isNull()).alias("c1"),
        F.count_if(label.isNull()).alias("c2"),
        F.count_if(~known).alias("c3"),
    )
    names = ["id is null", "label is null", "unknown label"]
    rows = [
        F.struct(
            F.lit(i).alias("check_no"),
            F.lit(name).alias("check"),
            F.col(f"c{i}").alias("n_bad"),
            (F.col(f"c{i}") == 0).alias("ok"),
        )
        for i, name in enumerate(names, 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def repeated_ids(pred: DataFrame) -> DataFrame:
    """(id, n) of ids that occur more than once. Scoring does not forbid them."""
    return pred.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_failure(pred: DataFrame, domain: Sequence[int]) -> str | None:
    """Name of the first check that fails, None for a valid submission."""
    failed = check_format(pred, domain).filter(~F.col("ok")).orderBy("check_no").first()
    return failed["check"] if failed else None


def unknown_labels(pred: DataFrame) -> DataFrame:
    """The distinct labels of a submission."""
    return pred.select("label").distinct()


def validate_and_score(pred: DataFrame, gold: DataFrame, domain: Sequence[int]) -> DataFrame:
    """The scores of a valid submission, no row for an invalid one."""
    scores = evaluate(pred, gold)
    return scores.limit(0) if first_failure(pred, domain) else scores
