"""Train on one corpus, predict another, check and score the predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators.classify import assemble, labelled
from inkprint.operators.evaluate import evaluate, validate_and_score
from inkprint.operators.support_vectors import support_vector_labels, train_support_vectors
from inkprint.session import materialize
from inkprint.sources.jsonl import existing_paths, parsed_lines

# Labels are read as numbers of any kind: 1.0 is label 1, and 0.5 is no label.
SUBMISSION = "id long, label double"


def train_and_predict(
    train: DataFrame,
    train_features: DataFrame,
    train_layers: DataFrame,
    test_features: DataFrame,
    test_layers: DataFrame,
    num_layers: int,
    key: str = "id",
    c: float = 1.0,
) -> DataFrame:
    """(id, label) of the test corpus. ``train`` holds (id, label); ``c`` weighs loss against norm."""
    known = labelled(assemble(train_features, train_layers, num_layers, key), train, key)
    model = train_support_vectors(known, c=c)
    return support_vector_labels(assemble(test_features, test_layers, num_layers, key), model, key)


def score_predictions(pred: DataFrame, gold: DataFrame, domain: Sequence[int]) -> DataFrame:
    """Scores of predictions that pass the format check."""
    return validate_and_score(materialize(pred), gold, domain)


def check_submissions(spark: SparkSession, paths: Sequence[str], domain: Sequence[int]) -> DataFrame:
    """(path, check_no, check, n_bad, ok) of several files of predictions.

    All files are read and parsed in one scan. A missing file has one row, ``file is
    missing``; a malformed line counts in its own check only.
    """
    paths = list(paths)
    found = existing_paths(spark, paths)
    missing = [(p, 0, "file is missing", 1, False) for p in paths if p not in found]
    schema = "path string, check_no int, check string, n_bad long, ok boolean"
    result = spark.createDataFrame(missing, schema)
    if not found:
        return result
    # One line for each file; a file without any line has its checks as well.
    files = spark.createDataFrame([(p,) for p in found], "path string")
    rows = parsed_lines(spark, found, SUBMISSION, path="file")
    good = ~F.col("malformed")
    label = F.col("row.label")
    known = F.coalesce(label.isin(list(domain)), F.lit(False))
    counts = rows.groupBy("file").agg(
        F.count_if("malformed").alias("c0"),
        F.count_if(good & F.col("row.id").isNull()).alias("c1"),
        F.count_if(good & label.isNull()).alias("c2"),
        F.count_if(good & ~known).alias("c3"),
    )
    checks = [
        F.struct(
            F.lit(i).alias("check_no"),
            F.lit(name).alias("check"),
            F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_bad"),
            (F.coalesce(F.col(f"c{i}"), F.lit(0)) == 0).alias("ok"),
        )
        for i, name in enumerate(["malformed line", "id is null", "label is null", "unknown label"])
    ]
    # Files lie below the path that was given.
    plain = F.regexp_replace("path", "^file:(//)?", "")
    of_path = (F.col("file") == plain) | F.startswith("file", F.concat(plain, F.lit("/")))
    per_path = files.join(F.broadcast(counts), of_path, "left").groupBy("path").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)]
    )
    return per_path.select("path", F.inline(F.array(*checks))).unionByName(result)


def check_submission(spark: SparkSession, path: str, domain: Sequence[int]) -> str | None:
    """What is wrong with a file of predictions; None if it can be scored.

    The checks run in their order, and the first that fails is named.
    """
    failed = check_submissions(spark, [path], domain).filter(~F.col("ok")).orderBy("check_no").first()
    return failed["check"] if failed else None


def score_submission(
    spark: SparkSession, pred_path: str, gold: DataFrame, domain: Sequence[int]
) -> DataFrame:
    """Scores of a file of predictions; an error if it fails the check."""
    problem = check_submission(spark, pred_path, domain)
    if problem:
        raise ValueError(f"cannot score {pred_path}: {problem}")
    rows = parsed_lines(spark, [pred_path], SUBMISSION)
    return evaluate(rows.select("row.id", "row.label"), gold)
