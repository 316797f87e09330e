"""Feature vectors, and labels by linear weights over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.vectors import (
    argmax,
    cut_into_layers,
    feature_array,
    flatten_layers,
    last_layers,
)


def stored_layers(df: DataFrame, key: str, embedding: str, count: int, width: int) -> DataFrame:
    """(key, layers): stored vectors cut into ``count`` layers of ``width`` numbers."""
    vector = F.col(embedding).cast("array<double>")
    return df.select(key, cut_into_layers(vector, count, width).alias("layers"))


def assemble(
    features: DataFrame,
    layers: DataFrame,
    num_layers: int,
    key: str = "id",
    include_id: bool = False,
) -> DataFrame:
    """(key, values): the last layers, flattened, followed by the features.

    Rows meet by id, never by position. ``include_id`` puts the raw id among the
    features, as older vector files have it.
    """
    names = [c for c in features.columns if c != key]
    if include_id:
        names = [key, *names]
    model_input = features.select(key, feature_array(names).alias("_features"))
    flat = layers.select(
        key,
        F.transform(
            flatten_layers(last_layers(F.col("layers"), num_layers)),
            lambda x: F.coalesce(x, F.lit(0.0)),
        ).alias("_layers"),
    )
    return flat.join(model_input, key).select(key, F.concat("_layers", "_features").alias("values"))


def linear_labels(rows: DataFrame, weights: Sequence[Sequence[float]], key: str, values: str = "values") -> DataFrame:
    """(id, label): the class whose weights score a vector highest, the first of equals."""
    scores = [
        F.aggregate(
            F.zip_with(F.col(values), F.array(*[F.lit(float(w)) for w in line]), lambda x, w: x * w),
            F.lit(0.0),
            lambda a, x: a + x,
        )
        for line in weights
    ]
    return rows.select(F.col(key).alias("id"), argmax(F.array(*scores)).cast("int").alias("label"))


def labelled(vectors: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """Add the label by id; null for all where the documents have none."""
    if "label" not in documents.columns:
        return vectors.withColumn("label", F.lit(None).cast("int"))
    return vectors.join(documents.select(key, "label"), key)
