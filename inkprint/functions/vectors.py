"""Array functions for layers, scores and feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkprint.functions.binding import let


def last_layers(layers: Column, count: int) -> Column:
    """The first ``count`` entries (index 0 is the last layer); fails if there are fewer."""
    enough = F.size(layers) >= count
    error = F.raise_error(
        F.concat(F.lit(f"{count} layers requested, found "), F.size(layers).cast("string"))
    )
    return F.when(enough, F.slice(layers, 1, count)).otherwise(error.cast("array<array<double>>"))


def flatten_layers(layers: Column) -> Column:
    """One flat vector from a list of layer vectors."""
    return F.flatten(layers)


def cut_into_layers(vector: Column, count: int, width: int) -> Column:
    """``count`` consecutive slices of ``width`` numbers."""
    return F.array(*[F.slice(vector, i * width + 1, width) for i in range(count)])


def feature_array(columns: Sequence[str]) -> Column:
    """Numeric columns as one array, nulls as zero."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])


def softmax(scores: Column) -> Column:
    """Exponentials of the scores, shifted by their maximum and scaled to sum 1."""

    def shifted(s: Column) -> Column:
        return let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))

    def scaled(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(e, lambda x: x / t))

    return let(let(scores, shifted), scaled)


def argmax(scores: Column) -> Column:
    """Position of the largest score, the lowest one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def nested_vector(scalars: Sequence[Column], ngrams: Column, tags: Column, tag_names: Sequence[str]):
    """Scalars, then n-gram counts, then tag values in the order of ``tag_names``."""
    tag_values = [F.coalesce(F.try_element_at(tags, F.lit(t)), F.lit(0.0)) for t in tag_names]
    return F.concat(
        F.array(*[s.cast("double") for s in scalars]),
        ngrams.cast("array<double>"),
        F.array(*tag_values),
    )
