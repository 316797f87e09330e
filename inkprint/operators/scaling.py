"""Column scaling: fit statistics on a corpus, apply them as a plain projection.

Fitting brings back one row; applying needs no join and no shuffle. Statistics of
one corpus can be applied to another by passing them on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Stats = dict[str, tuple[float | None, float | None]]


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of a numeric type, without the excluded keys."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def other_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns that scaling leaves alone."""
    return [
        f.name
        for f in df.schema
        if not isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def _fit(df: DataFrame, columns: Sequence[str], shift, scale) -> Stats:
    both = []
    for i, name in enumerate(columns):
        value = F.nanvl(_quoted(name).cast("double"), F.lit(None))
        both += [shift(value).alias(f"s{i}"), scale(value).alias(f"d{i}")]
    row = df.agg(*both).first()
    return {name: (row[f"s{i}"], row[f"d{i}"]) for i, name in enumerate(columns)}


def fit_zscore(df: DataFrame, columns: Sequence[str], population: bool = False) -> Stats:
    """Mean and standard deviation; the sample form unless ``population``."""
    return _fit(df, columns, F.avg, F.stddev_pop if population else F.stddev_samp)


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> Stats:
    """Minimum and range."""
    return _fit(df, columns, F.min, lambda v: F.max(v) - F.min(v))


def fit_maxabs(df: DataFrame, columns: Sequence[str]) -> Stats:
    """Zero and the largest absolute value."""
    return _fit(df, columns, lambda v: F.min(v) * 0, lambda v: F.max(F.abs(v)))


def apply_scaling(df: DataFrame, stats: Stats, fill: float | None = 0.0) -> DataFrame:
    """``(x - shift) / scale`` for every fitted column.

    A null, and a column without spread, becomes ``fill``.
    """

    def scaled(name: str):
        shift, scale = stats[name]
        if shift is None or not scale:
            value = F.lit(None).cast("double")
        else:
            x = F.nanvl(_quoted(name).cast("double"), F.lit(None))
            value = (x - F.lit(shift)) / F.lit(scale)
        return value if fill is None else F.coalesce(value, F.lit(fill))

    return df.select(
        *[scaled(c).alias(c) if c in stats else _quoted(c) for c in df.columns]
    )


def zscore(df: DataFrame, keys: Sequence[str], stats: Stats | None = None) -> DataFrame:
    """Z-score all numeric columns but the keys, by sample deviation."""
    return apply_scaling(df, stats or fit_zscore(df, numeric_columns(df, keys)))


def scale_features(df: DataFrame, keys: Sequence[str], method: str = "z-score") -> DataFrame:
    """Scale numeric columns by population z-score or ``min-max``; keep the others."""
    columns = numeric_columns(df, keys)
    if method == "z-score":
        stats = fit_zscore(df, columns, population=True)
    elif method == "min-max":
        stats = fit_minmax(df, columns)
    else:
        raise ValueError(f"unknown method {method!r}")
    spread_free = {c: s for c, s in stats.items() if not s[1]}
    scaled = apply_scaling(df, {c: s for c, s in stats.items() if s[1]}, fill=None)
    # A constant column scales to 0, a missing value stays missing.
    return scaled.select(
        *[
            F.when(_quoted(c).isNotNull(), F.lit(0.0)).alias(c) if c in spread_free else _quoted(c)
            for c in scaled.columns
        ]
    )


def scale_by_max(df: DataFrame, column: str) -> DataFrame:
    """Divide a column by its largest absolute value (all zero: null)."""
    return apply_scaling(df, fit_maxabs(df, [column]), fill=None)


def fill_nulls(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Nulls and NaN of numeric columns as zero."""
    return df.na.fill(0, subset=numeric_columns(df, exclude))
