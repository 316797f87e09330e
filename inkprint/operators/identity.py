"""Which text a row belongs to, when ids may repeat or be missing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.session import materialize

ROW = "row_id"


@dataclass(frozen=True)
class TextRows:
    """``rows`` is (row_id, columns); ``owners`` (row_id, keys) if ids repeat, else None."""

    rows: DataFrame
    owners: DataFrame | None
    keys: tuple[str, ...]

    def by_key(self, result: DataFrame) -> DataFrame:
        """Put the keys in the place of row_id."""
        others = [c for c in result.columns if c != ROW]
        if self.owners is None:
            return result.select(F.col(ROW).alias(self.keys[0]), *others)
        return result.join(self.owners, ROW).select(*self.keys, *others)


def names_rows(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the keys name each row: none is null and none occurs twice.

    Only ids move, counted before they are shuffled.
    """
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | missing)
    return bad.isEmpty()


def numbered_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> TextRows:
    """Rows with numbers of their own, written out so that a number stays with its row."""
    numbered = materialize(df.select(F.monotonically_increasing_id().alias(ROW), *keys, *columns))
    return TextRows(numbered.select(ROW, *columns), numbered.select(ROW, *keys), tuple(keys))


def text_rows(df: DataFrame, key: str, columns: Sequence[str]) -> TextRows:
    """Give each text an id of its own.

    Ids that name their rows serve as they are. Otherwise rows are numbered, so that texts
    under one id, or without one, are measured one by one, and an id with very many texts is
    spread over all tasks like any others.
    """
    if names_rows(df, [key]):
        return TextRows(df.select(F.col(key).alias(ROW), *columns), None, (key,))
    return numbered_rows(df, [key], columns)


def each_text(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    work: Callable[[DataFrame, list[str]], DataFrame],
    unique: bool = False,
) -> DataFrame:
    """``work(rows, keys)``, with every row of ``df`` measured as a text of its own.

    ``unique`` says that the keys are known to name rows, which saves the look at them.
    """
    keys = list(keys)
    if unique or names_rows(df, keys):
        return work(df, keys)
    rows = numbered_rows(df, keys, [c for c in columns if c not in keys])
    return rows.by_key(work(rows.rows, [ROW]))


__all__ = ["ROW", "TextRows", "names_rows", "numbered_rows", "text_rows", "each_text"]
