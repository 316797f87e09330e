"""Name an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    An expression used twice is otherwise copied, and inside a condition or a lambda
    each copy is evaluated.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
