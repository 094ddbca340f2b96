"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str | float | int) -> Column:
    """Column from a column, a column name or a plain number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times in ``body``.

    The optimizer inlines a column into the lambda that uses it, where it would be computed once
    per array element; a lambda variable is not inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def round_to(value: Column | str, digits: int) -> Column:
    """Round half to even on the binary value (``rint``), never returning minus zero."""
    scale = float(10 ** digits)
    return F.rint(as_col(value) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def strings(values: Iterable[str]) -> Column:
    """Literal ``array<string>``, also for an empty list."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def not_empty(value: Column | str) -> Column:
    """Null for empty text, so that ``coalesce`` skips it."""
    col = as_col(value)
    return F.when(F.length(col) > 0, col)


def sorted_distinct(value: Column) -> Column:
    return F.array_sort(F.array_distinct(value))


def sum_array(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def iso_minute(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def iso_second(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
