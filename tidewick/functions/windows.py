"""Windows over one symbol's bars, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("bar_date")


def last_rows(n: int, until: int = 0) -> WindowSpec:
    """The n rows that end `-until` rows before the current one."""
    return by_symbol().rowsBetween(until - n + 1, until)


def full(agg: Column, value: str, n: int) -> Column:
    """An aggregate over the last n rows, null until there are n values."""
    return F.when(F.count(value).over(last_rows(n)) == n, agg.over(last_rows(n)))


def lag(name: str, n: int = 1) -> Column:
    return F.lag(name, n).over(by_symbol())


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
