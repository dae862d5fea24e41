"""Relational operators that the warehouse is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_exists(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a flag: do its keys occur in ``other``? ``other`` shrinks to a count for each key before it is joined."""
    times = other.groupBy(*keys).agg(F.count("*").alias(name))
    return df.join(times, keys, "left").withColumn(name, F.isnotnull(name))


def latest_by_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of the largest ``order`` (nulls are smallest) of each key: the largest of each task, then of those."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.lit(0).alias("_"), *order)).alias("newest"))
    return newest.select(*keys, "newest.*").select(*df.columns)


def first_qualifying(df: DataFrame, condition: Column, keys: list[str], order: list[str], name: str, key: str) -> DataFrame:
    """``df`` with a flag at the first row, by ``order``, among the rows of each key that meet ``condition``."""
    first = df.where(condition).groupBy(*keys).agg(F.min_by(key, F.struct(*order)).alias(key)).select(key).withColumn(name, F.lit(True))
    return df.join(first, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def period_grid(df: DataFrame, first: Column | int, last: Column, name: str = "week_no") -> DataFrame:
    """A row for each period from ``first`` to ``last``; none if last is before first."""
    lo = first if isinstance(first, Column) else F.lit(first)
    return df.where(last >= lo).withColumn(name, F.explode(F.sequence(lo, last)))


def open_periods(items: DataFrame, due: str, done: str, last: str, first: int, name: str = "week_no") -> DataFrame:
    """A row for each period in which an item is due and not done: [due, done - 1], or to ``last`` if never done.

    Expands only open periods instead of joining the whole grid with all items.
    """
    lo = F.greatest(F.col(due), F.lit(first))
    hi = F.least(F.coalesce(F.col(done) - 1, F.col(last)), F.col(last))
    return items.where(hi >= lo).withColumn(name, F.explode(F.sequence(lo, hi)))


def replicate(df: DataFrame, factor: int, key: str, offset: int) -> DataFrame:
    """``factor`` copies of ``df``, the key of copy i moved by i * offset: each row expands where it is, without a join."""
    moves = F.array(*(F.lit(i * offset) for i in range(factor)))
    return df.select(*(F.col(c) for c in df.columns if c != key), F.explode(F.transform(moves, lambda m: F.col(key) + m)).alias(key)).select(*df.columns)


def previous_value(x: str, keys: list[str], period: str, default: int = 0) -> Column:
    """Value of the period before: a lag, kept only if the row before is that period (grids may have holes)."""
    w = Window.partitionBy(*keys).orderBy(period)
    adjacent = F.lag(period).over(w) == F.col(period) - 1
    return F.coalesce(F.when(adjacent, F.lag(x).over(w)), F.lit(default))
