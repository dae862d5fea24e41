"""Exact statistics as DataFrame expressions: interpolated quantiles, tied ranks, correlations, shares, suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import with_average_rank
from .columns import count_where, fisher_interval, percent


def quantile(x: str | Column, p: float) -> Column:
    """Exact linear-interpolated quantile; nulls are left out."""
    return F.percentile(x, F.lit(p))


def quartiles(x: str, names: Sequence[str]) -> list[Column]:
    return [quantile(x, p).alias(n) for p, n in zip((0.25, 0.5, 0.75), names)]


def quantile_by_position(df: DataFrame, keys: list[str], x: str, p: float, name: str) -> DataFrame:
    """The same quantile by positions: the value at 1 + p (n - 1), between its two neighbours.

    A cross-check of :func:`quantile`. Equal values are counted first, so the window runs over the distinct values of a
    key, however many rows it has; ``keys`` may be empty.
    """
    keys_ = keys or ["all_rows"]
    df = df if keys else df.withColumn("all_rows", F.lit(1))
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys_, F.col(x).cast("double").alias("v")).agg(F.count("*").alias("times"))
    upto = Window.partitionBy(*keys_).orderBy("v")
    ranked = counts.withColumn("last", F.sum("times").over(upto)).withColumn("n", F.sum("times").over(Window.partitionBy(*keys_)))
    at = 1 + p * (F.col("n") - 1)
    ranked = ranked.withColumn("lo", F.floor(at)).withColumn("hi", F.ceil(at)).withColumn("part", at - F.floor(at))
    value = lambda place: F.max(F.when((F.col("last") >= F.col(place)) & (F.col("last") - F.col("times") < F.col(place)), F.col("v")))
    out = ranked.groupBy(*keys_).agg((value("lo") + F.max("part") * (value("hi") - value("lo"))).alias(name), F.max("n").alias("n"))
    return out if keys else out.drop("all_rows")


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank within ``keys`` with ties at their mean, by a window: for small groups (see operators.ranking)."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(F.col(x).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Per key: n, rho (correlation of tied ranks) and its interval."""
    ranked = with_average_rank(with_average_rank(df.select(*keys, x, y), keys, x, "rx"), keys, y, "ry")
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))
    low, high = fisher_interval(F.col("rho"), F.col("n"))
    return got.withColumn("ci_low", low).withColumn("ci_high", high)


def share_of_total(df: DataFrame, keys: list[str], measure: Column, name: str, share: str, places: int | None = 1) -> DataFrame:
    """Grouped measure with its percentage of the total: one-row total, broadcast, instead of a window over all rows."""
    by = df.groupBy(*keys).agg(measure.alias(name))
    total = by.agg(F.sum(name).alias("total"))
    return by.crossJoin(F.broadcast(total)).withColumn(share, percent(F.col(name), F.col("total"), places))


def percent_rank_of(x: str, keys: list[str]) -> Column:
    """100 * percent rank among the rows that have a value, null for the rest, by a window: for small groups."""
    has = F.col(x).isNotNull()
    return F.when(has, 100.0 * F.percent_rank().over(Window.partitionBy(*keys, has).orderBy(F.col(x).asc_nulls_last())))


def suppressed(value: Column, n_distinct: Column, least: int) -> Column:
    """Null where a cell has fewer than ``least`` distinct people."""
    return F.when(n_distinct >= least, value)


def group_gap(df: DataFrame, keys: list[str], person: str, group: Column, groups: dict[str, str], outcomes: dict[str, Column], least: int) -> DataFrame:
    """Rates of outcomes in two groups and their gap, hidden where a group has fewer than ``least`` distinct people.

    ``groups``: suffix -> value of ``group``. Counts, rates and gap are hidden; rates are on rows, hiding on people; the gap
    is of unrounded rates.
    """
    aggregates = []
    for suffix, value in groups.items():
        own = group == value
        aggregates += [F.count_distinct(F.when(own, F.col(person))).alias(f"people_{suffix}"), count_where(own).alias(f"rows_{suffix}")]
        aggregates += [count_where(own & c).alias(f"{o}_{suffix}") for o, c in outcomes.items()]
    got = df.groupBy(*keys).agg(*aggregates)
    columns, shown = [F.col(k) for k in keys], F.lit(True)
    for suffix in groups:
        people = F.col(f"people_{suffix}")
        shown = shown & (people >= least)
        columns += [suppressed(F.col(f"{c}_{suffix}"), people, least).alias(f"n_{c}_{suffix}") for c in ("people", "rows")]
        columns += [suppressed(percent(F.col(f"{o}_{suffix}"), F.col(f"rows_{suffix}")), people, least).alias(f"{o}_rate_{suffix}") for o in outcomes]
        columns.append(F.when(people < least, f"n < {least}").otherwise(people.cast("string")).alias(f"label_{suffix}"))
    first, second = groups
    for o in outcomes:
        raw = [percent(F.col(f"{o}_{s}"), F.col(f"rows_{s}"), None) for s in (first, second)]
        columns.append(F.when(shown, F.floor(F.abs(raw[1] - raw[0]) * 10 + 0.5) / 10.0).alias(f"{o}_gap"))
    return got.select(*columns)
