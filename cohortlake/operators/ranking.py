"""Ranks and exact quantiles of groups of any size: no window over the rows of a group, and no group in one task.

Values are put in ranges that follow from the value alone, so that every evaluation agrees: ``PER_OCTAVE`` of them between a
power of two and the next. Rows are counted by value, counts are summed by range (a group has some thousand ranges at
most), prefix sums run over the ranges of a group and over the distinct values of a range, and both add up to the
rows below a value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: ranges between a power of two and the next: a range spans about 1 percent of its values
PER_OCTAVE = 64
_ALL = 1_100 * PER_OCTAVE  # beyond the exponents of doubles
_NULL = 4 * _ALL


def value_range(x: Column) -> Column:
    """The number of a value's range: never falls as values rise; nulls come last, NaN before them."""
    x = x.cast("double")
    size = F.floor(F.log2(F.abs(x)) * PER_OCTAVE) + _ALL
    return F.when(x.isNull(), _NULL).when(F.isnan(x), _NULL - 1).when(x == 0, 0).when(F.abs(x) == float("inf"), F.signum(x) * (_NULL - 2)).otherwise(F.signum(x) * size).cast("long")


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("all_rows", F.lit(1)), ["all_rows"])


def _over_ranges(keys: list[str]) -> tuple[WindowSpec, WindowSpec]:
    """Windows over the ranges of a group, at most some thousand rows: up to each, and over all."""
    by = Window.partitionBy(*keys).orderBy("range_no")
    return by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def value_ranks(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, value, n_below, n_same, n_values) of each distinct value of ``x``: rows of the group below it, with it, and with
    any value. Nulls are a value above all others, and not among ``n_values``."""
    df, own = _keyed(df, keys)
    counts = df.groupBy(*own, F.col(x).alias("value")).agg(F.count("*").alias("n_same")).withColumn("range_no", value_range(F.col("value")))
    upto, all_ranges = _over_ranges(own)
    ranges = counts.groupBy(*own, "range_no").agg(F.sum("n_same").alias("n_range")).withColumns(
        {"before": F.sum("n_range").over(upto) - F.col("n_range"), "n_values": F.coalesce(F.sum(F.when(F.col("range_no") != _NULL, F.col("n_range"))).over(all_ranges), F.lit(0))}
    )
    inside = F.sum("n_same").over(Window.partitionBy(*own, "range_no").orderBy(F.col("value").asc_nulls_last())) - F.col("n_same")
    got = counts.withColumn("inside", inside).join(ranges.drop("n_range"), [*own, "range_no"])
    return got.select(*keys, "value", (F.col("before") + F.col("inside")).alias("n_below"), "n_same", "n_values")


def _with_ranks(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """``df`` with the columns of :func:`value_ranks` for its own value."""
    ranks = value_ranks(df, keys, x)
    ranks = ranks.select(*(F.col(k).alias(f"{k} of ranks") for k in keys), "value", "n_below", "n_same", "n_values")
    same = F.col(x).eqNullSafe(F.col("value"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k} of ranks"))
    return df.join(ranks, same).drop("value", *(f"{k} of ranks" for k in keys))


def with_average_rank(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """``df`` with the rank of ``x`` within ``keys``, ties at their mean, nulls last."""
    got = _with_ranks(df, keys, x)
    return got.withColumn(name, F.col("n_below") + (F.col("n_same") + 1) / F.lit(2.0)).drop("n_below", "n_same", "n_values")


def with_percent_rank(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """``df`` with 100 * percent rank of ``x`` among the rows of ``keys`` that have a value; null for the rest, 0 for a single one."""
    got = _with_ranks(df, keys, x)
    rank = F.coalesce(F.try_divide(100.0 * F.col("n_below"), F.col("n_values") - 1), F.lit(0.0))
    return got.withColumn(name, F.when(F.col(x).isNotNull(), rank)).drop("n_below", "n_same", "n_values")


def exact_quantiles(df: DataFrame, keys: list[str], x: str, quantiles: Mapping[str, float]) -> DataFrame:
    """(keys, n, a column for each of ``quantiles``): exact, between neighbours by linear interpolation, nulls left out.

    Two passes. The first counts rows by range, which tells in which ranges the wanted places lie and how many rows come
    before; the second counts by value within those ranges alone. What a task holds is the ranges of a group, or the
    distinct values of a range, however many rows and distinct values the group has.
    """
    df, own = _keyed(df, keys)
    rows = df.where(F.col(x).isNotNull()).select(*own, F.col(x).cast("double").alias("value"), value_range(F.col(x)).alias("range_no"))
    upto, all_ranges = _over_ranges(own)
    ranges = rows.groupBy(*own, "range_no").agg(F.count("*").alias("n_range")).withColumns({"upto": F.sum("n_range").over(upto), "n": F.sum("n_range").over(all_ranges)})
    ranges = ranges.withColumn("before", F.col("upto") - F.col("n_range"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (1 + p * (F.col("n") - 1)).alias("at")) for name, p in quantiles.items()))
    places = ranges.withColumn("wanted", wanted).withColumn("wanted", F.filter("wanted", lambda w: (F.ceil(w["at"]) > F.col("before")) & (F.floor(w["at"]) <= F.col("upto"))))
    places = places.where(F.size("wanted") > 0).select(*own, "range_no", "before", "n", "wanted")
    inside = rows.join(places.select(*own, "range_no"), [*own, "range_no"]).groupBy(*own, "range_no", "value").agg(F.count("*").alias("n_same"))
    inside = inside.withColumn("last", F.sum("n_same").over(Window.partitionBy(*own, "range_no").orderBy("value")))
    found = inside.join(places, [*own, "range_no"]).withColumn("last", F.col("last") + F.col("before")).withColumn("first", F.col("last") - F.col("n_same") + 1)
    holds = lambda place: F.when((F.col("first") <= place) & (F.col("last") >= place), F.col("value"))
    each = found.select(*own, "n", "value", "first", "last", F.inline("wanted")).select(*own, "n", "name", "at", holds(F.floor("at")).alias("lower"), holds(F.ceil("at")).alias("upper"))
    each = each.groupBy(*own, "n", "name").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.max("at").alias("at"))
    value = F.col("lower") + (F.col("at") - F.floor("at")) * (F.col("upper") - F.col("lower"))
    return each.groupBy(*own, "n").agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for name in quantiles)).select(*keys, "n", *quantiles)
