"""The data-quality gate: each check is a small DataFrame; ``Gate`` runs them before anything is published."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_null, n_rows) of every column in one pass."""
    sums = df.agg(F.count("*").alias("n_rows"), *(count_where(F.col(c).isNull()).alias(f"c_{c}") for c in df.columns))
    pairs = ", ".join(f"'{c}', c_{c}" for c in df.columns)
    return sums.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, n_null)", "n_rows")


def bad_cast_audit(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(column_name, n_bad): values that are present and do not cast."""
    sums = df.agg(*(count_where(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"c_{c}") for c, t in types.items()))
    pairs = ", ".join(f"'{c}', c_{c}" for c in types)
    return sums.selectExpr(f"stack({len(types)}, {pairs}) as (column_name, n_bad)")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()))


def reconcile_counts(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_left, n_right, is_equal) of two sets of tables."""
    got = row_counts(left).withColumnRenamed("n_rows", "n_left").join(row_counts(right).withColumnRenamed("n_rows", "n_right"), "table_name", "full")
    return got.withColumn("is_equal", F.coalesce(F.col("n_left") == F.col("n_right"), F.lit(False)))


def key_report(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(table_name, n_rows, n_keys, is_unique); a key with a null part counts as one."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"))
    got = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
    return got.select(F.lit(name).alias("table_name"), "n_rows", "n_keys", (F.col("n_rows") == F.col("n_keys")).alias("is_unique"))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(link_name, n_orphans): child rows whose key, all parts present, has no parent."""
    present = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    got = child.where(present).join(parent.select(*keys), keys, "left_anti").agg(F.count("*").alias("n_orphans"))
    return got.select(F.lit(name).alias("link_name"), "n_orphans")


def flag_counts(tables: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """(table_name, flag_name, n_true): one pass for each table."""
    parts = []
    for name, (df, flags) in tables.items():
        sums = df.agg(*(count_where(c).alias(f"c_{k}") for k, c in flags.items()))
        pairs = ", ".join(f"'{k}', c_{k}" for k in flags)
        parts.append(sums.selectExpr(f"'{name}' as table_name", f"stack({len(flags)}, {pairs}) as (flag_name, n_true)"))
    return reduce(DataFrame.unionByName, parts)


def sums_agree(measures: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(measure_name, total, is_equal): do all totals equal the first?"""
    parts = [df.agg(F.coalesce(F.sum(c), F.lit(0)).alias("total")).select(F.lit(i).alias("i"), F.lit(name).alias("measure_name"), "total") for i, (name, (df, c)) in enumerate(measures.items())]
    got = reduce(DataFrame.unionByName, parts)
    first = got.where("i = 0").select(F.col("total").alias("expected"))
    return got.crossJoin(F.broadcast(first)).select("measure_name", "total", (F.col("total") == F.col("expected")).alias("is_equal"))


def incomplete_grids(df: DataFrame, keys: list[str], period: str, first: int) -> DataFrame:
    """Keys whose periods are not exactly first, first + 1, ..., last."""
    got = df.groupBy(*keys).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count("*").alias("n_periods"), F.count_distinct(period).alias("n_distinct"))
    whole = (F.col("first_period") == first) & (F.col("n_periods") == F.col("last_period") - first + 1) & (F.col("n_distinct") == F.col("n_periods"))
    return got.where(~whole).drop("n_distinct")


def decreases(df: DataFrame, keys: list[str], period: str, measures: list[str]) -> DataFrame:
    """(measure_name, n_decreases) of measures that must never fall."""
    w = Window.partitionBy(*keys).orderBy(period)
    falls = df.select(*(((F.col(m) < F.lag(m).over(w))).alias(f"c_{m}") for m in measures)).agg(*(count_where(F.col(f"c_{m}")).alias(f"c_{m}") for m in measures))
    pairs = ", ".join(f"'{m}', c_{m}" for m in measures)
    return falls.selectExpr(f"stack({len(measures)}, {pairs}) as (measure_name, n_decreases)")


def fd_violations(df: DataFrame, left: list[str], right: str, name: str) -> DataFrame:
    """(dependency, n_violations): values of ``left`` with more than one value (null is one) of ``right``."""
    value = F.struct(F.col(right).isNull(), F.col(right))
    got = df.groupBy(*left).agg(F.count_distinct(value).alias("n")).where("n > 1").agg(F.count("*").alias("n_violations"))
    return got.select(F.lit(name).alias("dependency"), "n_violations")


def duplicate_groups(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(table_name, n_groups, n_rows): keys that occur more than once, and their rows."""
    got = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return got.select(F.lit(name).alias("table_name"), "n_groups", "n_rows")


def fingerprint(df: DataFrame, places: int = 9) -> DataFrame:
    """(n_rows, hash_sum): the same for the same rows in any order; numbers count to ``places`` decimals; copies count."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            c = F.format_string(f"%.{places}f", F.round(c, places) + F.lit(0.0))
        parts += [F.lit(f.name), F.coalesce(c.cast("string"), F.lit("\u0000null"))]
    return df.select(F.xxhash64(*parts).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Keys that one side lacks, or whose values differ (numbers by more than ``tolerance``): (keys, problem)."""
    values = [f for f in left.schema.fields if f.name not in keys]
    a = left.select(*keys, F.lit(True).alias("in_left"), *(F.col(f.name).alias(f"l_{f.name}") for f in values))
    b = right.select(*keys, F.lit(True).alias("in_right"), *(F.col(f.name).alias(f"r_{f.name}") for f in values))
    both = a.join(b, keys, "full")
    differ = F.lit(False)
    for f in values:
        x, y = F.col(f"l_{f.name}"), F.col(f"r_{f.name}")
        same = F.abs(x - y) <= tolerance if f.dataType.typeName() in ("double", "float") else x == y
        differ = differ | ~F.coalesce(same, x.isNull() & y.isNull())
    problem = F.when(F.col("in_left").isNull(), "only right").when(F.col("in_right").isNull(), "only left").when(differ, "values differ")
    return both.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def bag_difference(left: DataFrame, right: DataFrame, places: int = 9) -> DataFrame:
    """Rows that one side has more often than the other: (row, n_left, n_right), copies counted, without a key.

    Numbers with decimals count to ``places``, as in :func:`fingerprint`; columns go by name. Rows are counted by a 128-bit
    hash, before they are shuffled; a row itself is kept once for each hash.
    """
    names = sorted(left.columns)
    if names != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(names) ^ set(right.columns))}")
    parts = []
    for df, sides in ((left, (1, 0)), (right, (0, 1))):
        types = dict(df.dtypes)
        value = lambda c: F.coalesce(F.format_string(f"%.{places}f", F.round(c, places) + F.lit(0.0)) if types[c] in ("double", "float") else F.col(c).cast("string"), F.lit("\u0000null"))  # noqa: B023, E731
        texts = F.array(*map(value, names))
        row = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
        parts.append(df.select(F.xxhash64(texts).alias("h"), F.xxhash64(F.lit(1), texts).alias("g"), row.alias("row"), F.lit(sides[0]).alias("l"), F.lit(sides[1]).alias("r")))
    got = parts[0].unionByName(parts[1]).groupBy("h", "g").agg(F.min("row").alias("row"), F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    return got.where("n_left <> n_right").select("row", "n_left", "n_right")


class GateError(RuntimeError):
    """A check failed; nothing was published."""


class Gate:
    """Checks by name, each a DataFrame that is empty when all is well."""

    def __init__(self) -> None:
        self.checks: dict[str, DataFrame] = {}
        self.reports: list[DataFrame] = []

    def add(self, name: str, failures: DataFrame) -> Gate:
        self.checks[name] = failures
        return self

    def add_report(self, counts: DataFrame) -> Gate:
        """Checks that were counted together: (check_name, n_failures)."""
        self.reports.append(counts)
        return self

    def report(self, spark: SparkSession) -> DataFrame:
        parts = [row_counts(self.checks).select(F.col("table_name").alias("check_name"), F.col("n_rows").alias("n_failures"))] if self.checks else []
        return reduce(DataFrame.unionByName, [*parts, *self.reports])

    def enforce(self, spark: SparkSession) -> None:
        bad = self.report(spark).where("n_failures > 0").collect()  # a row for each check
        if bad:
            raise GateError("; ".join(f"{r.check_name}: {r.n_failures}" for r in bad))
