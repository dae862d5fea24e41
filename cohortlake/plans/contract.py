"""What each warehouse table promises, as data: its key, its columns with their rules, what may be null, what never happens.

The builders derive columns from the rules here, the pipeline measures the promises while it writes a table (as observed
metrics of that write, without another scan), the gate compares them, and the tests plant faults against them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import PASS_SCORE
from ..operators.quality import GateError

OFFERING = ["code_module", "code_presentation"]
ENROLMENT = ["id_student", *OFFERING]
#: a column that may be null anywhere; other columns are null exactly where their condition holds, or never
ANYWHERE = "true or null"


@dataclass(frozen=True)
class Table:
    """``rules``: derived columns, each an SQL expression over the columns before it. ``nulls``: column -> condition under
    which it is null, and only then (ANYWHERE: no promise); all others are never null. ``never``: conditions that hold for no
    row. ``flags``: conditions whose rows are counted, besides all boolean columns. ``sums``: measures that are added
    up. ``rising``: running totals that never fall from one row of a key to the next. ``absent``: columns it must not have."""

    keys: list[str]
    rules: Mapping[str, str] = field(default_factory=dict)
    nulls: Mapping[str, str] = field(default_factory=dict)
    never: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    rising: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()

    def derive(self, df: DataFrame, *without: str) -> DataFrame:
        """``df`` with the derived columns, those of ``without`` left out."""
        for name, rule in self.rules.items():
            df = df.withColumn(name, F.expr(rule)) if name not in without else df
        return df

    def promises(self, df: DataFrame) -> dict[str, Column]:
        """Metrics by name, each one aggregate: rows, broken promises (``broken ...``), counts of flags and sums."""
        out = {"rows": F.count("*")}
        for c in df.columns:
            allowed = self.nulls.get(c, "false")
            if allowed != ANYWHERE:
                out[f"broken null: {c}"] = F.count_if(F.col(c).isNull() != F.coalesce(F.expr(allowed), F.lit(False)))
        out |= {f"broken never: {x}": F.count_if(F.expr(x)) for x in self.never}
        flags = [*(f.name for f in df.schema if f.dataType.typeName() == "boolean"), *self.flags]
        out |= {f"flag {x}": F.count_if(F.expr(x)) for x in flags}
        return out | {f"sum {x}": F.coalesce(F.sum(x), F.lit(0)).cast("long") for x in self.sums}


CONTRACT: dict[str, Table] = {
    "dim_presentation": Table(OFFERING, never=("length_days < 1", "n_weeks * 7 < length_days or n_weeks * 7 - 7 >= length_days"), sums=("n_weeks",)),
    "dim_student": Table(["id_student"], never=("imd_band = '10-20'", "imd_unknown <> (imd_band = 'Unknown')")),
    "dim_assessment": Table(
        ["id_assessment"], nulls={"deadline_raw": "deadline_imputed"}, never=("is_first_weighted_tma and (zero_weight or assessment_type <> 'TMA')", "deadline_raw <> deadline"),
        rules={"deadline_imputed": "deadline_raw is null", "zero_weight": "weight = 0"}, flags=("assessment_type = 'TMA'", "assessment_type = 'CMA'", "assessment_type = 'Exam'"),
    ),
    "dim_vle_site": Table(["id_site"], nulls={"week_from": "not has_planned_week", "week_to": "not has_planned_week"}, never=("week_to < week_from",), rules={"has_planned_week": "week_from is not null", "never_clicked": "n_uses is null"}),
    "dim_week": Table(["week_no"], never=("day_from <> week_no * 7 or day_to <> week_no * 7 + 6",), rules={"day_from": "week_no * 7", "day_to": "week_no * 7 + 6", "is_pre_start": "week_no < 0"}),
    "fact_vle_daily": Table(
        [*ENROLMENT, "id_site", "date"], rules={"week_no": "int(floor(date / 7))", "is_pre_start": "week_no < 0"},
        never=("sum_click < 0 or n_records < 1",), flags=("n_records > 1",), sums=("sum_click", "n_records"),
    ),
    "fact_submission": Table(
        ["id_student", "id_assessment"], nulls={"score": "score_missing", "days_late": "is_banked", "is_pass_score": "score_missing"}, never=("is_late and is_banked", "is_late and days_late <= 0", "score < 0 or score > 100"),
        rules={
            "week_no": "int(floor(date_submitted / 7))", "is_beyond_course": "date_submitted > length_days", "score_missing": "score is null", "is_pass_score": f"score >= {PASS_SCORE}",
            "days_late": "case when not is_banked then date_submitted - deadline end", "is_late": "assessment_type = 'TMA' and coalesce(days_late, 0) > 0",
        },
    ),
    "fact_enrollment": Table(
        ENROLMENT, nulls={"date_registration": "reg_date_missing", "date_unregistration": ANYWHERE}, never=("no_vle_activity and total_clicks > 0", "withdrawn_before_start and date_unregistration > 0"),
        rules={
            "no_vle_activity": "clicks is null", "total_clicks": "coalesce(clicks, 0)", "active_days": "coalesce(days, 0)", "n_submissions": "coalesce(handed_in, 0)", "is_repeat": "num_of_prev_attempts > 0",
            "reg_date_missing": "date_registration is null", "withdrawn_before_start": "date_unregistration is not null and date_unregistration <= 0", "is_withdrawn": "final_result = 'Withdrawn'", "result_inconsistent": "is_withdrawn = (date_unregistration is null)",
        }, sums=("total_clicks",),
    ),
    "fact_student_week": Table(
        [*ENROLMENT, "week_no"], nulls={"avg_score_cum": ANYWHERE}, never=("clicks_week > clicks_cum", "n_late_cum > n_submitted_cum", "avg_score_cum is not null and n_submitted_cum = 0", "is_week_inactive and active_days_week > 0", "n_tma_missed_cum < 0"),
        rules={
            "is_pre_start": "week_no < 0", "is_week_inactive": "clicks_week = 0", "is_enrolled": "coalesce(date_unregistration > week_no * 7 + 6, true)", "avg_score_cum": "try_divide(points_cum, scored_cum)",
        }, sums=("clicks_week",), rising=("clicks_cum", "n_submitted_cum", "n_late_cum"), absent=("final_result",),
    ),
    "mart_weekly_activity": Table(
        [*OFFERING, "week_no", "activity_type"], nulls={"clicks_per_student": "enrolled_students = 0", "activity_clicks_per_student": "enrolled_students = 0", "activity_share": "week_clicks = 0"},
        never=("activity_share < 0 or activity_share > 1", "activity_clicks > week_clicks", "week_end_day <> week_start_day + 6", "average_rank < 1 or total_rank < 1"), sums=("activity_clicks",),
    ),
    "mart_student_pairs": Table(ENROLMENT, nulls={"rho": ANYWHERE}, never=("rho < -1.000001 or rho > 1.000001", "n < 1", "clicks_before < 0"), sums=("clicks_before",)),
}
#: (child, parent, key of the parent): every child row whose key is whole has a parent
LINKS = [("fact_vle_daily", "fact_enrollment", ENROLMENT), ("fact_vle_daily", "dim_vle_site", ["id_site"]), ("fact_submission", "dim_assessment", ["id_assessment"]), ("fact_enrollment", "dim_student", ["id_student"]), ("fact_enrollment", "dim_presentation", OFFERING), ("fact_student_week", "fact_enrollment", ENROLMENT)]
#: rows or sums that must be equal: name, then (table, metric) of each side; a raw table has its rows and sums
CONSERVED = [
    ("clicks are conserved", [("student_vle", "sum sum_click"), ("fact_vle_daily", "sum sum_click"), ("fact_enrollment", "sum total_clicks"), ("fact_student_week", "sum clicks_week")]),
    ("click records are conserved", [("student_vle", "rows"), ("fact_vle_daily", "sum n_records")]),
    ("every submission is kept", [("student_assessment", "rows"), ("fact_submission", "rows")]),
    ("every enrolment is kept", [("student_info", "rows"), ("fact_enrollment", "rows")]),
    ("every item is kept", [("assessments", "rows"), ("dim_assessment", "rows")]),
    ("every site is kept", [("vle", "rows"), ("dim_vle_site", "rows")]),
    ("every offering is kept", [("courses", "rows"), ("dim_presentation", "rows")]),
]
RAW_SUMS = {"student_vle": ("sum_click",)}

Metrics = dict[str, int]


def measured(name: str, df: DataFrame) -> Metrics:
    """The promises of a table by one aggregate over it."""
    df, promises = _with_falls(name, df)
    got = df.agg(*(c.alias(f"m{i}") for i, c in enumerate(promises.values()))).first()  # one row
    return dict(zip(promises, got))


def measured_raw(name: str, df: DataFrame) -> Metrics:
    sums = RAW_SUMS.get(name, ())
    got = df.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in sums)).first()
    return dict(zip(["rows", *(f"sum {c}" for c in sums)], got))


def write_raw(name: str, df: DataFrame, path: str) -> Metrics:
    """Overwrites a staging table; its rows and sums are observed as it is written."""
    seen, sums = Observation(), RAW_SUMS.get(name, ())
    df.observe(seen, F.count("*").alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"sum {c}") for c in sums)).write.mode("overwrite").parquet(path)
    got = seen.get
    return {k: got.get(k) or 0 for k in ["rows", *(f"sum {c}" for c in sums)]}


def _with_falls(name: str, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with a mark for each running total that falls, and all metrics. The window is that of the running totals."""
    table = CONTRACT[name]
    if found := [c for c in table.absent if c in df.columns]:
        raise GateError(f"{name} holds {', '.join(found)}")
    promises = table.promises(df)
    if table.rising:
        by = Window.partitionBy(*table.keys[:-1]).orderBy(table.keys[-1])
        df = df.withColumns({f"{c} falls": F.col(c) < F.lag(c).over(by) for c in table.rising})
        promises |= {f"broken rising: {c}": F.count_if(F.col(f"`{c} falls`")) for c in table.rising}
    return df, promises


def write_measured(name: str, df: DataFrame, path: str, by: tuple[str, list[str]] | None = None) -> Metrics:
    """Overwrites the table and returns its metrics, observed by the tasks that write it: the table isn't read again.

    ``by``: a column to partition by, and columns to range and sort the rows by within, so that row groups can be skipped.
    """
    columns = df.columns
    df, promises = _with_falls(name, df)
    if by:
        df = df.repartitionByRange(by[0], *by[1]).sortWithinPartitions(by[0], *by[1])
    seen = Observation()
    writer = df.observe(seen, *(c.alias(f"m{i}") for i, c in enumerate(promises.values()))).select(*columns).write.mode("overwrite")
    (writer.partitionBy(by[0]) if by else writer).parquet(path)
    got = seen.get
    return {k: got.get(f"m{i}") or 0 for i, k in enumerate(promises)}


def faults(metrics: Mapping[str, Metrics], expected: Mapping[tuple[str, str], int] | None = None) -> dict[str, int]:
    """check -> how far off, over all tables: broken promises, totals that differ, and ``expected`` metrics that are not met.

    ``expected``: (table, metric) -> value, for data whose counts are known beforehand.
    """
    out = {}
    for name, own in metrics.items():
        out |= {f"{name}: {k.removeprefix('broken ')}": n for k, n in own.items() if k.startswith("broken ")}
    for check, sides in CONSERVED:
        values = [metrics[t][m] for t, m in sides if t in metrics]
        out[check] = max(values, default=0) - min(values, default=0)
    for (name, metric), value in (expected or {}).items():
        out[f"{name}: {metric} is {value}"] = abs(metrics[name][metric] - value)
    return out


def contract_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, metric, n): every metric of every table, one aggregate for each table."""
    parts = []
    for name, df in tables.items():
        df, promises = _with_falls(name, df)
        sums = df.agg(*(c.cast("long").alias(f"m{i}") for i, c in enumerate(promises.values())))
        pairs = ", ".join(f"{_quoted(k)}, m{i}" for i, k in enumerate(promises))
        parts.append(sums.selectExpr(f"{_quoted(name)} as table_name", f"stack({len(promises)}, {pairs}) as (metric, n)"))
    return reduce(DataFrame.unionByName, parts)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def relations(tables: Mapping[str, DataFrame], first_week: int) -> DataFrame:
    """(check_name, n_failures) of all keys, all links and the snapshot's weeks, with one scan of each table.

    Each row gives its own key and the keys it points to, marked with the check they belong to; one grouping by check and
    key counts both sides, summed before the shuffle. The snapshot is whole if no row repeats its key, each lies in a
    week of its offering, and it has as many rows as its enrolments have weeks.
    """
    marks: dict[str, list[tuple[str, list[str], bool]]] = {name: [(f"{name}: key is unique", CONTRACT[name].keys, False)] for name in tables}
    for child, parent, keys in LINKS:
        marks[child].append((f"{child} -> {parent}", keys, False))
        marks[parent].append((f"{child} -> {parent}", keys, True))
    inside, whole = "fact_student_week: weeks of the course", "snapshot grid is whole"
    marks["fact_student_week"].append((inside, [*OFFERING, "week_no"], False))
    weeks = tables["dim_presentation"].where(F.col("n_weeks") > first_week).select(*OFFERING, F.explode(F.sequence(F.lit(first_week), F.col("n_weeks") - 1)).alias("week_no"))

    def keyed(df: DataFrame, own: list[tuple[str, list[str], bool]]) -> DataFrame:
        part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
        entries = [F.struct(F.lit(check).alias("check_name"), F.concat_ws("\u0001", *map(part, keys)).alias("key"), reduce(Column.__or__, (F.col(k).isNull() for k in keys)).alias("open"), F.lit(int(parent)).alias("parents"), F.lit(int(not parent)).alias("children")) for check, keys, parent in own]
        return df.select(F.inline(F.array(*entries)))

    rows = reduce(DataFrame.unionByName, [*(keyed(tables[name], own) for name, own in marks.items()), keyed(weeks, [(inside, [*OFFERING, "week_no"], True)])])
    by = rows.groupBy("check_name", "key", "open").agg(F.sum("parents").alias("parents"), F.sum("children").alias("children"))
    unique = F.col("check_name").endswith(": key is unique")
    wrong = F.when(unique, F.when(F.col("children") > 1, F.col("children") - 1).otherwise(0)).when((F.col("parents") == 0) & ~F.col("open"), F.col("children")).otherwise(0)
    got = by.groupBy("check_name").agg(F.sum(wrong).alias("n_failures"))
    span = tables["fact_enrollment"].groupBy(*OFFERING).agg(F.count("*").alias("n")).join(tables["dim_presentation"], OFFERING)
    due = span.agg(F.coalesce(F.sum(F.col("n") * F.greatest(F.col("n_weeks") - first_week, F.lit(0))), F.lit(0)).alias("due"))
    grid = tables["fact_student_week"].agg(F.count("*").alias("n")).crossJoin(due).select(F.lit(whole).alias("check_name"), F.abs(F.col("n") - F.col("due")).alias("n_failures"))
    return got.unionByName(grid)


def as_report(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "check_name string, n_failures long")
