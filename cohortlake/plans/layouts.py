"""Physical layouts of the same warehouse: star, partly normalised, wide; nested timelines and documents; marts."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, percent
from ..functions import stats as S
from ..operators.quality import key_report
from ..operators.relational import replicate
from ..sources.files import write_bucketed, write_partitioned
from ..sources.scans import run_scanned
from .contract import CONTRACT
from .reports import passed, risk_eval
from .warehouse import ENROLMENT, OFFERING, Warehouse, item_facts, with_rules

#: what follows from a fact's item or site (the offering) and from the rules of its contract
DERIVED = {name: [*OFFERING, *CONTRACT[name].rules] for name in ("fact_submission", "fact_vle_daily")}


class Built(Mapping):
    """Tables by name, each built when first asked for: a staged warehouse computes and writes what a builder touches."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]) -> None:
        self.builders, self.built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = self.builders[name]()
        return self.built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.builders)

    def __len__(self) -> int:
        return len(self.builders)


def normalised(w: Warehouse) -> Mapping[str, DataFrame]:
    """The facts without what can be derived: no offering, which the item or the site has, and no rule's column."""
    return Built({name: lambda name=name, columns=columns: getattr(w, name).drop(*columns) for name, columns in DERIVED.items()})


def restored_submission(stored: DataFrame, assessment: DataFrame, presentation: DataFrame) -> DataFrame:
    """The dropped columns again: the offering by the item, the others by the rules that made them."""
    return with_rules(stored.join(item_facts(assessment, presentation), "id_assessment"))


def restored_clicks(stored: DataFrame, site: DataFrame) -> DataFrame:
    """The offering by the site, the week by the day."""
    return CONTRACT["fact_vle_daily"].derive(stored.join(site.select("id_site", *OFFERING), "id_site"))


def wide(w: Warehouse) -> Mapping[str, DataFrame]:
    """Facts with the columns of their dimensions; the snapshot gets no outcome."""

    def about(fact: DataFrame) -> DataFrame:
        offering = w.dim_presentation.select(*OFFERING, "year", "semester", "length_days", "n_weeks")
        return fact.join(offering, OFFERING, "left").join(w.dim_student.drop("imd_unknown"), "id_student", "left")

    item = lambda: w.dim_assessment.select("id_assessment", "assessment_type", "deadline", "weight", "is_first_weighted_tma")
    site = lambda: w.dim_vle_site.select("id_site", "activity_type", "week_from")
    return Built({
        "wide_enrollment": lambda: about(w.fact_enrollment),
        "wide_submission": lambda: about(w.fact_submission.join(item(), "id_assessment", "left")),
        "wide_clicks": lambda: about(w.fact_vle_daily.join(site(), "id_site", "left")),
        "wide_student_week": lambda: about(w.fact_student_week),
        "wide_presentation": lambda: w.dim_presentation,
    })


def validate(source: DataFrame, built: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Row count as the source, grain unique, not empty."""
    n = source.agg(F.count("*").alias("n_source"))
    return key_report(built, keys, name).crossJoin(n).withColumn("is_whole", (F.col("n_rows") == F.col("n_source")) & (F.col("n_rows") > 0)).drop("n_source")


class Layout:
    """Where the four benchmark workloads read from, each part built when first asked for; the answers are the same for every layout."""

    def __init__(self, submissions: Callable[[], DataFrame], clicks: Callable[[], DataFrame], snapshot: Callable[[], Warehouse], enrolments: Callable[[], DataFrame]) -> None:
        self._submissions, self._clicks, self._snapshot, self._enrolments = submissions, clicks, snapshot, enrolments

    @cached_property
    def submissions(self) -> DataFrame:
        """With assessment_type."""
        return self._submissions()

    @cached_property
    def clicks(self) -> DataFrame:
        """With activity_type."""
        return self._clicks()

    @cached_property
    def snapshot(self) -> Warehouse:
        return self._snapshot()

    @cached_property
    def enrolments(self) -> DataFrame:
        """With imd_band."""
        return self._enrolments()


def _with(w: Warehouse, **tables: DataFrame) -> Warehouse:
    """The warehouse with other tables in the place of its own."""
    own = copy.copy(w)
    for name, df in tables.items():
        setattr(own, name, df)
    return own


def store_layouts(w: Warehouse, path: str) -> Warehouse:
    """The warehouse with its wide tables and partly normalised facts stored under ``path``; :func:`layout` reads those."""
    own = copy.copy(w)
    own.stored = {}
    for kind, tables in {"wide": wide(w), "norm": normalised(w)}.items():
        for name, df in tables.items():
            if name == "wide_student_week":
                write_partitioned(df, f"{path}/{kind}/{name}", "week_no", [*OFFERING, "id_student"])
            else:
                df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
        own.stored[kind] = {name: w.spark.read.parquet(f"{path}/{kind}/{name}") for name in tables}
    return own


def layout(w: Warehouse, kind: str) -> Layout:
    """``star``, ``norm`` or ``wide``; of a warehouse with stored layouts the stored tables."""
    stored_tables = getattr(w, "stored", {})
    if kind == "wide":
        tables = stored_tables.get("wide") or wide(w)
        part = lambda name: lambda: tables[name]
        return Layout(part("wide_submission"), part("wide_clicks"), lambda: _with(w, fact_student_week=tables["wide_student_week"]), part("wide_enrollment"))
    if kind == "norm":
        stored = stored_tables.get("norm") or normalised(w)
        submission, clicks = lambda: restored_submission(stored["fact_submission"], w.dim_assessment, w.dim_presentation), lambda: restored_clicks(stored["fact_vle_daily"], w.dim_vle_site)
    elif kind == "star":
        submission, clicks = lambda: w.fact_submission, lambda: w.fact_vle_daily
    else:
        raise ValueError(f"no layout {kind}")
    return Layout(
        lambda: submission().join(w.dim_assessment.select("id_assessment", "assessment_type"), "id_assessment"),
        lambda: clicks().join(w.dim_vle_site.select("id_site", "activity_type"), "id_site"),
        lambda: _with(w, fact_submission=submission(), fact_vle_daily=clicks()),
        lambda: w.fact_enrollment.join(w.dim_student.select("id_student", "imd_band"), "id_student"),
    )


def bench_q07(x: Layout) -> DataFrame:
    rows = x.submissions.where("assessment_type = 'TMA' and not is_banked")
    return rows.agg(F.count_if("is_late").alias("n_late"), percent(F.count_if("is_late"), F.count("*")).alias("pct"))


def bench_q09(x: Layout) -> DataFrame:
    return S.share_of_total(x.clicks, ["activity_type"], F.sum("sum_click"), "clicks", "pct")


def bench_q14(x: Layout, week: int) -> DataFrame:
    return risk_eval(x.snapshot, [week])


def bench_q18(x: Layout, presentation: str, least: int) -> DataFrame:
    """As the report, but the gap is of the rounded rates."""
    rows = x.enrolments.where((F.col("code_presentation") == presentation) & ~F.col("withdrawn_before_start") & F.col("imd_band").isin("0-10%", "90-100%"))
    by = rows.groupBy("imd_band").agg(F.count_distinct("id_student").alias("n"), percent(count_where(passed()), F.count("*")).alias("rate"))
    by = by.withColumn("rate", S.suppressed(F.col("rate"), F.col("n"), least))
    side = lambda b: F.max(F.when(F.col("imd_band") == b, F.col("rate")))
    return by.agg(side("0-10%").alias("rate_low"), side("90-100%").alias("rate_high"), F.round(F.abs(side("90-100%") - side("0-10%")), 6).alias("gap"))


# ---- stored layouts ----


def snapshot_layouts(w: Warehouse, path: str, buckets: int = 8) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The snapshot and the enrolments, stored in four ways: plain, a directory for each week, ranged and sorted by
    offering and student, and in buckets by enrolment. Each is (snapshot, enrolments)."""
    week, people, spark = w.fact_student_week, w.fact_enrollment, w.spark
    week.write.parquet(f"{path}/plain")
    people.write.parquet(f"{path}/people")
    write_partitioned(week, f"{path}/partitioned", "week_no", [*OFFERING, "id_student"])
    week.repartitionByRange(buckets, *OFFERING, "id_student").sortWithinPartitions(*OFFERING, "id_student").write.parquet(f"{path}/sorted")
    plain = spark.read.parquet(f"{path}/people")
    out = {name: (spark.read.parquet(f"{path}/{name}"), plain) for name in ("plain", "partitioned", "sorted")}
    tag = path.rstrip("/").rsplit("-", 1)[-1][:16]
    return out | {"bucketed": tuple(write_bucketed(df, f"{name}_{tag}", f"{path}/bucketed_{name}", ENROLMENT, buckets) for name, df in (("week", week), ("people", people)))}


def by_outcome(week: DataFrame, people: DataFrame, weeks: list[int], module: str) -> DataFrame:
    """Clicks of some weeks of a module by outcome: a filter on both, and a join by enrolment."""
    rows = week.where(F.col("week_no").isin(weeks) & (F.col("code_module") == module)).select(*ENROLMENT, "clicks_week")
    return rows.join(people.select(*ENROLMENT, "final_result").hint("merge"), ENROLMENT).groupBy("final_result").agg(F.sum("clicks_week").alias("clicks"), F.count("*").alias("n"))


def layout_effect(w: Warehouse, path: str, weeks: list[int], module: str) -> DataFrame:
    """(layout, final_result, clicks, n, files_read, bytes_read, rows_read, partitions_read, shuffles_to_join): the same question
    to each layout, what its scans read by their own metrics, and how many shuffles its join took (that of the grouping isn't counted)."""
    rows = []
    for name, (week, people) in snapshot_layouts(w, path).items():
        got, seen = run_scanned(by_outcome(week, people, weeks, module))  # a row for each outcome
        rows += [(name, r.final_result, r.clicks, r.n, seen.files, seen.bytes, seen.rows, seen.partitions, seen.exchanges - 1) for r in got]
    return w.spark.createDataFrame(rows, "layout string, final_result string, clicks long, n long, files_read long, bytes_read long, rows_read long, partitions_read long, shuffles_to_join long")


def scaled(w: Warehouse, factor: int, offset: int = 10_000_000) -> Warehouse:
    """``factor`` copies of all that belongs to students, moved by ``offset`` each; items, sites and offerings stay."""
    own = copy.copy(w)
    for name in Warehouse.TABLES:
        df = getattr(w, name)
        setattr(own, name, replicate(df, factor, "id_student", offset) if "id_student" in df.columns else df)
    return own


def scaled_answers(w: Warehouse, factors: list[int], presentation: str) -> DataFrame:
    """(workload, layout, factor, measure, value): answers of the workloads in whole numbers, on each layout and scale.

    Counts are divided by the factor, rates are in tenths of a percent, so that all rows of a measure must be equal.
    """
    parts = []
    tenths = lambda c: F.round(F.col(c) * 10).cast("long")
    for factor in factors:
        big = scaled(w, factor)
        for kind in ("star", "norm", "wide"):
            x = layout(big, kind)
            share = (F.col("clicks") / factor).cast("long")
            answers = {
                "q07": bench_q07(x).select(F.explode(F.create_map(F.lit("late"), (F.col("n_late") / factor).cast("long"), F.lit("pct"), tenths("pct"))).alias("measure", "value")),
                "q09": bench_q09(x).select(F.explode(F.create_map(F.concat(F.lit("clicks "), "activity_type"), share, F.concat(F.lit("pct "), "activity_type"), tenths("pct"))).alias("measure", "value")),
                "q18": bench_q18(x, presentation, 20 * factor).select(F.explode(F.create_map(F.lit("low"), tenths("rate_low"), F.lit("high"), tenths("rate_high"))).alias("measure", "value")),
            }
            parts += [df.select(F.lit(q).alias("workload"), F.lit(kind).alias("layout"), F.lit(factor).cast("long").alias("factor"), "measure", "value") for q, df in answers.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- nested timelines and documents ----

_WEEK = ["week_no", "clicks_week", "clicks_cum", "avg_score_cum", "n_tma_missed_cum", "is_enrolled"]
_DOCUMENT = "struct<weeks: array<struct<week_no: int, clicks_week: bigint, clicks_cum: bigint, avg_score_cum: double, n_tma_missed_cum: bigint, is_enrolled: boolean>>>"


def nested_timeline(w: Warehouse) -> DataFrame:
    """A row for each enrolment with its weeks as an ordered array."""
    return w.fact_student_week.groupBy(*ENROLMENT).agg(F.array_sort(F.collect_list(F.struct(*_WEEK))).alias("weeks"))


def unnest(nested: DataFrame) -> DataFrame:
    return nested.select(*ENROLMENT, F.inline("weeks"))


def nested_previous_week(nested: DataFrame, week: int) -> DataFrame:
    """Clicks of a week and of the one before, looked up inside the array."""
    pick = lambda k: F.element_at(F.filter("weeks", lambda x: x["week_no"] == k), 1)
    there = nested.where(F.exists("weeks", lambda x: x["week_no"] == week))
    before = F.when(F.exists("weeks", lambda x: x["week_no"] == week - 1), pick(week - 1)["clicks_week"])
    return there.select(*ENROLMENT, pick(week)["clicks_week"].alias("clicks_week"), F.coalesce(before, F.lit(0)).alias("clicks_before_week"))


def documents(w: Warehouse) -> DataFrame:
    """(enrolment, document): the timeline as a JSON text {"weeks": [...]}."""
    return nested_timeline(w).select(*ENROLMENT, F.to_json(F.struct("weeks")).alias("document"))


def document_rows(docs: DataFrame) -> DataFrame:
    return docs.select(*ENROLMENT, F.inline(F.from_json("document", _DOCUMENT)["weeks"]))


def week_crosscut(rows: DataFrame, week: int) -> DataFrame:
    """Per offering: enrolled students and their mean clicks in one week, from any form of the timeline."""
    got = rows.where((F.col("week_no") == week) & F.col("is_enrolled"))
    return got.groupBy(*OFFERING).agg(F.count("*").alias("n_enrolled"), F.sum("clicks_week").alias("clicks"), F.avg("clicks_cum").alias("avg_clicks_cum"))


def stamped(mart: DataFrame) -> DataFrame:
    """A mart with the time it was made."""
    return mart.withColumn("mart_created_at", F.current_timestamp())
