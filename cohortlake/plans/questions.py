"""Twenty sample questions, each with one small answer; places and weeks are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.columns import count_where, enrolled_at, percent
from . import reports as R
from .warehouse import OFFERING, Warehouse


def q01(w: Warehouse) -> DataFrame:
    return w.fact_enrollment.agg(F.count("*").alias("n_enrollments"), F.count_distinct("id_student").alias("n_students"))


def q02(w: Warehouse) -> DataFrame:
    return S.share_of_total(w.fact_enrollment, ["final_result"], F.count("*"), "n", "pct").drop("total")


def q03(w: Warehouse) -> DataFrame:
    return w.fact_enrollment.groupBy(*OFFERING).agg(F.count("*").alias("n_enrollments")).orderBy(F.desc("n_enrollments"), *OFFERING).limit(1)


def q04(w: Warehouse) -> DataFrame:
    n = F.count_if("no_vle_activity")
    return w.fact_enrollment.agg(n.alias("n_without_clicks"), percent(n, F.count("*")).alias("pct"))


def q05(w: Warehouse, id_assessment: int) -> DataFrame:
    """Submission rate of one assessment; students who banked it leave the denominator."""
    item = w.dim_assessment.where(F.col("id_assessment") == id_assessment).select(*OFFERING, "deadline")
    rows = w.fact_submission.where(F.col("id_assessment") == id_assessment)
    eligible = w.fact_enrollment.join(item, OFFERING).where(enrolled_at(F.col("date_unregistration"), F.col("deadline")))
    eligible = eligible.join(rows.where("is_banked").select("id_student"), "id_student", "left_anti")
    got = eligible.join(rows.where("not is_banked").select("id_student", F.lit(True).alias("done")), "id_student", "left")
    return got.agg(F.count("*").alias("n_eligible"), F.count("done").alias("n_submitted"), percent(F.count("done"), F.count("*")).alias("pct"))


def q06(w: Warehouse, module: str, presentation: str) -> DataFrame:
    rows = R.at(R._regular_tma(w), module, presentation).groupBy("id_assessment").agg(percent(F.count_if("is_late"), F.count("*")).alias("pct_late"))
    got = rows.join(w.dim_assessment.select("id_assessment", "deadline"), "id_assessment")
    return got.orderBy(F.desc("pct_late"), "id_assessment").limit(1)


def q07(w: Warehouse) -> DataFrame:
    return R._regular_tma(w).agg(F.count_if("is_late").alias("n_late"), percent(F.count_if("is_late"), F.count("*")).alias("pct"))


def q08(w: Warehouse) -> DataFrame:
    return R._regular_tma(w).groupBy("code_module").agg(F.avg("score").alias("avg_score"))


def q09(w: Warehouse) -> DataFrame:
    got = S.share_of_total(R.clicks_by_type(w).withColumnRenamed("total_clicks", "n"), ["activity_type"], F.sum("n"), "clicks", "pct")
    return got.orderBy(F.desc("clicks"), "activity_type").limit(1)


q10 = R.top_week


def q11(w: Warehouse, module: str, presentation: str, week: int) -> DataFrame:
    rows = R.at(w.fact_student_week, module, presentation).where((F.col("week_no") == week) & F.col("is_enrolled"))
    return rows.agg(F.count("*").alias("n_enrolled"), F.coalesce(F.sum("clicks_week"), F.lit(0)).alias("total_clicks"), F.avg("clicks_week").alias("clicks_per_student"))


def q12(w: Warehouse) -> DataFrame:
    """Offerings with and without a first weighted TMA, the latter listed in order."""
    first = w.dim_assessment.where("is_first_weighted_tma").select(*OFFERING, F.lit(True).alias("found"))
    rows = w.dim_presentation.select(*OFFERING).join(first, OFFERING, "left")
    missing = F.expr("listagg(case when found is null then concat_ws(' ', code_module, code_presentation) end, ', ') within group (order by code_module, code_presentation)")
    return rows.agg(F.count("found").alias("n_with"), count_where(F.col("found").isNull()).alias("n_without"), missing.alias("without_list"))


def q13(w: Warehouse, module: str, presentation: str) -> DataFrame:
    return R.at(R.spearman(w), module, presentation).select("n", "rho")


def q14(w: Warehouse, week: int) -> DataFrame:
    return R.risk_eval(w, [week]).select("n_active", "n_flagged", "precision_pct", "base_rate_pct")


def q15(w: Warehouse) -> DataFrame:
    early = count_where(F.col("date_unregistration") <= 0)
    return w.fact_enrollment.where("is_withdrawn").agg(early.alias("n_by_day_0"), F.count("*").alias("n_withdrawn"), percent(early, F.count("*")).alias("pct"))


def q16(w: Warehouse) -> DataFrame:
    return w.fact_enrollment.where("is_withdrawn and date_unregistration is not null").agg(F.count("*").alias("n_dated"), F.median("date_unregistration").alias("median_day"))


def q17(w: Warehouse) -> DataFrame:
    rate = percent(F.count_if("is_withdrawn"), F.count("*"))
    return w.fact_enrollment.groupBy(*OFFERING).agg(rate.alias("pct_withdrawn")).orderBy(F.desc("pct_withdrawn"), *OFFERING).limit(1)


def q18(w: Warehouse, presentation: str, modules: list[str], least: int) -> DataFrame:
    return R.band_gap(w, least, [presentation], modules).select("code_presentation", "passed_rate_low", "passed_rate_high", "passed_gap")


def q19(w: Warehouse, module: str, presentation: str, week: int) -> DataFrame:
    rows = R.at(w.fact_student_week, module, presentation).where((F.col("week_no") == week) & F.col("is_enrolled"))
    return rows.agg(F.count("*").alias("n_enrolled"), F.median("clicks_cum").alias("median_clicks"))


q20 = R.activity_quartiles
