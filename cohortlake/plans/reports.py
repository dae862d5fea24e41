"""Reports over the warehouse: each a function of tables and parameters that returns a lazy DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.columns import PASSED, UNSUCCESSFUL, count_where, enrolled_at, half_up, last_day, offering_label, percent, percentile_band, risk_level, week_of
from ..operators import sketches
from ..operators.ranking import exact_quantiles, with_average_rank, with_percent_rank
from ..operators.relational import latest_by_key, period_grid, previous_value
from ..sources.files import written
from .warehouse import ENROLMENT, OFFERING, Warehouse

passed = lambda: F.col("final_result").isin(*PASSED)
failed = lambda: F.col("final_result").isin(*UNSUCCESSFUL)


def at(df: DataFrame, module: str, presentation: str) -> DataFrame:
    """One offering; literals, so that the filter reaches the scan."""
    return df.where((F.col("code_module") == module) & (F.col("code_presentation") == presentation))


# ---- overview ----


def overall_stats(w: Warehouse) -> DataFrame:
    one = lambda df, name, c=None: df.agg((F.count("*") if c is None else c).alias(name))
    parts = [
        one(w.dim_presentation, "n_offerings"), one(w.fact_enrollment, "n_enrollments"), one(w.fact_enrollment, "n_students", F.count_distinct("id_student")),
        one(w.fact_submission, "n_submissions"), one(w.fact_vle_daily, "total_clicks", F.sum("sum_click")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def offering_labels(w: Warehouse) -> DataFrame:
    return w.fact_enrollment.select(*OFFERING).distinct().withColumn("label", offering_label(F.col("code_module"), F.col("code_presentation")))


def overview(w: Warehouse) -> DataFrame:
    """A row for each offering and one (codes null) for the school, people counted anew for it."""
    sums = {"n_enrollments": F.count("*"), "n_students": F.count_distinct("id_student"), "n_passed": count_where(passed()), "n_distinction": count_where(F.col("final_result") == "Distinction"), "n_failed": count_where(F.col("final_result") == "Fail"), "n_withdrawn": count_where(F.col("final_result") == "Withdrawn"), "n_no_vle_activity": count_where(F.col("no_vle_activity")), "total_clicks": F.sum("total_clicks")}
    return w.fact_enrollment.groupingSets([OFFERING, []], *OFFERING).agg(*(c.alias(k) for k, c in sums.items()))


def overview_rates(w: Warehouse) -> DataFrame:
    n = F.col("n_enrollments")
    got = overview(w).where("code_module is not null")
    return got.select(*OFFERING, percent(F.col("n_passed"), n, None).alias("pass_rate"), percent(F.col("n_withdrawn"), n, None).alias("withdrawal_rate"), F.try_divide(F.col("total_clicks").cast("double"), n).alias("clicks_per_enrollment"))


def attention_list(w: Warehouse, k: int = 3) -> DataFrame:
    """The k offerings with the most withdrawals and the k with the fewest passes, by rate."""
    rates = overview_rates(w)
    pick = lambda name, rate, order: rates.orderBy(order, *OFFERING).limit(k).select(F.lit(name).alias("list_name"), *OFFERING, F.col(rate).alias("rate"))
    return pick("withdrawal", "withdrawal_rate", F.desc("withdrawal_rate")).unionByName(pick("pass", "pass_rate", F.asc("pass_rate")))


# ---- submissions and scores ----


def _active_at_deadline(w: Warehouse, items: DataFrame) -> DataFrame:
    pairs = w.fact_enrollment.join(items.select("id_assessment", *OFFERING, "deadline"), OFFERING)
    return pairs.where(enrolled_at(F.col("date_unregistration"), F.col("deadline"))).groupBy("id_assessment").agg(F.count_distinct("id_student").alias("active_students"))


def _submitted(w: Warehouse, items: DataFrame) -> DataFrame:
    who = F.col("id_student")
    people = lambda c: F.count_distinct(F.when(c, who))
    banked = F.col("is_banked")
    return w.fact_submission.join(items.select("id_assessment"), "id_assessment").groupBy("id_assessment").agg(
        F.count_distinct(who).alias("submitted_total"), people(~banked).alias("submitted_regular"), people(banked).alias("banked_students"), people(F.col("is_late")).alias("late_submissions"), people(F.col("is_pass_score")).alias("passed_students"),
        count_where(F.col("is_pass_score")).alias("n_pass_scores"), F.count("score").alias("n_scores"), F.avg("score").alias("avg_score"), *S.quartiles("score", ["p25_score", "median_score", "p75_score"]), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
    )


def assessment_stats(w: Warehouse, module: str, presentation: str) -> DataFrame:
    """Submission and late rates per assessment; banked students stay in the denominator."""
    items = at(w.dim_assessment, module, presentation)
    got = items.join(_active_at_deadline(w, items), "id_assessment", "left").join(_submitted(w, items), "id_assessment", "left").fillna(0, ["active_students", "submitted_regular", "banked_students", "late_submissions"])
    late = F.when(F.col("assessment_type") == "TMA", F.coalesce(percent(F.col("late_submissions"), F.col("submitted_regular")), F.lit(0.0))).otherwise(0.0)
    return got.select(
        "id_assessment", F.concat_ws(" ", "assessment_type", F.col("id_assessment").cast("string")).alias("assessment_label"), "assessment_order", "deadline", "weight", "is_first_weighted_tma", "active_students", "submitted_regular", "banked_students", "late_submissions",
        F.coalesce(percent(F.col("submitted_regular"), F.col("active_students")), F.lit(0.0)).alias("submission_rate_pct"), late.alias("late_rate_pct"), "p25_score", "median_score", "p75_score", percent(F.col("n_pass_scores"), F.col("n_scores")).alias("pass_rate_pct"),
    )


def assessment_detail(w: Warehouse, module: str, presentation: str) -> DataFrame:
    items = at(w.dim_assessment, module, presentation)
    got = items.join(_active_at_deadline(w, items), "id_assessment", "left").join(_submitted(w, items), "id_assessment", "left")
    return got.select(
        "id_assessment", "assessment_type", "assessment_order", "deadline", "active_students", "submitted_total", "banked_students", "late_submissions", percent(F.col("submitted_total"), F.col("active_students")).alias("submission_rate_pct"), percent(F.col("late_submissions"), F.col("submitted_regular")).alias("late_rate_pct"),
        percent(F.col("passed_students"), F.col("submitted_total") - F.col("banked_students")).alias("pass_rate_pct"), "avg_score", "median_score", F.col("p25_score").alias("q1_score"), F.col("p75_score").alias("q3_score"), "min_score", "max_score",
    )


def assessment_summary(w: Warehouse, id_assessment: int) -> DataFrame:
    items = w.dim_assessment.where(F.col("id_assessment") == id_assessment)
    rows = w.fact_submission.where(F.col("id_assessment") == id_assessment)
    got = rows.agg(F.count_distinct("id_student").alias("n_submitted"), count_where(F.col("is_late")).alias("n_late"), count_where(~F.col("is_banked")).alias("n_regular"), F.median("score").alias("median_score"))
    active = _active_at_deadline(w, items).agg(F.coalesce(F.sum("active_students"), F.lit(0)).alias("active_students"))
    return got.crossJoin(active).select(F.lit(id_assessment).alias("id_assessment"), "n_submitted", "active_students", percent(F.col("n_submitted"), F.col("active_students")).alias("submission_rate_pct"), percent(F.col("n_late"), F.col("n_regular")).alias("late_rate_pct"), "median_score")


def assessment_scores(w: Warehouse, module: str, presentation: str) -> DataFrame:
    rows = at(w.fact_submission, module, presentation).where("score is not null").join(w.dim_assessment.select("id_assessment", "assessment_type", "deadline"), "id_assessment")
    return rows.select("id_student", F.concat_ws(" ", "assessment_type", F.col("id_assessment").cast("string")).alias("assessment_label"), "deadline", "score")


def assessment_kpis(w: Warehouse, module: str, presentation: str) -> DataFrame:
    """Means of rates and the median of medians over an offering's assessments."""
    got = assessment_stats(w, module, presentation)
    return got.agg(F.count("*").alias("n_assessments"), F.avg("submission_rate_pct").alias("mean_submission_rate"), F.avg("late_rate_pct").alias("mean_late_rate"), F.median("median_score").alias("median_of_medians"))


def _regular_tma(w: Warehouse) -> DataFrame:
    return w.fact_submission.where("not is_banked").join(w.dim_assessment.where("assessment_type = 'TMA'").select("id_assessment"), "id_assessment")


def module_scores(w: Warehouse) -> DataFrame:
    """TMA submissions per module, with marks at the best and the worst mean score."""
    got = _regular_tma(w).groupBy("code_module").agg(F.count("*").alias("n_tma_submissions"), F.count_if("is_late").alias("n_late"), F.count("score").alias("n_scored"), F.avg("score").alias("avg_score"))
    ends = got.agg(F.max_by("code_module", F.struct("avg_score", "code_module")).alias("best"), F.min_by("code_module", F.struct("avg_score", "code_module")).alias("worst"))
    return got.crossJoin(F.broadcast(ends)).select("code_module", "n_tma_submissions", "n_late", "n_scored", "avg_score", (F.col("code_module") == F.col("best")).alias("is_best"), (F.col("code_module") == F.col("worst")).alias("is_worst"))


def submission_overview(w: Warehouse) -> DataFrame:
    rows = w.fact_submission.join(w.dim_assessment.where("assessment_type in ('TMA', 'CMA')").select("id_assessment"), "id_assessment")
    return rows.groupBy(*OFFERING).agg(F.count_distinct("id_assessment").alias("n_assessments"), F.count("*").alias("n_submissions"), F.count_if("is_late").alias("n_late"), percent(F.count_if("is_late"), count_where(~F.col("is_banked"))).alias("late_rate_pct"), F.avg("score").alias("avg_score"), F.median("score").alias("median_score"))


# ---- activity ----


def _with_type(w: Warehouse, clicks: DataFrame) -> DataFrame:
    return clicks.join(w.dim_vle_site.select("id_site", *OFFERING, "activity_type"), ["id_site", *OFFERING])


def enrolled_by_week(w: Warehouse) -> DataFrame:
    """Enrolled at the end of each course week from week 0, zero weeks included."""
    calendar = period_grid(w.dim_presentation.select(*OFFERING, "n_weeks"), 0, F.col("n_weeks") - 1)
    left = w.fact_enrollment.groupBy(*OFFERING, "date_unregistration").agg(F.count("*").alias("n"))
    rows = calendar.join(left, OFFERING, "left")
    stays = enrolled_at(F.col("date_unregistration"), last_day(F.col("week_no")))
    return rows.groupBy(*OFFERING, "week_no").agg(F.coalesce(F.sum(F.when(stays, F.col("n"))), F.lit(0)).alias("enrolled_students"))


def weekly_activity(w: Warehouse) -> DataFrame:
    """Offering x week x activity type: clicks of enrolled students, shares, and two ranks of the weeks."""
    week = F.col("week_no")
    daily = w.fact_vle_daily.where("not is_pre_start").join(w.fact_enrollment.select(*ENROLMENT, "date_unregistration"), ENROLMENT)
    daily = daily.where(enrolled_at(F.col("date_unregistration"), last_day(week)))
    typed = _with_type(w, daily).groupBy(*OFFERING, "week_no", "activity_type").agg(F.sum("sum_click").alias("activity_clicks"))
    weeks = enrolled_by_week(w).join(typed.groupBy(*OFFERING, "week_no").agg(F.sum("activity_clicks").alias("week_clicks")), [*OFFERING, "week_no"], "left").fillna(0, ["week_clicks"])
    weeks = weeks.withColumn("clicks_per_student", F.try_divide(F.col("week_clicks").cast("double"), F.col("enrolled_students")))
    by = Window.partitionBy(*OFFERING)
    weeks = weeks.withColumn("average_rank", F.rank().over(by.orderBy(F.col("clicks_per_student").desc_nulls_last()))).withColumn("total_rank", F.rank().over(by.orderBy(F.col("week_clicks").desc())))
    types = w.dim_vle_site.select("activity_type").where("activity_type is not null").distinct()
    grid = weeks.crossJoin(types).join(typed, [*OFFERING, "week_no", "activity_type"], "left").fillna(0, ["activity_clicks"])
    clicks = F.col("activity_clicks").cast("double")
    return grid.select(
        *OFFERING, "week_no", "activity_type", (week * 7).alias("week_start_day"), last_day(week).alias("week_end_day"), "enrolled_students", "week_clicks", "clicks_per_student", "activity_clicks",
        F.try_divide(clicks, F.col("enrolled_students")).alias("activity_clicks_per_student"), F.try_divide(clicks, F.col("week_clicks")).alias("activity_share"), "average_rank", "total_rank",
    )


def clicks_by_week_type(w: Warehouse) -> DataFrame:
    """School totals: all clicks, before the start too."""
    return _with_type(w, w.fact_vle_daily).groupBy("week_no", "activity_type").agg(F.sum("sum_click").alias("total_clicks"))


def clicks_by_type(w: Warehouse) -> DataFrame:
    return _with_type(w, w.fact_vle_daily).groupBy("activity_type").agg(F.sum("sum_click").alias("total_clicks"), F.count_distinct("id_site").alias("n_sites"))


def top_week(w: Warehouse) -> DataFrame:
    return w.fact_vle_daily.groupBy("week_no").agg(F.sum("sum_click").alias("total_clicks")).orderBy(F.desc("total_clicks"), "week_no").limit(1)


def deadline_weeks(w: Warehouse, module: str, presentation: str) -> DataFrame:
    return at(w.dim_assessment, module, presentation).where("assessment_type = 'TMA' and deadline is not null").select(week_of(F.col("deadline")).alias("week_no")).distinct()


def share_matrix(w: Warehouse, module: str, presentation: str, weeks: list[int]) -> DataFrame:
    """Activity type x week shares, a column for each week."""
    rows = at(weekly_activity(w), module, presentation)
    got = rows.groupBy("activity_type").pivot("week_no", weeks).agg(F.first("activity_share"))
    return got.select("activity_type", *(F.col(str(k)).alias(f"week_{k}") for k in weeks))


def top_types_trend(w: Warehouse, k: int = 3) -> DataFrame:
    """Weekly clicks of the k types with most clicks."""
    rows = clicks_by_week_type(w)
    top = rows.groupBy("activity_type").agg(F.sum("total_clicks").alias("n")).orderBy(F.desc("n"), "activity_type").limit(k)
    return rows.join(top.select("activity_type"), "activity_type", "left_semi")


def offering_week_type(w: Warehouse, module: str, presentation: str) -> DataFrame:
    return _with_type(w, at(w.fact_vle_daily, module, presentation)).groupBy("week_no", "activity_type").agg(F.sum("sum_click").alias("total_clicks"))


# ---- clicks before a deadline, and scores ----


def student_pairs(w: Warehouse) -> DataFrame:
    """Score of the first weighted TMA and clicks strictly before its deadline; students without clicks stay in.

    Ranking reads the pairs several times, so the reports below write them first.
    """
    first = w.dim_assessment.where("is_first_weighted_tma").select("id_assessment", "deadline")
    scored = w.fact_submission.where("score is not null and not is_banked").join(first, "id_assessment").select(*ENROLMENT, "deadline", "score")
    clicks = w.fact_vle_daily.join(scored.select(*ENROLMENT, "deadline"), ENROLMENT).where("date < deadline").groupBy(*ENROLMENT).agg(F.sum("sum_click").alias("clicks_before"))
    return scored.join(clicks, ENROLMENT, "left").select(*ENROLMENT, F.coalesce("clicks_before", F.lit(0)).alias("clicks_before"), "score")


def spearman_pairs(w: Warehouse) -> DataFrame:
    """The pairs with n and rho of their offering on each row: grouped, a row for each offering, and joined."""
    pairs = written(student_pairs(w), "pairs")
    return pairs.join(S.spearman(pairs, "clicks_before", "score", OFFERING).drop("ci_low", "ci_high"), OFFERING).select(*ENROLMENT, "clicks_before", "score", "n", "rho")


def average_ranks(w: Warehouse) -> DataFrame:
    ranked = with_average_rank(with_average_rank(written(student_pairs(w), "pairs"), OFFERING, "clicks_before", "clicks_rank"), OFFERING, "score", "score_rank")
    return ranked.select(*ENROLMENT, "clicks_rank", "score_rank")


def spearman(w: Warehouse, with_interval: bool = False) -> DataFrame:
    got = S.spearman(written(student_pairs(w), "pairs"), "clicks_before", "score", OFFERING)
    return got if with_interval else got.drop("ci_low", "ci_high")


# ---- early warning ----

FLAGS = ["flag_low_clicks", "flag_inactive_2w", "flag_missed_tma", "flag_low_score"]


def risk_flags_all(w: Warehouse, weeks: list[int], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Flags for enrolled students in each of ``weeks``, without outcomes; a column set for each click quantile.

    One pass over the snapshot for all weeks: the week before comes from a lag, and quartiles are grouped by week.
    """
    quantiles = quantiles or {"": 0.25}
    needed = sorted({x for k in weeks for x in (k - 1, k)})
    rows = w.fact_student_week.where(F.col("week_no").isin(needed)).withColumn("clicks_before_week", previous_value("clicks_week", ENROLMENT, "week_no"))
    rows = rows.where(F.col("week_no").isin(list(weeks)) & F.col("is_enrolled"))
    limits = rows.groupBy(*OFFERING, "week_no").agg(*(S.quantile("clicks_cum", q).alias(f"limit{k}") for k, q in quantiles.items()))
    rows = rows.join(limits, [*OFFERING, "week_no"])
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    flags = [as_int(F.col("clicks_cum") < F.col(f"limit{k}")).alias(f"flag_low_clicks{k}") for k in quantiles]
    flags += [as_int((F.col("clicks_week") == 0) & (F.col("clicks_before_week") == 0)).alias("flag_inactive_2w"), as_int(F.col("n_tma_missed_cum") > 0).alias("flag_missed_tma"), as_int(F.col("avg_score_cum") < 40).alias("flag_low_score")]
    return rows.select(*ENROLMENT, "week_no", "clicks_cum", "clicks_week", "avg_score_cum", "n_tma_missed_cum", *flags)


def _score(quantile: str = "") -> Column:
    return F.col(f"flag_low_clicks{quantile}") + F.col("flag_inactive_2w") + F.col("flag_missed_tma") + F.col("flag_low_score")


def with_outcome(w: Warehouse, scored: DataFrame) -> DataFrame:
    """Outcomes join after scoring only."""
    return scored.join(w.fact_enrollment.select(*ENROLMENT, "final_result"), ENROLMENT).withColumn("is_unsuccessful", failed().cast("int"))


def risk_flags(w: Warehouse, week: int, module: str | None = None, presentation: str | None = None) -> DataFrame:
    got = risk_flags_all(w, [week])
    got = got if module is None else at(got, module, presentation)
    return with_outcome(w, got.withColumn("risk_score", _score()))


def risk_summary(w: Warehouse, week: int) -> DataFrame:
    got = risk_flags_all(w, [week]).withColumn("score", _score()).groupBy(*OFFERING)
    return got.agg(F.count("*").alias("n_active"), count_where(F.col("score") >= 2).alias("n_at_risk"), percent(count_where(F.col("score") >= 2), F.count("*")).alias("at_risk_rate_pct"), count_where(F.col("score") >= 3).alias("n_high"), count_where(F.col("score") == 2).alias("n_medium"))


def risk_list(w: Warehouse, week: int, module: str, presentation: str) -> DataFrame:
    """Students with two signs and more, highest first, fewest clicks first."""
    got = at(risk_flags_all(w, [week]), module, presentation).withColumn("risk_score", _score()).where("risk_score >= 2")
    order = F.row_number().over(Window.partitionBy(*OFFERING).orderBy(F.desc("risk_score"), "clicks_cum", "id_student"))
    return got.select("id_student", "risk_score", risk_level(F.col("risk_score")).alias("risk_level"), "clicks_cum", "clicks_week", "avg_score_cum", "n_tma_missed_cum", order.alias("position"))


def _quality(rows: DataFrame, by: list[str], flagged: Column) -> DataFrame:
    bad = F.col("is_unsuccessful") == 1
    got = rows.groupBy(*by).agg(F.count("*").alias("n_active"), count_where(flagged).alias("n_flagged"), count_where(flagged & bad).alias("n_true"), count_where(bad).alias("n_unsuccessful"))
    return got.withColumn("precision_pct", percent(F.col("n_true"), F.col("n_flagged"))).withColumn("recall_pct", percent(F.col("n_true"), F.col("n_unsuccessful")))


def risk_eval(w: Warehouse, weeks: list[int]) -> DataFrame:
    """Precision, recall, base rate and F1 (of the rounded rates) per week, all weeks in one pass."""
    rows = with_outcome(w, risk_flags_all(w, weeks).withColumn("score", _score()))
    got = _quality(rows, ["week_no"], F.col("score") >= 2).withColumn("base_rate_pct", percent(F.col("n_unsuccessful"), F.col("n_active")))
    p, r = F.col("precision_pct"), F.col("recall_pct")
    return got.withColumn("f1_pct", half_up(F.try_divide(2 * p * r, p + r), 1))


def risk_sensitivity(w: Warehouse, week: int) -> DataFrame:
    """Each sign alone, at least k signs, and two signs with other click quantiles: scenarios joined in, not looped."""
    rows = with_outcome(w, risk_flags_all(w, [week], {"": 0.25, "_p10": 0.1, "_p50": 0.5}))
    tests = {f"only {f}": F.col(f) == 1 for f in FLAGS} | {f"at least {k}": _score() >= k for k in (1, 2, 3, 4)} | {"two, clicks p10": _score("_p10") >= 2, "two, clicks p50": _score("_p50") >= 2}
    marked = rows.select("is_unsuccessful", F.explode(F.create_map(*(x for name, c in tests.items() for x in (F.lit(name), c)))).alias("scenario", "flagged"))
    return _quality(marked, ["scenario"], F.col("flagged"))


def risk_distribution(w: Warehouse, week: int, module: str, presentation: str) -> DataFrame:
    """How many students have each score, and each flag: (kind, name, n)."""
    rows = at(risk_flags_all(w, [week]), module, presentation).withColumn("score", _score())
    scores = rows.groupBy("score").agg(F.count("*").alias("n")).select(F.lit("score").alias("kind"), F.col("score").cast("string").alias("name"), "n")
    sums = rows.agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FLAGS))
    return scores.unionByName(sums.selectExpr("'flag' as kind", f"stack(4, {', '.join(f'{chr(39)}{f}{chr(39)}, {f}' for f in FLAGS)}) as (name, n)"))


def flip_outcomes(enrollment: DataFrame) -> DataFrame:
    """Passes and failures change places: a list that moves with them has seen the outcome."""
    return enrollment.withColumn("final_result", F.when(passed(), F.when(F.col("final_result") == "Pass", "Fail").otherwise("Withdrawn")).when(F.col("final_result") == "Fail", "Pass").otherwise("Distinction"))


def label_flip(w: Warehouse, week: int) -> DataFrame:
    """(n_before, n_after, n_same, precision before and after): the list must not change, the precision may."""
    import copy

    other = copy.copy(w)
    other.fact_student_week = w.fact_student_week
    other.fact_enrollment = flip_outcomes(w.fact_enrollment)
    lists = [risk_flags(x, week).where("risk_score >= 2").select(*ENROLMENT, "is_unsuccessful") for x in (w, other)]
    both = lists[0].withColumnRenamed("is_unsuccessful", "before").join(lists[1].withColumnRenamed("is_unsuccessful", "after"), ENROLMENT, "full")
    n = lambda c: count_where(F.col(c).isNotNull())
    got = both.agg(n("before").alias("n_before"), n("after").alias("n_after"), count_where(F.col("before").isNotNull() & F.col("after").isNotNull()).alias("n_same"), F.sum("before").alias("x"), F.sum("after").alias("y"))
    return got.select("n_before", "n_after", "n_same", percent(F.col("x"), F.col("n_before")).alias("precision_before"), percent(F.col("y"), F.col("n_after")).alias("precision_after"))


# ---- retention ----


def withdrawal_hazard(w: Warehouse) -> DataFrame:
    """Per offering and week: unregistrations in the week and up to its end, of any outcome, and what remains.

    Unregistrations are counted per day first, so the calendar join meets few rows.
    """
    calendar = period_grid(w.dim_presentation.select(*OFFERING, "n_weeks"), w.first_week, F.col("n_weeks") - 1)
    days = w.fact_enrollment.groupBy(*OFFERING, "date_unregistration").agg(F.count("*").alias("n"))
    day, week = F.col("date_unregistration"), F.col("week_no")
    rows = calendar.join(days, OFFERING)
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    got = rows.groupBy(*OFFERING, "week_no").agg(some(week_of(day) == week).alias("n_new"), some(day <= last_day(week)).alias("n_left"), F.sum("n").alias("n_enrollments"))
    return got.select(*OFFERING, "week_no", last_day(week).alias("day_to"), "n_new", "n_left", "n_enrollments", percent(F.col("n_left"), F.col("n_enrollments"), 2).alias("left_rate_pct"), percent(F.col("n_enrollments") - F.col("n_left"), F.col("n_enrollments"), 2).alias("retention_rate_pct"))


def retention_curve(w: Warehouse) -> DataFrame:
    got = withdrawal_hazard(w)
    return got.select(offering_label(F.col("code_module"), F.col("code_presentation")).alias("cohort"), "week_no", "day_to", "n_left", "n_enrollments", "left_rate_pct", "retention_rate_pct")


def withdrawal_summary(w: Warehouse) -> DataFrame:
    """Milestones of withdrawn enrolments (by outcome) per offering."""
    out, day, n = F.col("is_withdrawn"), F.col("date_unregistration"), F.count("*")
    by = {"day_0": count_where(out & (day <= 0)), "day_27": count_where(out & (day <= 27)), "total": count_where(out)}
    got = w.fact_enrollment.groupBy(*OFFERING).agg(n.alias("n_enrollments"), *(c.alias(f"n_{k}") for k, c in by.items()), *(percent(c, n).alias(f"pct_{k}") for k, c in by.items()), F.median(F.when(out, day)).alias("median_day"))
    return got.withColumn("presentation", offering_label(F.col("code_module"), F.col("code_presentation"))).drop(*OFFERING)


def withdrawal_school(w: Warehouse) -> DataFrame:
    day = F.col("date_unregistration")
    got = w.fact_enrollment.where("is_withdrawn").agg(F.count("*").alias("n_withdrawn"), count_where(day.isNull()).alias("n_no_date"), count_where(day <= 0).alias("n_by_day_0"), F.median(day).alias("median_day"))
    return got.withColumn("median_week", F.floor(F.col("median_day") / 7))


def withdrawal_quartiles(w: Warehouse) -> DataFrame:
    return w.fact_enrollment.where("is_withdrawn").agg(*S.quartiles("date_unregistration", ["q25_day", "median_day", "q75_day"]))


# ---- groups ----


def band_gap(w: Warehouse, least: int = 30, presentations: list[str] | None = None, modules: list[str] | None = None) -> DataFrame:
    """Pass and distinction rates of the two end bands per presentation, hidden under ``least`` distinct students."""
    rows = w.fact_enrollment.where("not withdrawn_before_start").join(w.dim_student.select("id_student", "imd_band"), "id_student")
    if modules:
        rows = rows.where(F.col("code_module").isin(modules))
    if presentations:
        rows = rows.where(F.col("code_presentation").isin(presentations))
    outcomes = {"passed": passed(), "distinction": F.col("final_result") == "Distinction"}
    return S.group_gap(rows, ["code_presentation"], "id_student", F.col("imd_band"), {"low": "0-10%", "high": "90-100%"}, outcomes, least)


def band_pivot(w: Warehouse) -> DataFrame:
    """Presentation x band pass rates by a pivot of band rows, one column each."""
    rows = w.fact_enrollment.join(w.dim_student.select("id_student", "imd_band"), "id_student").groupBy("code_presentation", "imd_band").agg(percent(count_where(passed()), F.count("*")).alias("rate"))
    bands = {"0-10%": "low", "10-20%": "next", "90-100%": "high", "Unknown": "unknown"}
    return rows.groupBy("code_presentation").agg(*(F.max(F.when(F.col("imd_band") == b, F.col("rate"))).alias(f"rate_{n}") for b, n in bands.items()))


# ---- cohorts and students ----


def cohort_quantiles(w: Warehouse, module: str, presentation: str) -> DataFrame:
    rows = at(w.fact_student_week, module, presentation).where("is_enrolled")
    return rows.groupBy("week_no").agg(F.count("*").alias("n_active"), *S.quartiles("clicks_cum", ["q25_clicks", "median_clicks", "q75_clicks"]), *S.quartiles("avg_score_cum", ["q25_score", "median_score", "q75_score"]))


def all_ribbons(w: Warehouse) -> DataFrame:
    """The quartiles of clicks and of scores of every offering and week, in bounded memory."""
    rows, keys = w.fact_student_week.where("is_enrolled"), [*OFFERING, "week_no"]
    own = lambda x, name: exact_quantiles(rows, keys, x, {f"q25_{name}": 0.25, f"median_{name}": 0.5, f"q75_{name}": 0.75})
    return own("clicks_cum", "clicks").withColumnRenamed("n", "n_active").join(own("avg_score_cum", "score").withColumnRenamed("n", "n_scored"), keys, "left").fillna(0, ["n_scored"])


def click_sketches(w: Warehouse) -> DataFrame:
    """Sketches of daily clicks by offering and week, to be stored."""
    return sketches.sketch(w.fact_vle_daily, [*OFFERING, "week_no"], "sum_click")


def approximate_quartiles(stored: DataFrame) -> DataFrame:
    """School quartiles of daily clicks by week, from stored sketches alone."""
    return sketches.quantiles(sketches.merged(stored, ["week_no"]), ["week_no"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def timeline(w: Warehouse, module: str, presentation: str, id_student: int) -> DataFrame:
    rows = at(w.fact_student_week, module, presentation).where(F.col("id_student") == id_student)
    return rows.select("week_no", "clicks_week", "clicks_cum", "avg_score_cum", "n_tma_missed_cum", "is_enrolled")


def student_progress(w: Warehouse, module: str, presentation: str, id_student: int) -> DataFrame:
    own = at(w.fact_enrollment, module, presentation).where(F.col("id_student") == id_student).select("final_result")
    return timeline(w, module, presentation, id_student).crossJoin(F.broadcast(own))


def student_vs_ribbon(w: Warehouse, module: str, presentation: str, id_student: int) -> DataFrame:
    ribbon = cohort_quantiles(w, module, presentation).select("week_no", "n_active", "q25_clicks", "median_clicks", "q75_clicks")
    return timeline(w, module, presentation, id_student).select("week_no", "clicks_cum").join(ribbon, "week_no", "left")


def offering_students(w: Warehouse, module: str, presentation: str) -> DataFrame:
    return at(w.fact_enrollment, module, presentation).select("id_student").distinct()


def students_in_week(w: Warehouse, module: str, presentation: str, week: int) -> DataFrame:
    return at(w.fact_student_week, module, presentation).where((F.col("week_no") == week) & F.col("is_enrolled")).select("id_student")


def percent_ranks(w: Warehouse, week: int) -> DataFrame:
    """Percent ranks of clicks and scores within each offering in a week; a missing score has no rank."""
    rows = w.fact_student_week.where((F.col("week_no") == week) & F.col("is_enrolled"))
    rows = with_percent_rank(rows.select(*ENROLMENT, "clicks_cum", "avg_score_cum"), OFFERING, "clicks_cum", "clicks_percentile")
    rows = with_percent_rank(rows, OFFERING, "avg_score_cum", "score_percentile")
    return rows.withColumn("clicks_band", percentile_band(F.col("clicks_percentile")))


def _week_type_clicks(w: Warehouse, module: str, presentation: str, week: int) -> DataFrame:
    rows = at(w.fact_vle_daily, module, presentation).where((F.col("week_no") == week) & ~F.col("is_pre_start"))
    return _with_type(w, rows).groupBy("id_student", "activity_type").agg(F.sum("sum_click").alias("clicks"))


def activity_quartiles(w: Warehouse, module: str, presentation: str, week: int, activity: str) -> DataFrame:
    """Clicks of passing students on one activity in one week, those without clicks included."""
    group = at(w.fact_enrollment, module, presentation).where(passed()).select("id_student")
    own = _week_type_clicks(w, module, presentation, week).where(F.col("activity_type") == activity)
    rows = group.join(own, "id_student", "left").fillna(0, ["clicks"])
    return rows.agg(F.count("*").alias("n_students"), *S.quartiles("clicks", ["q25_clicks", "median_clicks", "q75_clicks"]))


def activity_grid(w: Warehouse, module: str, presentation: str, week: int) -> DataFrame:
    """Every passing student x activity type of the offering, zeros filled in."""
    types = at(w.dim_vle_site, module, presentation).select("activity_type").distinct()
    group = at(w.fact_enrollment, module, presentation).where(passed()).select("id_student")
    return group.crossJoin(types).join(_week_type_clicks(w, module, presentation, week), ["id_student", "activity_type"], "left").fillna(0, ["clicks"])


def student_vs_pass(w: Warehouse, module: str, presentation: str, week: int, id_student: int, least: int = 30) -> DataFrame:
    """A student's clicks per activity against the quartiles of passing students; quartiles hidden in small groups."""
    ribbon = activity_grid(w, module, presentation, week).groupBy("activity_type").agg(F.count("*").alias("n_pass"), *S.quartiles("clicks", ["q25", "q50", "q75"]))
    own = _week_type_clicks(w, module, presentation, week).where(F.col("id_student") == id_student).select("activity_type", F.col("clicks").alias("student_clicks"))
    got = ribbon.join(own, "activity_type", "left").fillna(0, ["student_clicks"])
    hide = lambda c: S.suppressed(F.col(c), F.col("n_pass"), least)
    side = F.when(F.col("student_clicks") < hide("q50"), "below").when(F.col("student_clicks") > hide("q50"), "above").when(hide("q50").isNotNull(), "equal")
    return got.select("activity_type", "n_pass", hide("q25").alias("q25_clicks"), hide("q50").alias("median_clicks"), hide("q75").alias("q75_clicks"), "student_clicks", side.alias("side"))


# ---- stream log ----


def stream_live_weekly(log: DataFrame) -> DataFrame:
    """Weekly totals of the latest update of each student and week."""
    return latest_by_key(log, [*ENROLMENT, "week_no"], "batch_id").groupBy("week_no").agg(F.sum("clicks_week").alias("clicks_stream"), F.count("*").alias("student_weeks"), F.max("batch_id").alias("last_batch"))


def live_vs_batch(w: Warehouse, log: DataFrame) -> DataFrame:
    batch = w.fact_vle_daily.groupBy("week_no").agg(F.sum("sum_click").alias("clicks_batch"))
    got = batch.join(stream_live_weekly(log), "week_no", "left").fillna(0, ["clicks_stream", "student_weeks"])
    return got.select("week_no", "clicks_batch", "clicks_stream", percent(F.col("clicks_stream"), F.col("clicks_batch")).alias("done_pct"))
