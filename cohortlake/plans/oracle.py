"""Reference SQL (DuckDB) for the registered queries, written from the definitions of the tables and reports."""

from __future__ import annotations

from .contract import ANYWHERE, CONTRACT, LINKS
from .queries import FIRST_WEEK, ITEM, MODULE, PRESENTATION, RISK_WEEK, RISK_WEEKS, SAMPLE_WEEK


def pct(part: str, whole: str, places: int | None = 1) -> str:
    raw = f"(100::DOUBLE * ({part}) / nullif(({whole})::DOUBLE, 0))"
    return raw if places is None else f"(floor({raw} * {10**places} + 0.5) / {10**places})"


def big(x: str, name: str) -> str:
    return f"({x})::BIGINT AS {name}"


BASE = f"""
WITH days AS (
  SELECT event_id, ts, user_id AS id_student, event_type, value, (props->>'k')::BIGINT AS k,
         floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-08')) / 86400000000.0)::BIGINT AS date
  FROM events),
offering AS (
  SELECT code_module, code_presentation, (2 * (dense_rank() OVER (ORDER BY code_module) - 1) + CASE code_presentation WHEN '2024J' THEN 1 ELSE 0 END)::BIGINT AS offering_no
  FROM (SELECT DISTINCT c_mktsegment AS code_module, CASE WHEN c_custkey % 2 = 0 THEN '2024B' ELSE '2024J' END AS code_presentation FROM customer)),
kinds AS (SELECT * FROM (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) t(activity_type, type_no)),
courses AS (
  SELECT code_module, code_presentation, CASE code_presentation WHEN '2024B' THEN 42 ELSE 35 END::BIGINT AS module_presentation_length FROM offering),
assessments AS (
  SELECT code_module, code_presentation, (100 * offering_no + a)::BIGINT AS id_assessment,
         CASE a WHEN 3 THEN 'CMA' WHEN 4 THEN 'Exam' ELSE 'TMA' END AS assessment_type,
         CASE WHEN a < 4 THEN 5 * a + 2 END::BIGINT AS date,
         CASE WHEN a = 4 THEN 50 WHEN code_module = 'MACHINERY' THEN 0 WHEN a = 1 THEN 20 WHEN a = 2 THEN 30 ELSE 0 END::DOUBLE AS weight
  FROM offering, range(5) r(a)),
vle AS (
  SELECT (1000 * offering_no + 20 * type_no + k)::BIGINT AS id_site, code_module, code_presentation, activity_type,
         CASE WHEN k % 2 = 0 THEN k END::BIGINT AS week_from, CASE WHEN k % 2 = 0 THEN k END::BIGINT AS week_to
  FROM offering, kinds, range(11) r(k)),
pupil AS (
  SELECT c_custkey AS id_student, c_mktsegment AS code_module, CASE WHEN c_custkey % 2 = 0 THEN '2024B' ELSE '2024J' END AS code_presentation, c_nationkey, c_acctbal
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events)),
enrolled AS (
  SELECT *, true AS is_first FROM pupil
  UNION ALL SELECT id_student, code_module, CASE code_presentation WHEN '2024B' THEN '2024J' ELSE '2024B' END, c_nationkey, c_acctbal, false FROM pupil WHERE id_student % 6 = 0),
student_info AS (
  SELECT code_module, code_presentation, id_student, CASE WHEN id_student % 2 = 0 THEN 'F' ELSE 'M' END AS gender, r_name AS region,
         (['None', 'Lower', 'Upper', 'Bachelor', 'Master'])[id_student % 5 + 1] AS highest_education,
         CASE WHEN c_nationkey < 3 THEN NULL WHEN c_nationkey < 6 THEN '10-20' WHEN c_nationkey < 14 THEN '0-10%' ELSE '90-100%' END AS imd_band,
         (['0-35', '35-55', '55+'])[id_student % 3 + 1] AS age_band,
         (CASE WHEN is_first THEN id_student % 3 ELSE 0 END)::BIGINT AS num_of_prev_attempts, (30 + 30 * (id_student % 4))::BIGINT AS studied_credits,
         CASE WHEN id_student % 9 = 0 THEN 'Y' ELSE 'N' END AS disability,
         CASE WHEN NOT is_first OR c_acctbal < 0 THEN 'Withdrawn' WHEN c_acctbal < 3000 THEN 'Fail' WHEN c_acctbal < 8000 THEN 'Pass' ELSE 'Distinction' END AS final_result
  FROM enrolled JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
registration AS (
  SELECT code_module, code_presentation, id_student, CASE WHEN id_student % 19 <> 0 THEN -10 - id_student % 20 END::BIGINT AS date_registration,
         CASE WHEN NOT is_first THEN NULL WHEN c_acctbal < 0 AND id_student % 11 <> 0 THEN id_student % 30 - 5 WHEN id_student % 29 = 0 THEN 12 END::BIGINT AS date_unregistration
  FROM enrolled),
student_vle AS (
  SELECT p.code_module, p.code_presentation, d.id_student, (1000 * offering_no + 20 * type_no + k % 10)::BIGINT AS id_site, date, (1 + floor(value / 10))::BIGINT AS sum_click
  FROM days d JOIN pupil p USING (id_student) JOIN offering USING (code_module, code_presentation) JOIN kinds ON activity_type = event_type
  WHERE NOT (d.id_student % 7 = 0 AND date >= 7)),
student_assessment AS (
  SELECT (100 * offering_no + a)::BIGINT AS id_assessment, id_student, date AS date_submitted, (CASE WHEN (id_student + a) % 17 = 0 THEN 1 ELSE 0 END)::BIGINT AS is_banked,
         CASE WHEN k % 23 <> 0 THEN least(100, floor(value)) END AS score
  FROM (SELECT d.*, p.code_module, p.code_presentation, k % 5 AS a, row_number() OVER (PARTITION BY d.id_student, k % 5 ORDER BY ts, event_id) AS nth
        FROM days d JOIN pupil p USING (id_student) WHERE event_type = 'purchase') JOIN offering USING (code_module, code_presentation)
  WHERE nth = 1),
dim_presentation AS (
  SELECT code_module, code_presentation, left(code_presentation, 4)::BIGINT AS year, right(code_presentation, 1) AS semester, module_presentation_length AS length_days,
         (floor((module_presentation_length - 1) / 7.0) + 1)::BIGINT AS n_weeks,
         (code_module, code_presentation) IN (SELECT (code_module, code_presentation) FROM assessments JOIN student_assessment USING (id_assessment) WHERE assessment_type = 'Exam') AS has_exam_result,
         (code_module, code_presentation) IN (SELECT (code_module, code_presentation) FROM assessments WHERE assessment_type = 'TMA' AND weight > 0) AS has_weighted_tma
  FROM courses),
dim_student AS (
  SELECT DISTINCT id_student, gender, region, highest_education, CASE imd_band WHEN '10-20' THEN '10-20%' ELSE coalesce(imd_band, 'Unknown') END AS imd_band, disability, imd_band IS NULL AS imd_unknown FROM student_info),
dated AS (
  SELECT id_assessment, code_module, code_presentation, assessment_type, date AS deadline_raw, coalesce(date, module_presentation_length) AS deadline, weight FROM assessments JOIN courses USING (code_module, code_presentation)),
dim_assessment AS (
  SELECT *, row_number() OVER (PARTITION BY code_module, code_presentation ORDER BY deadline, id_assessment) AS assessment_order, deadline_raw IS NULL AS deadline_imputed, weight = 0 AS zero_weight,
         id_assessment IN (SELECT arg_min(id_assessment, deadline * 100000 + id_assessment) FROM dated WHERE assessment_type = 'TMA' AND weight > 0 GROUP BY code_module, code_presentation) AS is_first_weighted_tma,
         id_assessment IN (SELECT id_assessment FROM student_assessment) AS has_submissions
  FROM dated),
dim_vle_site AS (SELECT *, week_from IS NOT NULL AS has_planned_week, id_site NOT IN (SELECT id_site FROM student_vle) AS never_clicked FROM vle),
dim_week AS (
  SELECT w::BIGINT AS week_no, (7 * w)::BIGINT AS day_from, (7 * w + 6)::BIGINT AS day_to, w < 0 AS is_pre_start
  FROM (SELECT unnest(generate_series((SELECT least(floor(min(date) / 7.0), 0)::BIGINT FROM student_vle), (SELECT max(n_weeks) - 1 FROM dim_presentation))) AS w)),
fact_vle_daily AS (
  SELECT id_student, code_module, code_presentation, id_site, date, floor(date / 7.0)::BIGINT AS week_no, sum(sum_click)::BIGINT AS sum_click, count(*) AS n_records, date < 0 AS is_pre_start FROM student_vle GROUP BY ALL),
fact_submission AS (
  SELECT s.id_student, s.id_assessment, a.code_module, a.code_presentation, date_submitted, floor(date_submitted / 7.0)::BIGINT AS week_no, score::BIGINT AS score,
         CASE WHEN is_banked = 0 THEN date_submitted - deadline END AS days_late, is_banked = 1 AS is_banked, assessment_type = 'TMA' AND is_banked = 0 AND date_submitted > deadline AS is_late,
         score IS NULL AS score_missing, date_submitted > length_days AS is_beyond_course, score >= 40 AS is_pass_score
  FROM student_assessment s JOIN dim_assessment a USING (id_assessment) JOIN dim_presentation USING (code_module, code_presentation)),
fact_enrollment AS (
  SELECT i.id_student, i.code_module, i.code_presentation, final_result, age_band, studied_credits, num_of_prev_attempts, date_registration, date_unregistration,
         coalesce(total_clicks, 0) AS total_clicks, coalesce(active_days, 0) AS active_days, coalesce(n_submissions, 0) AS n_submissions,
         final_result = 'Withdrawn' AS is_withdrawn, coalesce(date_unregistration <= 0, false) AS withdrawn_before_start, total_clicks IS NULL AS no_vle_activity, date_registration IS NULL AS reg_date_missing,
         (final_result = 'Withdrawn') <> (date_unregistration IS NOT NULL) AS result_inconsistent, num_of_prev_attempts > 0 AS is_repeat
  FROM student_info i JOIN registration USING (id_student, code_module, code_presentation)
  LEFT JOIN (SELECT id_student, code_module, code_presentation, sum(sum_click)::BIGINT AS total_clicks, count(DISTINCT date) AS active_days FROM student_vle GROUP BY ALL) USING (id_student, code_module, code_presentation)
  LEFT JOIN (SELECT id_student, code_module, code_presentation, count(*) AS n_submissions FROM student_assessment JOIN assessments USING (id_assessment) GROUP BY ALL) USING (id_student, code_module, code_presentation)),
grid AS (
  SELECT id_student, code_module, code_presentation, date_unregistration, w::BIGINT AS week_no FROM fact_enrollment JOIN dim_presentation USING (code_module, code_presentation), range({FIRST_WEEK}, 100) r(w) WHERE w < n_weeks),
fact_student_week AS (
  SELECT *, clicks_week = 0 AS is_week_inactive FROM (SELECT g.id_student, g.code_module, g.code_presentation, g.week_no,
    coalesce((SELECT sum(sum_click) FROM fact_vle_daily v WHERE v.id_student = g.id_student AND v.code_module = g.code_module AND v.code_presentation = g.code_presentation AND v.week_no = g.week_no), 0)::BIGINT AS clicks_week,
    coalesce((SELECT sum(sum_click) FROM fact_vle_daily v WHERE v.id_student = g.id_student AND v.code_module = g.code_module AND v.code_presentation = g.code_presentation AND v.week_no <= g.week_no), 0)::BIGINT AS clicks_cum,
    (SELECT count(DISTINCT date) FROM fact_vle_daily v WHERE v.id_student = g.id_student AND v.code_module = g.code_module AND v.code_presentation = g.code_presentation AND v.week_no = g.week_no) AS active_days_week,
    (SELECT count(DISTINCT id_site) FROM fact_vle_daily v WHERE v.id_student = g.id_student AND v.code_module = g.code_module AND v.code_presentation = g.code_presentation AND v.week_no = g.week_no) AS sites_week,
    (SELECT count(*) FROM fact_submission s WHERE s.id_student = g.id_student AND s.code_module = g.code_module AND s.code_presentation = g.code_presentation AND s.week_no <= g.week_no) AS n_submitted_cum,
    (SELECT count(*) FILTER (is_late) FROM fact_submission s WHERE s.id_student = g.id_student AND s.code_module = g.code_module AND s.code_presentation = g.code_presentation AND s.week_no <= g.week_no) AS n_late_cum,
    (SELECT avg(score) FROM fact_submission s WHERE s.id_student = g.id_student AND s.code_module = g.code_module AND s.code_presentation = g.code_presentation AND s.week_no <= g.week_no) AS avg_score_cum,
    (SELECT count(*) FROM dim_assessment a LEFT JOIN (SELECT id_student AS who, id_assessment, week_no AS done FROM fact_submission) s ON s.id_assessment = a.id_assessment AND s.who = g.id_student
      WHERE a.code_module = g.code_module AND a.code_presentation = g.code_presentation AND assessment_type = 'TMA' AND weight > 0 AND floor(deadline / 7.0) <= g.week_no AND coalesce(done > g.week_no, true)) AS n_tma_missed_cum,
    g.week_no < 0 AS is_pre_start, date_unregistration IS NULL OR date_unregistration > 7 * g.week_no + 6 AS is_enrolled
  FROM grid g)),
site_clicks AS (SELECT v.*, activity_type FROM fact_vle_daily v JOIN dim_vle_site USING (id_site, code_module, code_presentation)),
tma AS (SELECT s.* FROM fact_submission s JOIN dim_assessment USING (id_assessment) WHERE assessment_type = 'TMA' AND NOT is_banked),
live AS (
  SELECT code_module, code_presentation, week_no, count(e.id_student) AS enrolled_students
  FROM (SELECT code_module, code_presentation, w::BIGINT AS week_no FROM dim_presentation, range(0, 100) r(w) WHERE w < n_weeks) c
  LEFT JOIN (SELECT id_student, code_module, code_presentation, date_unregistration FROM fact_enrollment) e USING (code_module, code_presentation)
  WHERE e.date_unregistration IS NULL OR e.date_unregistration > 7 * week_no + 6 GROUP BY ALL),
act AS (
  SELECT code_module, code_presentation, week_no, activity_type, sum(sum_click)::BIGINT AS activity_clicks FROM site_clicks JOIN fact_enrollment USING (id_student, code_module, code_presentation)
  WHERE NOT is_pre_start AND (date_unregistration IS NULL OR date_unregistration > 7 * week_no + 6) GROUP BY ALL),
weeks AS (
  SELECT code_module, code_presentation, week_no, enrolled_students, coalesce((SELECT sum(activity_clicks) FROM act a WHERE a.code_module = l.code_module AND a.code_presentation = l.code_presentation AND a.week_no = l.week_no), 0)::BIGINT AS week_clicks FROM live l),
activity AS (
  SELECT w.code_module, w.code_presentation, w.week_no, k.activity_type, 7 * w.week_no AS week_start_day, 7 * w.week_no + 6 AS week_end_day, enrolled_students, week_clicks, week_clicks::DOUBLE / nullif(enrolled_students, 0) AS clicks_per_student,
    coalesce(activity_clicks, 0) AS activity_clicks, coalesce(activity_clicks, 0)::DOUBLE / nullif(enrolled_students, 0) AS activity_clicks_per_student, coalesce(activity_clicks, 0)::DOUBLE / nullif(week_clicks, 0) AS activity_share, average_rank, total_rank
  FROM (SELECT *, rank() OVER (PARTITION BY code_module, code_presentation ORDER BY week_clicks::DOUBLE / nullif(enrolled_students, 0) DESC NULLS LAST) AS average_rank, rank() OVER (PARTITION BY code_module, code_presentation ORDER BY week_clicks DESC) AS total_rank FROM weeks) w
  CROSS JOIN kinds k LEFT JOIN act a ON a.code_module = w.code_module AND a.code_presentation = w.code_presentation AND a.week_no = w.week_no AND a.activity_type = k.activity_type),
pairs AS (
  SELECT s.id_student, s.code_module, s.code_presentation, coalesce((SELECT sum(sum_click) FROM fact_vle_daily v WHERE v.id_student = s.id_student AND v.code_module = s.code_module AND v.code_presentation = s.code_presentation AND v.date < a.deadline), 0)::BIGINT AS clicks_before, score
  FROM fact_submission s JOIN dim_assessment a USING (id_assessment) WHERE is_first_weighted_tma AND score IS NOT NULL AND NOT is_banked),
ranks AS (
  SELECT *, (SELECT count(*) FROM pairs q WHERE q.code_module = p.code_module AND q.code_presentation = p.code_presentation AND q.clicks_before < p.clicks_before) + (1 + (SELECT count(*) FROM pairs q WHERE q.code_module = p.code_module AND q.code_presentation = p.code_presentation AND q.clicks_before = p.clicks_before)) / 2.0::DOUBLE AS clicks_rank,
    (SELECT count(*) FROM pairs q WHERE q.code_module = p.code_module AND q.code_presentation = p.code_presentation AND q.score < p.score) + (1 + (SELECT count(*) FROM pairs q WHERE q.code_module = p.code_module AND q.code_presentation = p.code_presentation AND q.score = p.score)) / 2.0::DOUBLE AS score_rank
  FROM pairs p),
rho AS (SELECT code_module, code_presentation, count(*) AS n, corr(clicks_rank, score_rank) AS rho FROM ranks GROUP BY ALL),
cohort AS (
  SELECT w.*, coalesce(b.clicks_week, 0) AS clicks_before_week FROM fact_student_week w LEFT JOIN fact_student_week b ON b.id_student = w.id_student AND b.code_module = w.code_module AND b.code_presentation = w.code_presentation AND b.week_no = w.week_no - 1
  WHERE w.is_enrolled AND w.week_no IN ({', '.join(map(str, RISK_WEEKS))})),
limits AS (SELECT code_module, code_presentation, week_no, quantile_cont(clicks_cum, 0.1) AS q10, quantile_cont(clicks_cum, 0.25) AS q25, quantile_cont(clicks_cum, 0.5) AS q50 FROM cohort GROUP BY ALL),
flags AS (
  SELECT c.*, (clicks_cum < q25)::BIGINT AS flag_low_clicks, (clicks_week = 0 AND clicks_before_week = 0)::BIGINT AS flag_inactive_2w, (n_tma_missed_cum > 0)::BIGINT AS flag_missed_tma, coalesce(avg_score_cum < 40, false)::BIGINT AS flag_low_score,
    flag_low_clicks + flag_inactive_2w + flag_missed_tma + flag_low_score AS risk_score, (clicks_cum < q10)::BIGINT AS low10, (clicks_cum < q50)::BIGINT AS low50, final_result, (final_result IN ('Fail', 'Withdrawn'))::BIGINT AS is_unsuccessful
  FROM cohort c JOIN limits USING (code_module, code_presentation, week_no) JOIN fact_enrollment USING (id_student, code_module, code_presentation)),
log AS (
  SELECT id_student, code_module, code_presentation, floor(date / 7.0)::BIGINT AS week_no, sum(sum_click)::BIGINT AS clicks_week, 0::BIGINT AS batch_id FROM student_vle WHERE id_site % 2 = 0 GROUP BY ALL
  UNION ALL SELECT id_student, code_module, code_presentation, floor(date / 7.0)::BIGINT, sum(sum_click)::BIGINT, 1 FROM student_vle GROUP BY ALL HAVING count(*) FILTER (id_site % 2 = 1) > 0),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id_student, code_module, code_presentation, week_no ORDER BY batch_id DESC) = 1),
item_stats AS (
  SELECT id_assessment, count(DISTINCT id_student) AS submitted_total, count(DISTINCT id_student) FILTER (NOT is_banked) AS submitted_regular, count(DISTINCT id_student) FILTER (is_banked) AS banked_students, count(DISTINCT id_student) FILTER (is_late) AS late_submissions,
    count(DISTINCT id_student) FILTER (is_pass_score) AS passed_students, count(*) FILTER (is_pass_score) AS n_pass_scores, count(score) AS n_scores, avg(score) AS avg_score, quantile_cont(score, 0.25) AS q1_score, median(score) AS median_score, quantile_cont(score, 0.75) AS q3_score, min(score) AS min_score, max(score) AS max_score
  FROM fact_submission GROUP BY ALL),
item_active AS (SELECT id_assessment, count(DISTINCT id_student) AS active_students FROM dim_assessment JOIN fact_enrollment USING (code_module, code_presentation) WHERE date_unregistration IS NULL OR date_unregistration > deadline GROUP BY ALL),
items AS (SELECT * FROM dim_assessment LEFT JOIN item_active USING (id_assessment) LEFT JOIN item_stats USING (id_assessment))
"""

HERE = f"code_module = '{MODULE}' AND code_presentation = '{PRESENTATION}'"
WHO = f"(SELECT min(id_student) FROM fact_enrollment WHERE {HERE})"
OFF = "code_module, code_presentation"
ENR = f"id_student, {OFF}"
GOOD = "final_result IN ('Pass', 'Distinction')"
ITEMS = f"SELECT id_assessment, assessment_type || ' ' || id_assessment AS assessment_label, assessment_order, deadline, weight, is_first_weighted_tma, coalesce(active_students, 0) AS active_students, coalesce(submitted_regular, 0) AS submitted_regular, coalesce(banked_students, 0) AS banked_students, coalesce(late_submissions, 0) AS late_submissions, coalesce({pct('coalesce(submitted_regular, 0)', 'coalesce(active_students, 0)')}, 0) AS submission_rate_pct, CASE WHEN assessment_type = 'TMA' THEN coalesce({pct('late_submissions', 'submitted_regular')}, 0) ELSE 0 END AS late_rate_pct, q1_score AS p25_score, median_score, q3_score AS p75_score, {pct('n_pass_scores', 'n_scores')} AS pass_rate_pct FROM items WHERE {HERE}"
OVER = f"count(*) AS n_enrollments, count(DISTINCT id_student) AS n_students, count(*) FILTER ({GOOD}) AS n_passed, count(*) FILTER (final_result = 'Distinction') AS n_distinction, count(*) FILTER (final_result = 'Fail') AS n_failed, count(*) FILTER (final_result = 'Withdrawn') AS n_withdrawn, count(*) FILTER (no_vle_activity) AS n_no_vle_activity, sum(total_clicks)::BIGINT AS total_clicks FROM fact_enrollment"
RATES = f"SELECT {OFF}, {pct(f'count(*) FILTER ({GOOD})', 'count(*)', None)} AS pass_rate, {pct('count(*) FILTER (is_withdrawn)', 'count(*)', None)} AS withdrawal_rate, sum(total_clicks)::DOUBLE / count(*) AS clicks_per_enrollment FROM fact_enrollment GROUP BY ALL"
EVAL = lambda cond, rows, by="": f"SELECT {by} count(*) AS n_active, count(*) FILTER ({cond}) AS n_flagged, count(*) FILTER (({cond}) AND is_unsuccessful = 1) AS n_true, sum(is_unsuccessful)::BIGINT AS n_unsuccessful, {pct(f'count(*) FILTER (({cond}) AND is_unsuccessful = 1)', f'count(*) FILTER ({cond})')} AS precision_pct, {pct(f'count(*) FILTER (({cond}) AND is_unsuccessful = 1)', 'sum(is_unsuccessful)')} AS recall_pct FROM flags WHERE {rows}"
EVAL_WEEKS = lambda rows: f"SELECT *, {pct('n_unsuccessful', 'n_active')} AS base_rate_pct, floor(2 * precision_pct * recall_pct / nullif(precision_pct + recall_pct, 0) * 10 + 0.5) / 10 AS f1_pct FROM ({EVAL('risk_score >= 2', rows, 'week_no,')} GROUP BY week_no)"
HAZARD = f"SELECT {OFF}, week_no, 7 * week_no + 6 AS day_to, count(*) FILTER (floor(date_unregistration / 7.0) = week_no) AS n_new, count(*) FILTER (date_unregistration <= 7 * week_no + 6) AS n_left, count(*) AS n_enrollments, {pct('count(*) FILTER (date_unregistration <= 7 * week_no + 6)', 'count(*)', 2)} AS left_rate_pct, {pct('count(*) - count(*) FILTER (date_unregistration <= 7 * week_no + 6)', 'count(*)', 2)} AS retention_rate_pct FROM grid GROUP BY ALL"


def gap(least: int, where: str = "true") -> str:
    side = {"low": "0-10%", "high": "90-100%"}
    inner = ", ".join(f"count(DISTINCT id_student) FILTER (imd_band = '{b}') AS people_{s}, count(*) FILTER (imd_band = '{b}') AS rows_{s}, count(*) FILTER (imd_band = '{b}' AND {GOOD}) AS passed_{s}, count(*) FILTER (imd_band = '{b}' AND final_result = 'Distinction') AS distinction_{s}" for s, b in side.items())
    outer = ", ".join(f"CASE WHEN people_{s} >= {least} THEN people_{s} END AS n_people_{s}, CASE WHEN people_{s} >= {least} THEN rows_{s} END AS n_rows_{s}, " + ", ".join(f"CASE WHEN people_{s} >= {least} THEN {pct(f'{o}_{s}', f'rows_{s}')} END AS {o}_rate_{s}" for o in ("passed", "distinction")) + f", CASE WHEN people_{s} < {least} THEN 'n < {least}' ELSE people_{s}::VARCHAR END AS label_{s}" for s in side)
    gaps = ", ".join(f"CASE WHEN people_low >= {least} AND people_high >= {least} THEN floor(abs({pct(f'{o}_high', 'rows_high', None)} - {pct(f'{o}_low', 'rows_low', None)}) * 10 + 0.5) / 10 END AS {o}_gap" for o in ("passed", "distinction"))
    return f"SELECT code_presentation, {outer}, {gaps} FROM (SELECT code_presentation, {inner} FROM fact_enrollment JOIN dim_student USING (id_student) WHERE NOT withdrawn_before_start AND {where} GROUP BY ALL)"


DOC = "week_no, clicks_week, clicks_cum, avg_score_cum, n_tma_missed_cum, is_enrolled"
CROSS = f"SELECT {OFF}, count(*) AS n_enrolled, sum(clicks_week)::BIGINT AS clicks, avg(clicks_cum) AS avg_clicks_cum FROM fact_student_week WHERE week_no = {RISK_WEEK} AND is_enrolled GROUP BY ALL"
PASS_CLICKS = f"SELECT e.id_student, t.activity_type, coalesce((SELECT sum(sum_click) FROM site_clicks c WHERE c.id_student = e.id_student AND c.{HERE.replace(' AND ', ' AND c.')} AND c.week_no = {SAMPLE_WEEK} AND NOT c.is_pre_start AND c.activity_type = t.activity_type), 0)::BIGINT AS clicks FROM (SELECT id_student FROM fact_enrollment WHERE {HERE} AND {GOOD}) e, kinds t"
FORUM = f"SELECT count(*) AS n_students, quantile_cont(clicks, 0.25) AS q25_clicks, median(clicks) AS median_clicks, quantile_cont(clicks, 0.75) AS q75_clicks FROM ({PASS_CLICKS}) WHERE activity_type = 'view'"
TYPE_SHARE = f"SELECT activity_type, clicks, total, {pct('clicks', 'total')} AS pct FROM (SELECT activity_type, sum(sum_click)::BIGINT AS clicks, (SELECT sum(sum_click) FROM fact_vle_daily)::BIGINT AS total FROM site_clicks GROUP BY ALL)"
LATE = f"SELECT count(*) FILTER (is_late) AS n_late, {pct('count(*) FILTER (is_late)', 'count(*)')} AS pct FROM tma"
TEXT = "SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN (props->>'k') || 'a' ELSE props->>'k' END AS k, event_type FROM events"
QUART = "quantile_cont({0}, 0.25) AS q25_{1}, median({0}) AS median_{1}, quantile_cont({0}, 0.75) AS q75_{1}"
FLIP = "CASE final_result WHEN 'Pass' THEN 'Fail' WHEN 'Distinction' THEN 'Withdrawn' WHEN 'Fail' THEN 'Pass' ELSE 'Distinction' END"
RESULT18 = f"SELECT floor(x / y * 10 + 0.5) / 10 FROM (SELECT 100::DOUBLE * count(*) FILTER ({GOOD}) AS x, count(*) AS y, count(DISTINCT id_student) AS n FROM fact_enrollment JOIN dim_student USING (id_student) WHERE code_presentation = '{PRESENTATION}' AND NOT withdrawn_before_start AND imd_band = '{{0}}') WHERE n >= 20"
B18 = f"SELECT rate_low, rate_high, round(abs(rate_high - rate_low), 6) AS gap FROM (SELECT ({RESULT18.format('0-10%')}) AS rate_low, ({RESULT18.format('90-100%')}) AS rate_high)"
null_counts = lambda t, cols: " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows FROM {t}" for c in cols)
keyed = lambda t, k, n=None: f"SELECT '{n or t}' AS table_name, count(*) AS n_rows, count(DISTINCT ({k})) AS n_keys, count(*) = count(DISTINCT ({k})) AS is_unique FROM {t}"
true_counts = lambda t, cols: " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS flag_name, count(*) FILTER ({c}) AS n_true FROM {t}" for c in cols)
falls = lambda c: f"SELECT '{c}' AS measure_name, count(*) AS n_decreases FROM fact_student_week a JOIN fact_student_week b USING ({ENR}) WHERE b.week_no = a.week_no + 1 AND b.{c} < a.{c}"
scen = lambda name, cond: f"SELECT '{name}' AS scenario, * FROM ({EVAL(cond, f'week_no = {RISK_WEEK}')})"
REST = "flag_inactive_2w + flag_missed_tma + flag_low_score"

#: columns of the tables, booleans with a question mark
COLUMNS = {
    "dim_presentation": "code_module code_presentation year semester length_days n_weeks has_exam_result? has_weighted_tma?",
    "dim_student": "id_student gender region highest_education imd_band disability imd_unknown?",
    "dim_assessment": "id_assessment code_module code_presentation assessment_type deadline_raw deadline weight deadline_imputed? zero_weight? assessment_order is_first_weighted_tma? has_submissions?",
    "dim_vle_site": "id_site code_module code_presentation activity_type week_from week_to has_planned_week? never_clicked?",
    "dim_week": "week_no day_from day_to is_pre_start?",
    "fact_vle_daily": "id_student code_module code_presentation id_site date week_no sum_click n_records is_pre_start?",
    "fact_submission": "id_student id_assessment code_module code_presentation date_submitted week_no score days_late is_banked? is_late? score_missing? is_beyond_course? is_pass_score?",
    "fact_enrollment": "id_student code_module code_presentation final_result age_band studied_credits num_of_prev_attempts date_registration date_unregistration total_clicks active_days n_submissions is_withdrawn? withdrawn_before_start? no_vle_activity? reg_date_missing? result_inconsistent? is_repeat?",
    "fact_student_week": "id_student code_module code_presentation week_no clicks_week clicks_cum active_days_week sites_week n_submitted_cum n_late_cum avg_score_cum n_tma_missed_cum is_pre_start? is_week_inactive? is_enrolled?",
}


def promises(name: str) -> str:
    """The metrics of a table's contract in SQL."""
    table, columns = CONTRACT[name], COLUMNS[name].split()
    out = {"rows": "count(*)"}
    for c in (c.rstrip("?") for c in columns):
        if table.nulls.get(c) != ANYWHERE:
            out[f"broken null: {c}"] = f"count(*) FILTER (({c} IS NULL) <> coalesce({table.nulls.get(c, 'false')}, false))"
    out |= {f"broken never: {x}": f"count(*) FILTER ({x})" for x in table.never}
    out |= {f"flag {x}": f"count(*) FILTER ({x})" for x in [*(c[:-1] for c in columns if c[-1] == "?"), *table.flags]}
    out |= {f"sum {x}": f"coalesce(sum({x}), 0)::BIGINT" for x in table.sums}
    names = ", ".join("'" + k.replace("'", "''") + "'" for k in out)
    first, fact = f"SELECT '{name}' AS table_name, unnest([{names}]) AS metric, unnest([{', '.join(out.values())}])::BIGINT AS n FROM {name}", ", ".join(table.keys[:-1])
    falls = "".join(f" UNION ALL SELECT '{name}', 'broken rising: {c}', count(*) FILTER (x < y) FROM (SELECT {c} AS x, lag({c}) OVER (PARTITION BY {fact} ORDER BY {table.keys[-1]}) AS y FROM {name})" for c in table.rising)
    return first + falls


def relation_counts() -> str:
    keys = " UNION ALL ".join(f"SELECT '{n}: key is unique' AS check_name, (count(*) - count(DISTINCT ({', '.join(CONTRACT[n].keys)}, 0)))::BIGINT AS n_failures FROM {n}" for n in COLUMNS)
    links = "".join(f" UNION ALL SELECT '{c} -> {p}', count(*) FROM {c} c WHERE NOT EXISTS (SELECT 1 FROM {p} p WHERE {' AND '.join(f'p.{k} = c.{k}' for k in ks)})" for c, p, ks in LINKS)
    weeks = f" UNION ALL SELECT 'fact_student_week: weeks of the course', count(*) FROM fact_student_week JOIN dim_presentation USING (code_module, code_presentation) WHERE week_no < {FIRST_WEEK} OR week_no >= n_weeks"
    return keys + links + weeks + f" UNION ALL SELECT 'snapshot grid is whole', abs((SELECT count(*) FROM fact_student_week) - (SELECT sum(n_weeks - {FIRST_WEEK}) FROM fact_enrollment JOIN dim_presentation USING (code_module, code_presentation)))::BIGINT"


_SQL: dict[str, str] = {
    "exact_quantiles": f"SELECT code_module, code_presentation, week_no, count(*) AS n_active, {QUART.format('clicks_cum', 'clicks')}, count(avg_score_cum) AS n_scored, {QUART.format('avg_score_cum', 'score')} FROM fact_student_week WHERE is_enrolled GROUP BY ALL",
    "layout_effect": f"SELECT layout, final_result, clicks, n, partitions_read, shuffles_to_join FROM (SELECT final_result, sum(clicks_week)::BIGINT AS clicks, count(*) AS n FROM fact_student_week JOIN fact_enrollment USING ({ENR}) WHERE week_no BETWEEN {RISK_WEEK - 1} AND {RISK_WEEK} AND code_module = '{MODULE}' GROUP BY ALL), (VALUES ('plain', 0::BIGINT, 2::BIGINT), ('partitioned', 2, 2), ('sorted', 0, 2), ('bucketed', 0, 0)) t(layout, partitions_read, shuffles_to_join)",
    "scaled_answers": f"SELECT workload, layout, factor, measure, value FROM (SELECT 'q07' AS workload, 'late' AS measure, n_late::BIGINT AS value FROM ({LATE}) UNION ALL SELECT 'q07', 'pct', round(pct * 10)::BIGINT FROM ({LATE}) UNION ALL SELECT 'q09', 'clicks ' || activity_type, clicks FROM ({TYPE_SHARE}) UNION ALL SELECT 'q09', 'pct ' || activity_type, round(pct * 10)::BIGINT FROM ({TYPE_SHARE}) UNION ALL SELECT 'q18', 'low', round(rate_low * 10)::BIGINT FROM ({B18}) UNION ALL SELECT 'q18', 'high', round(rate_high * 10)::BIGINT FROM ({B18})), (VALUES ('star'), ('norm'), ('wide')) k(layout), (VALUES (1::BIGINT), (5)) f(factor)",
    "bag_difference": f"SELECT * FROM (SELECT {ENR}, date, coalesce(l, 0)::BIGINT AS n_left, coalesce(r, 0)::BIGINT AS n_right FROM (SELECT {ENR}, date, sum(CASE WHEN date = 0 THEN 2 ELSE 1 END) AS l FROM fact_vle_daily GROUP BY ALL) FULL JOIN (SELECT {ENR}, date, count(*) AS r FROM student_vle WHERE id_site % 2 = 0 GROUP BY ALL) USING ({ENR}, date)) WHERE n_left <> n_right",
    "contract_report": " UNION ALL ".join(map(promises, COLUMNS)), "contract_relations": relation_counts(),
    "typed_cast": f"SELECT event_id, try_cast(k AS BIGINT) AS k, event_type FROM ({TEXT})",
    "bad_cast_audit": f"SELECT 'event_id' AS column_name, 0::BIGINT AS n_bad UNION ALL SELECT 'k', count(*) FROM ({TEXT}) WHERE k IS NOT NULL AND try_cast(k AS BIGINT) IS NULL",
    "null_profile": null_counts("fact_submission", ["id_student", "id_assessment", "code_module", "code_presentation", "date_submitted", "week_no", "score", "days_late", "is_banked", "is_late", "score_missing", "is_beyond_course", "is_pass_score"]),
    "count_reconcile": "SELECT *, n_left = n_right AS is_equal FROM (SELECT 'fact_submission' AS table_name, (SELECT count(*) FROM fact_submission) AS n_left, (SELECT count(*) FROM student_assessment) AS n_right UNION ALL SELECT 'fact_enrollment', (SELECT count(*) FROM fact_enrollment), (SELECT count(*) FROM student_info) UNION ALL SELECT 'fact_vle_daily', (SELECT count(*) FROM fact_vle_daily), (SELECT count(*) FROM student_vle))",
    "floor_week": "SELECT date, floor(date / 7.0)::BIGINT AS week_no, count(*) AS n FROM student_vle GROUP BY ALL",
    "enrolled_at": "SELECT week_no, count(*) AS n FROM fact_enrollment, dim_week WHERE date_unregistration IS NULL OR date_unregistration > day_to GROUP BY ALL",
    "safe_rate": f"SELECT id_assessment, NULL::DOUBLE AS null_rate, {pct('0', 'count(*) FILTER (is_late) + 1')} AS rate FROM fact_submission GROUP BY ALL",
    "offering_labels": f"SELECT DISTINCT {OFF}, code_module || ' ' || code_presentation AS label FROM fact_enrollment",
    "event_week_window": f"SELECT week_no, sum(c)::BIGINT AS clicks, count(*) AS n_keys FROM (SELECT {ENR}, floor(date / 7.0)::BIGINT AS week_no, sum(sum_click) AS c FROM student_vle GROUP BY ALL) GROUP BY ALL",
    "offering_dim": "SELECT * FROM dim_presentation", "band_repair": "SELECT * FROM dim_student", "item_dim": "SELECT * FROM dim_assessment", "item_order": "SELECT id_assessment, assessment_order FROM dim_assessment",
    "impute_with_flag": "SELECT id_assessment, deadline_raw, deadline, deadline_imputed FROM dim_assessment", "first_qualifying": f"SELECT {OFF}, id_assessment FROM dim_assessment WHERE is_first_weighted_tma",
    "site_dim": "SELECT * FROM dim_vle_site", "mark_exists": "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM orders", "week_dimension": "SELECT * FROM dim_week",
    "daily_fact": "SELECT * FROM fact_vle_daily", "submission_flags": "SELECT * FROM fact_submission", "enrollment_flags": "SELECT * FROM fact_enrollment",
    "missed_items": f"SELECT {ENR}, week_no, n_tma_missed_cum FROM fact_student_week WHERE n_tma_missed_cum > 0",
    "period_grid": f"SELECT {OFF}, w::BIGINT AS week_no FROM dim_presentation, range({FIRST_WEEK}, 100) r(w) WHERE w < n_weeks",
    "weekly_activity": f"SELECT {ENR}, week_no, sum(sum_click)::BIGINT AS clicks_week, count(DISTINCT date) AS active_days_week, count(DISTINCT id_site) AS sites_week FROM fact_vle_daily GROUP BY ALL",
    "running_totals": f"SELECT {ENR}, week_no, clicks_cum, n_submitted_cum, n_late_cum, avg_score_cum FROM fact_student_week", "student_week": "SELECT * FROM fact_student_week",
    "replicate": "SELECT c_custkey + 1000000 * i AS c_custkey, c_acctbal FROM customer, range(5) r(i)",
    "clicks_by_type": "SELECT activity_type, sum(sum_click)::BIGINT AS total_clicks, count(DISTINCT id_site) AS n_sites FROM site_clicks GROUP BY ALL",
    "prev_week_clicks": f"SELECT {ENR}, a.week_no, a.clicks_week, coalesce(b.clicks_week, 0) AS clicks_before_week FROM fact_student_week a LEFT JOIN (SELECT {ENR}, week_no + 1 AS next, clicks_week FROM fact_student_week) b USING ({ENR}) WHERE b.next = a.week_no OR a.week_no = {FIRST_WEEK} AND b.next = {FIRST_WEEK + 1}".replace("coalesce(b.clicks_week, 0)", f"CASE WHEN a.week_no = {FIRST_WEEK} THEN 0 ELSE b.clicks_week END"),
    "clicks_before_deadline": "SELECT * FROM pairs", "enrolled_by_week": "SELECT * FROM live", "activity_grid": PASS_CLICKS,
    "overall_stats": "SELECT (SELECT count(*) FROM dim_presentation) AS n_offerings, (SELECT count(*) FROM fact_enrollment) AS n_enrollments, (SELECT count(DISTINCT id_student) FROM fact_enrollment) AS n_students, (SELECT count(*) FROM fact_submission) AS n_submissions, (SELECT sum(sum_click) FROM fact_vle_daily)::BIGINT AS total_clicks",
    "cohort_quantiles": f"SELECT week_no, count(*) AS n_active, {QUART.format('clicks_cum', 'clicks')}, {QUART.format('avg_score_cum', 'score')} FROM fact_student_week WHERE {HERE} AND is_enrolled GROUP BY ALL",
    "quantile_manual": f"SELECT {OFF}, week_no, quantile_cont(clicks_cum, 0.25) AS p25_clicks, count(*) AS n FROM fact_student_week WHERE is_enrolled GROUP BY ALL",
    "median_manual": "SELECT week_no, median(sum_click) AS median_clicks, count(*) AS n FROM fact_vle_daily GROUP BY ALL",
    "average_rank": f"SELECT {ENR}, clicks_rank, score_rank FROM ranks", "spearman": "SELECT * FROM rho",
    "spearman_ci": "SELECT *, CASE WHEN n > 3 THEN CASE WHEN abs(rho) >= 1 THEN rho ELSE tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)) END END AS ci_low, CASE WHEN n > 3 THEN CASE WHEN abs(rho) >= 1 THEN rho ELSE tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)) END END AS ci_high FROM rho",
    "spearman_pairs": f"SELECT {ENR}, clicks_before, score, n, rho FROM pairs JOIN rho USING ({OFF})", "latest_by_key": "SELECT * FROM newest",
    "week_ranks": f"SELECT DISTINCT {OFF}, week_no, average_rank, total_rank FROM activity", "result_share": f"SELECT final_result, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM fact_enrollment)')} AS pct FROM fact_enrollment GROUP BY ALL",
    "percent_rank_student": f"SELECT *, CASE WHEN clicks_percentile >= 75 THEN 'top quarter' WHEN clicks_percentile >= 25 THEN 'middle half' ELSE 'bottom quarter' END AS clicks_band FROM (SELECT {ENR}, clicks_cum, 100 * percent_rank() OVER (PARTITION BY {OFF} ORDER BY clicks_cum) AS clicks_percentile, avg_score_cum, CASE WHEN avg_score_cum IS NOT NULL THEN 100 * percent_rank() OVER (PARTITION BY {OFF}, avg_score_cum IS NULL ORDER BY avg_score_cum) END AS score_percentile FROM fact_student_week WHERE week_no = {SAMPLE_WEEK} AND is_enrolled)",
    "monotone_check": " UNION ALL ".join(map(falls, ("clicks_cum", "n_submitted_cum", "n_late_cum", "avg_score_cum"))),
    "missing_offering_list": f"SELECT count(*) FILTER (f) AS n_with, count(*) FILTER (NOT f) AS n_without, string_agg(CASE WHEN NOT f THEN code_module || ' ' || code_presentation END, ', ' ORDER BY {OFF}) AS without_list FROM (SELECT {OFF}, ({OFF}) IN (SELECT ({OFF}) FROM dim_assessment WHERE is_first_weighted_tma) AS f FROM dim_presentation)",
    "band_pivot": "SELECT code_presentation, " + ", ".join(f"{pct(f'''count(*) FILTER ({GOOD} AND imd_band = '{b}')''', f'''count(*) FILTER (imd_band = '{b}')''')} AS rate_{n}" for b, n in (("0-10%", "low"), ("10-20%", "next"), ("90-100%", "high"), ("Unknown", "unknown"))) + " FROM fact_enrollment JOIN dim_student USING (id_student) GROUP BY ALL",
    "share_matrix": "SELECT activity_type, " + ", ".join(f"max(activity_share) FILTER (week_no = {k}) AS week_{k}" for k in range(4)) + f" FROM activity WHERE {HERE} GROUP BY ALL",
    "click_profile": "SELECT final_result, count(*) AS n, avg(total_clicks) AS avg_clicks, stddev_pop(total_clicks) AS sd_clicks, min(total_clicks) AS min_clicks, max(total_clicks) AS max_clicks FROM fact_enrollment GROUP BY ALL",
    "top_week": "SELECT week_no, sum(sum_click)::BIGINT AS total_clicks FROM fact_vle_daily GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 1",
    "top5_trend": "SELECT week_no, activity_type, sum(sum_click)::BIGINT AS total_clicks FROM site_clicks WHERE activity_type IN (SELECT activity_type FROM site_clicks GROUP BY ALL ORDER BY sum(sum_click) DESC, activity_type LIMIT 3) GROUP BY ALL",
    "overview": f"SELECT {OFF}, {OVER} GROUP BY ALL UNION ALL SELECT NULL, NULL, {OVER}", "overview_rates": RATES,
    "attention_list": f"(SELECT 'withdrawal' AS list_name, {OFF}, withdrawal_rate AS rate FROM ({RATES}) ORDER BY rate DESC, {OFF} LIMIT 3) UNION ALL (SELECT 'pass', {OFF}, pass_rate FROM ({RATES}) ORDER BY pass_rate, {OFF} LIMIT 3)",
    "assessment_stats": ITEMS, "assessment_scores": f"SELECT id_student, assessment_type || ' ' || id_assessment AS assessment_label, deadline, score FROM fact_submission JOIN (SELECT id_assessment, assessment_type, deadline FROM dim_assessment) USING (id_assessment) WHERE {HERE} AND score IS NOT NULL",
    "assessment_kpis": f"SELECT count(*) AS n_assessments, avg(submission_rate_pct) AS mean_submission_rate, avg(late_rate_pct) AS mean_late_rate, median(median_score) AS median_of_medians FROM ({ITEMS})",
    "module_scores": "SELECT *, code_module = first_value(code_module) OVER (ORDER BY avg_score DESC, code_module DESC) AS is_best, code_module = first_value(code_module) OVER (ORDER BY avg_score, code_module) AS is_worst FROM (SELECT code_module, count(*) AS n_tma_submissions, count(*) FILTER (is_late) AS n_late, count(score) AS n_scored, avg(score) AS avg_score FROM tma GROUP BY ALL)",
    "submission_overview": f"SELECT s.code_module, s.code_presentation, count(DISTINCT id_assessment) AS n_assessments, count(*) AS n_submissions, count(*) FILTER (is_late) AS n_late, {pct('count(*) FILTER (is_late)', 'count(*) FILTER (NOT is_banked)')} AS late_rate_pct, avg(score) AS avg_score, median(score) AS median_score FROM fact_submission s JOIN dim_assessment USING (id_assessment) WHERE assessment_type <> 'Exam' GROUP BY ALL",
    "assessment_detail": f"SELECT id_assessment, assessment_type, assessment_order, deadline, active_students, submitted_total, banked_students, late_submissions, {pct('submitted_total', 'active_students')} AS submission_rate_pct, {pct('late_submissions', 'submitted_regular')} AS late_rate_pct, {pct('passed_students', 'submitted_total - banked_students')} AS pass_rate_pct, avg_score, median_score, q1_score, q3_score, min_score, max_score FROM items WHERE {HERE}",
    "assessment_summary": f"SELECT {ITEM}::BIGINT AS id_assessment, submitted_total AS n_submitted, active_students, {pct('submitted_total', 'active_students')} AS submission_rate_pct, (SELECT {pct('count(*) FILTER (is_late)', 'count(*) FILTER (NOT is_banked)')} FROM fact_submission WHERE id_assessment = {ITEM}) AS late_rate_pct, median_score FROM items WHERE id_assessment = {ITEM}",
    "weekly_activity_mart": "SELECT * FROM activity", "weekly_activity_slice": f"SELECT * FROM activity WHERE {HERE}", "clicks_by_week_type": "SELECT week_no, activity_type, sum(sum_click)::BIGINT AS total_clicks FROM site_clicks GROUP BY ALL",
    "deadline_weeks": f"SELECT DISTINCT floor(deadline / 7.0)::BIGINT AS week_no FROM dim_assessment WHERE {HERE} AND assessment_type = 'TMA'",
    "risk_flags": f"SELECT {ENR}, week_no, clicks_cum, clicks_week, avg_score_cum, n_tma_missed_cum, flag_low_clicks, flag_inactive_2w, flag_missed_tma, flag_low_score, risk_score, final_result, is_unsuccessful FROM flags WHERE week_no = {RISK_WEEK}",
    "risk_summary": f"SELECT {OFF}, count(*) AS n_active, count(*) FILTER (risk_score >= 2) AS n_at_risk, {pct('count(*) FILTER (risk_score >= 2)', 'count(*)')} AS at_risk_rate_pct, count(*) FILTER (risk_score >= 3) AS n_high, count(*) FILTER (risk_score = 2) AS n_medium FROM flags WHERE week_no = {RISK_WEEK} GROUP BY ALL",
    "risk_list": f"SELECT id_student, risk_score, CASE WHEN risk_score > 2 THEN 'high' ELSE 'medium' END AS risk_level, clicks_cum, clicks_week, avg_score_cum, n_tma_missed_cum, row_number() OVER (PARTITION BY code_module, code_presentation ORDER BY risk_score DESC, clicks_cum, id_student) AS position FROM flags WHERE week_no = {RISK_WEEK} AND {HERE} AND risk_score >= 2",
    "risk_eval": EVAL_WEEKS("true"),
    "risk_sensitivity": " UNION ALL ".join([scen(f"only {f}", f"{f} = 1") for f in ("flag_low_clicks", "flag_inactive_2w", "flag_missed_tma", "flag_low_score")] + [scen(f"at least {k}", f"risk_score >= {k}") for k in (1, 2, 3, 4)] + [scen(f"two, clicks p{q}", f"low{q} + {REST} >= 2") for q in (10, 50)]),
    "label_flip": f"SELECT count(*) AS n_before, count(*) AS n_after, count(*) AS n_same, {pct('sum(is_unsuccessful)', 'count(*)')} AS precision_before, {pct('sum(1 - is_unsuccessful)', 'count(*)')} AS precision_after FROM flags WHERE week_no = {RISK_WEEK} AND risk_score >= 2",
    "risk_distribution": f"SELECT 'score' AS kind, risk_score::VARCHAR AS name, count(*) AS n FROM flags WHERE week_no = {RISK_WEEK} AND {HERE} GROUP BY ALL" + "".join(f" UNION ALL SELECT 'flag', '{f}', coalesce(sum({f}), 0)::BIGINT FROM flags WHERE week_no = {RISK_WEEK} AND {HERE}" for f in ("flag_low_clicks", "flag_inactive_2w", "flag_missed_tma", "flag_low_score")),
    "retention_curve": f"SELECT code_module || ' ' || code_presentation AS cohort, week_no, day_to, n_left, n_enrollments, left_rate_pct, retention_rate_pct FROM ({HAZARD})", "withdrawal_hazard": HAZARD,
    "withdrawal_summary": f"SELECT count(*) AS n_enrollments, " + ", ".join(f"count(*) FILTER ({c}) AS n_{k}, {pct(f'count(*) FILTER ({c})', 'count(*)')} AS pct_{k}" for k, c in (("day_0", "is_withdrawn AND date_unregistration <= 0"), ("day_27", "is_withdrawn AND date_unregistration <= 27"), ("total", "is_withdrawn"))) + ", median(date_unregistration) FILTER (is_withdrawn) AS median_day, code_module || ' ' || code_presentation AS presentation FROM fact_enrollment GROUP BY ALL",
    "withdrawal_school": "SELECT count(*) AS n_withdrawn, count(*) FILTER (date_unregistration IS NULL) AS n_no_date, count(*) FILTER (date_unregistration <= 0) AS n_by_day_0, median(date_unregistration) AS median_day, floor(median(date_unregistration) / 7)::BIGINT AS median_week FROM fact_enrollment WHERE is_withdrawn",
    "withdrawal_quartiles": f"SELECT {QUART.format('date_unregistration', 'day')} FROM fact_enrollment WHERE is_withdrawn", "suppressed_gap": gap(30), "suppressed_gap_20": gap(20),
    "student_progress": f"SELECT week_no, clicks_week, clicks_cum, avg_score_cum, n_tma_missed_cum, is_enrolled, final_result FROM fact_student_week JOIN fact_enrollment USING ({ENR}) WHERE {HERE} AND id_student = {WHO}",
    "offering_students": f"SELECT DISTINCT id_student FROM fact_enrollment WHERE {HERE}",
    "student_vs_ribbon": f"SELECT s.week_no, s.clicks_cum, n_active, q25_clicks, median_clicks, q75_clicks FROM fact_student_week s LEFT JOIN (SELECT week_no, count(*) AS n_active, {QUART.format('clicks_cum', 'clicks')} FROM fact_student_week WHERE {HERE} AND is_enrolled GROUP BY ALL) r USING (week_no) WHERE {HERE} AND id_student = {WHO}",
    "activity_quartiles": FORUM,
    "student_vs_pass": f"SELECT *, CASE WHEN student_clicks < median_clicks THEN 'below' WHEN student_clicks > median_clicks THEN 'above' WHEN median_clicks IS NOT NULL THEN 'equal' END AS side FROM (SELECT activity_type, count(*) AS n_pass, CASE WHEN count(*) >= 5 THEN quantile_cont(clicks, 0.25) END AS q25_clicks, CASE WHEN count(*) >= 5 THEN median(clicks) END AS median_clicks, CASE WHEN count(*) >= 5 THEN quantile_cont(clicks, 0.75) END AS q75_clicks, coalesce((SELECT sum(sum_click) FROM site_clicks c WHERE c.id_student = {WHO} AND c.{HERE.replace(' AND ', ' AND c.')} AND c.week_no = {SAMPLE_WEEK} AND c.activity_type = p.activity_type), 0)::BIGINT AS student_clicks FROM ({PASS_CLICKS}) p GROUP BY ALL)",
    "students_in_week": f"SELECT id_student FROM fact_student_week WHERE {HERE} AND week_no = {RISK_WEEK} AND is_enrolled",
    "stream_live_weekly": "SELECT week_no, sum(clicks_week)::BIGINT AS clicks_stream, count(*) AS student_weeks, max(batch_id) AS last_batch FROM newest GROUP BY ALL",
    "live_vs_batch": f"SELECT week_no, clicks_batch, coalesce(clicks_stream, 0) AS clicks_stream, {pct('coalesce(clicks_stream, 0)', 'clicks_batch')} AS done_pct FROM (SELECT week_no, sum(sum_click)::BIGINT AS clicks_batch FROM fact_vle_daily GROUP BY ALL) LEFT JOIN (SELECT week_no, sum(clicks_week)::BIGINT AS clicks_stream FROM log WHERE batch_id = 0 GROUP BY ALL) USING (week_no)",
    "offering_week_type": f"SELECT week_no, activity_type, sum(sum_click)::BIGINT AS total_clicks FROM site_clicks WHERE {HERE} GROUP BY ALL",
    "timeline_flat": f"SELECT week_no, clicks_week, clicks_cum, avg_score_cum, n_tma_missed_cum, is_enrolled FROM fact_student_week WHERE {HERE} AND id_student = {WHO}",
    "q01": "SELECT count(*) AS n_enrollments, count(DISTINCT id_student) AS n_students FROM fact_enrollment", "q03": f"SELECT {OFF}, count(*) AS n_enrollments FROM fact_enrollment GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 1",
    "q04": f"SELECT count(*) FILTER (no_vle_activity) AS n_without_clicks, {pct('count(*) FILTER (no_vle_activity)', 'count(*)')} AS pct FROM fact_enrollment",
    "q05": f"SELECT count(*) AS n_eligible, count(d) AS n_submitted, {pct('count(d)', 'count(*)')} AS pct FROM (SELECT e.id_student, s.id_student AS d, s.is_banked FROM fact_enrollment e JOIN dim_assessment a USING ({OFF}) LEFT JOIN fact_submission s ON s.id_student = e.id_student AND s.id_assessment = a.id_assessment WHERE a.id_assessment = {ITEM} AND (date_unregistration IS NULL OR date_unregistration > deadline)) WHERE NOT coalesce(is_banked, false)",
    "q06": f"SELECT id_assessment, deadline, {pct('count(*) FILTER (is_late)', 'count(*)')} AS pct_late FROM tma JOIN (SELECT id_assessment, deadline FROM dim_assessment) USING (id_assessment) WHERE {HERE} GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 1", "q07": LATE, "q08": "SELECT code_module, avg(score) AS avg_score FROM tma GROUP BY ALL",
    "q09": f"{TYPE_SHARE} ORDER BY clicks DESC, activity_type LIMIT 1",
    "q11": f"SELECT count(*) AS n_enrolled, coalesce(sum(clicks_week), 0)::BIGINT AS total_clicks, avg(clicks_week) AS clicks_per_student FROM fact_student_week WHERE {HERE} AND week_no = {SAMPLE_WEEK} AND is_enrolled",
    "q13": f"SELECT n, rho FROM rho WHERE {HERE}", "q14": f"SELECT n_active, n_flagged, precision_pct, base_rate_pct FROM ({EVAL_WEEKS(f'week_no = {RISK_WEEK}')})",
    "q15": f"SELECT count(*) FILTER (date_unregistration <= 0) AS n_by_day_0, count(*) AS n_withdrawn, {pct('count(*) FILTER (date_unregistration <= 0)', 'count(*)')} AS pct FROM fact_enrollment WHERE is_withdrawn",
    "q16": "SELECT count(date_unregistration) AS n_dated, median(date_unregistration) AS median_day FROM fact_enrollment WHERE is_withdrawn", "q17": f"SELECT {OFF}, {pct('count(*) FILTER (is_withdrawn)', 'count(*)')} AS pct_withdrawn FROM fact_enrollment GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 1",
    "q18": f"SELECT code_presentation, passed_rate_low, passed_rate_high, passed_gap FROM ({gap(5, f'''code_presentation = '{PRESENTATION}' AND code_module IN ('BUILDING', 'FURNITURE', 'MACHINERY')''')})",
    "q19": f"SELECT count(*) AS n_enrolled, median(clicks_cum) AS median_clicks FROM fact_student_week WHERE {HERE} AND week_no = {SAMPLE_WEEK} AND is_enrolled", "q20": FORUM,
    "normalized_submission": "SELECT * FROM fact_submission", "normalized_clicks": "SELECT * FROM fact_vle_daily",
    "wide_enrollment": f"SELECT e.*, gender, region, highest_education, imd_band, disability, year, semester, length_days, n_weeks FROM fact_enrollment e LEFT JOIN dim_student USING (id_student) LEFT JOIN dim_presentation USING ({OFF})",
    "wide_submission": f"SELECT s.*, assessment_type, deadline, weight, is_first_weighted_tma, gender, region, highest_education, imd_band, disability, year, semester, length_days, n_weeks FROM fact_submission s LEFT JOIN (SELECT id_assessment, assessment_type, deadline, weight, is_first_weighted_tma FROM dim_assessment) USING (id_assessment) LEFT JOIN dim_student USING (id_student) LEFT JOIN dim_presentation USING ({OFF})",
    "wide_clicks": f"SELECT v.*, activity_type, week_from, gender, region, highest_education, imd_band, disability, year, semester, length_days, n_weeks FROM fact_vle_daily v LEFT JOIN (SELECT id_site, activity_type, week_from FROM dim_vle_site) USING (id_site) LEFT JOIN dim_student USING (id_student) LEFT JOIN dim_presentation USING ({OFF})",
    "wide_student_week": f"SELECT w.*, gender, region, highest_education, imd_band, disability, year, semester, length_days, n_weeks FROM fact_student_week w LEFT JOIN dim_student USING (id_student) LEFT JOIN dim_presentation USING ({OFF})",
    "layout_validate": "SELECT *, true AS is_whole FROM (" + keyed("fact_submission", "id_student, id_assessment", "wide_submission") + " UNION ALL " + keyed("fact_student_week", f"{ENR}, week_no", "wide_student_week") + ")",
    "layout_partition_pruned": f"SELECT week_no, {OFF}, sum(clicks_week)::BIGINT AS clicks FROM fact_student_week WHERE week_no BETWEEN {RISK_WEEK - 1} AND {RISK_WEEK} GROUP BY ALL",
    "nested_timeline": f"SELECT {ENR}, count(*) AS n_weeks, min(week_no) AS first_week, sum(clicks_week)::BIGINT AS clicks FROM fact_student_week GROUP BY ALL", "timeline_unnest": f"SELECT {ENR}, {DOC} FROM fact_student_week WHERE {HERE}",
    "nested_prev_week": f"SELECT {ENR}, sum(clicks_week) FILTER (week_no = {RISK_WEEK})::BIGINT AS clicks_week, sum(clicks_week) FILTER (week_no = {RISK_WEEK - 1})::BIGINT AS clicks_before_week FROM fact_student_week GROUP BY ALL",
    "document_build": f"SELECT {ENR}, count(*) AS n_weeks, max(clicks_cum) FILTER (week_no = {FIRST_WEEK + 1}) AS second_clicks_cum FROM fact_student_week GROUP BY ALL", "document_timeline": f"SELECT {ENR}, {DOC} FROM fact_student_week", "document_crosscut": CROSS, "flat_crosscut": CROSS,
    "json_decode": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events",
    **{f"bench_q07_{k}": LATE for k in ("star", "norm", "wide")}, **{f"bench_q09_{k}": TYPE_SHARE for k in ("star", "norm", "wide")}, **{f"bench_q14_{k}": EVAL_WEEKS(f"week_no = {RISK_WEEK}") for k in ("star", "norm", "wide")}, **{f"bench_q18_{k}": B18 for k in ("star", "norm", "wide")},
    "pk_unique": " UNION ALL ".join([keyed("customer", "c_custkey, 0", "customer"), keyed("lineitem", "l_orderkey, l_linenumber"), keyed("fact_student_week", f"{ENR}, week_no")]),
    "fk_orphans": "SELECT 'orders without lines' AS link_name, count(*) AS n_orphans FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'clicks without enrolment', 0",
    "flag_counts": true_counts("fact_enrollment", ["is_withdrawn", "withdrawn_before_start", "no_vle_activity", "reg_date_missing", "result_inconsistent", "is_repeat"]) + " UNION ALL " + true_counts("fact_submission", ["is_banked", "is_late", "score_missing", "is_beyond_course", "is_pass_score"]),
    "sum_conservation": " UNION ALL ".join(f"SELECT '{n}' AS measure_name, (SELECT sum({c}) FROM {t})::BIGINT AS total, (SELECT sum({c}) FROM {t}) = (SELECT sum(sum_click) FROM student_vle) AS is_equal" for n, t, c in (("raw", "student_vle", "sum_click"), ("daily", "fact_vle_daily", "sum_click"), ("enrollment", "fact_enrollment", "total_clicks"), ("snapshot", "fact_student_week", "clicks_week"))),
    "grid_complete": f"SELECT {ENR}, {FIRST_WEEK}::BIGINT AS first_period, max(week_no) AS last_period, count(*) - 1 AS n_periods FROM fact_student_week WHERE id_student % 10 = 3 GROUP BY ALL",
    "fd_violations": "SELECT 'customer -> nation' AS dependency, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY ALL HAVING count(DISTINCT c_nationkey) > 1)) AS n_violations UNION ALL SELECT 'brand -> type', (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1))",
    "duplicate_groups": "SELECT 'lineitem' AS table_name, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "scale_rates": " UNION ALL ".join(f"SELECT {k}::BIGINT AS factor, {k} * count(*) AS n, {k} * count(DISTINCT id_student) AS people, {pct('count(*) FILTER (is_withdrawn)', 'count(*)')} AS withdrawn_pct FROM fact_enrollment" for k in (1, 5)),
    "frame_differences": f"SELECT {ENR}, CASE WHEN id_student % 4 = 0 THEN 'only left' ELSE 'values differ' END AS problem FROM fact_enrollment WHERE id_student % 4 = 0 OR final_result <> {FLIP}",
    "stream_batch_compare": f"SELECT week_no, count(b) AS n_batch, count(s) AS n_stream, count(*) FILTER (coalesce(b, 0) <> coalesce(s, 0)) AS n_week_differs, count(*) FILTER (cb <> cs) AS n_cum_differs, count(*) FILTER (b IS NULL) AS n_stream_only, sum(coalesce(b, 0))::BIGINT AS clicks_batch, sum(coalesce(s, 0))::BIGINT AS clicks_stream FROM (SELECT *, sum(coalesce(b, 0)) OVER (PARTITION BY {ENR} ORDER BY week_no) AS cb, sum(coalesce(s, 0)) OVER (PARTITION BY {ENR} ORDER BY week_no) AS cs FROM (SELECT {ENR}, floor(date / 7.0)::BIGINT AS week_no, sum(sum_click) AS b FROM student_vle GROUP BY ALL) FULL JOIN (SELECT {ENR}, week_no, clicks_week AS s FROM log WHERE batch_id = 0) USING ({ENR}, week_no)) GROUP BY ALL",
    "bench_summary": "SELECT week_no, median(sum_click) AS median, min(sum_click) AS low, max(sum_click) AS high, quantile_cont(sum_click, 0.75) - quantile_cont(sum_click, 0.25) AS iqr FROM fact_vle_daily GROUP BY ALL",
}
for _new, _of in {"risk_flags_offering": f"SELECT * FROM ({_SQL['risk_flags']}) WHERE {HERE}", "q02": _SQL["result_share"], "q10": _SQL["top_week"], "q12": _SQL["missing_offering_list"]}.items():
    _SQL[_new] = _of
ORACLES: dict[str, str] = {name: f"{BASE} {sql}" for name, sql in _SQL.items()}
