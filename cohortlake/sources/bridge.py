"""The seven raw course tables, derived from customer, nation, region and events (FIXTURES.md, section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODULES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TYPES = ["click", "error", "purchase", "signup", "view"]
EDUCATION = ["None", "Lower", "Upper", "Bachelor", "Master"]
AGES = ["0-35", "35-55", "55+"]
FIRST_DAY = "2024-01-08"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _offering_no() -> F.Column:
    module = F.array_position(F.array(*map(F.lit, MODULES)), F.col("code_module")) - 1
    return (2 * module + F.when(F.col("code_presentation") == "2024J", 1).otherwise(0)).cast("int")


def offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offerings that customers are in: their market segment, in one of two terms."""
    term = F.when(F.col("c_custkey") % 2 == 0, "2024B").otherwise("2024J")
    codes = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("code_module"), term.alias("code_presentation")).distinct()
    return codes.withColumn("offering_no", _offering_no())


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with events, with their first offering."""
    active = _read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    got = _read(spark, sf_dir, "customer").join(active, "c_custkey", "left_semi")
    first = F.when(F.col("c_custkey") % 2 == 0, "2024B").otherwise("2024J")
    return got.withColumn("code_module", F.col("c_mktsegment")).withColumn("code_presentation", first).withColumn("id_student", F.col("c_custkey"))


def _enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second enrolments, with ``is_first``."""
    first = students(spark, sf_dir).withColumn("is_first", F.lit(True))
    other = F.when(F.col("code_presentation") == "2024B", "2024J").otherwise("2024B")
    second = first.where("id_student % 6 = 0").withColumn("code_presentation", other).withColumn("is_first", F.lit(False))
    return first.unionByName(second)


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """courses, assessments, vle, student_info, student_registration, student_assessment, student_vle."""
    offering = offerings(spark, sf_dir)
    courses = offering.select("code_module", "code_presentation", F.when(F.col("code_presentation") == "2024B", 42).otherwise(35).alias("module_presentation_length"))

    a = F.col("a")
    weight = F.when((F.col("code_module") == "MACHINERY") & (a < 3), 0.0).otherwise(_pick(["0", "20", "30", "0", "50"], a).cast("double"))
    assessments = offering.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "code_module", "code_presentation", (100 * F.col("offering_no") + a).cast("int").alias("id_assessment"), _pick(["TMA", "TMA", "TMA", "CMA", "Exam"], a).alias("assessment_type"),
        F.when(a < 4, 5 * a + 2).cast("int").alias("date"), weight.alias("weight"),
    )
    k = F.col("k")
    places = offering.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    planned = F.when(k % 2 == 0, k)
    vle = places.select((1000 * F.col("offering_no") + 20 * F.col("t") + k).cast("int").alias("id_site"), "code_module", "code_presentation", _pick(TYPES, F.col("t")).alias("activity_type"), planned.alias("week_from"), planned.alias("week_to"))

    place = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    enrolled = _enrolments(spark, sf_dir)
    s, nation, balance = F.col("id_student"), F.col("c_nationkey"), F.col("c_acctbal")
    band = F.when(nation < 3, None).when(nation < 6, "10-20").when(nation < 14, "0-10%").otherwise("90-100%")
    result = F.when(~F.col("is_first") | (balance < 0), "Withdrawn").when(balance < 3000, "Fail").when(balance < 8000, "Pass").otherwise("Distinction")
    info = enrolled.join(place, "c_nationkey").select(
        "code_module", "code_presentation", "id_student", F.when(s % 2 == 0, "F").otherwise("M").alias("gender"), "region", _pick(EDUCATION, s % 5).alias("highest_education"), band.alias("imd_band"), _pick(AGES, s % 3).alias("age_band"),
        F.when(F.col("is_first"), s % 3).otherwise(0).cast("int").alias("num_of_prev_attempts"), (30 + 30 * (s % 4)).cast("int").alias("studied_credits"), F.when(s % 9 == 0, "Y").otherwise("N").alias("disability"), result.alias("final_result"),
    )
    left = F.when(~F.col("is_first"), None).when((balance < 0) & (s % 11 != 0), s % 30 - 5).when(s % 29 == 0, 12)
    registration = enrolled.select("code_module", "code_presentation", "id_student", F.when(s % 19 != 0, -10 - s % 20).cast("int").alias("date_registration"), left.cast("int").alias("date_unregistration"))

    events = _read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("id_student"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    first = students(spark, sf_dir).select("id_student", "code_module", "code_presentation")
    clicks = events.join(first, "id_student")
    day = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date"))  # whole days, floored
    clicks = clicks.withColumn("date", day).withColumn("offering_no", _offering_no())
    site = 1000 * F.col("offering_no") + 20 * (F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1) + k % 10
    student_vle = clicks.where("not (id_student % 7 = 0 and date >= 7)").select("code_module", "code_presentation", "id_student", site.cast("int").alias("id_site"), "date", (1 + F.floor(F.col("value") / 10)).cast("int").alias("sum_click"))
    handed = clicks.where("event_type = 'purchase'").withColumn("a", k % 5)
    handed = handed.withColumn("rn", F.row_number().over(Window.partitionBy("id_student", "a").orderBy("ts", "event_id"))).where("rn = 1")
    student_assessment = handed.select(
        (100 * F.col("offering_no") + a).cast("int").alias("id_assessment"), "id_student", F.col("date").alias("date_submitted"), F.when((s + a) % 17 == 0, 1).otherwise(0).alias("is_banked"),
        F.when(k % 23 != 0, F.least(F.lit(100.0), F.floor("value").cast("double"))).alias("score"),
    )
    return {"courses": courses, "assessments": assessments, "vle": vle, "student_info": info, "student_registration": registration, "student_assessment": student_assessment, "student_vle": student_vle}
