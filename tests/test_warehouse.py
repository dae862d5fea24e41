"""Builders, gate, pipeline and layouts on small tables worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import quality as Q
from cohortlake.operators import relational as J
from cohortlake.plans import layouts as L
from cohortlake.plans import reports as R
from cohortlake.plans import contract
from cohortlake.plans.contract import CONTRACT
from cohortlake.plans.pipeline import MARTS, RAW, NotReadyError, Pipeline, gate
from cohortlake.plans.registry import REPORTS, run_report
from cohortlake.plans.staged import StagedTables, StagedWarehouse
from cohortlake.plans.warehouse import Warehouse, fact_student_week, fact_submission
from cohortlake.sources import bridge, files
from cohortlake.sources.versions import Versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_relational(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, None)], "k int, v int")
    assert rows(J.mark_exists(df, df.where("k < 3"), ["k"], "there").select("k", "there")) == [(1, True), (2, True), (3, False)]
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string")
    assert rows(J.latest_by_key(log, ["k"], "n")) == [(1, 2, "b"), (2, 1, "c")]
    items = spark.createDataFrame([(1, "m", 0.0, 1), (2, "m", 5.0, 9), (3, "m", 5.0, 9), (4, "n", 0.0, 1)], "id int, g string, weight double, due int")
    assert rows(J.first_qualifying(items, F.col("weight") > 0, ["g"], ["due", "id"], "f", "id").where("f").select("id")) == [(2,)]
    spans = spark.createDataFrame([(1, 2, None, 4), (2, 2, 2, 4), (3, 2, 3, 4), (4, -9, 0, 4), (5, 5, None, 4)], "id int, due int, done int, last int")
    got = J.open_periods(spans, "due", "done", "last", -1).select("id", "week_no")
    assert rows(got) == [(1, 2), (1, 3), (1, 4), (3, 2), (4, -1)]
    holes = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 3, 7)], "k int, w int, v int")
    assert rows(holes.select("w", J.previous_value("v", ["k"], "w"))) == [(0, 0), (1, 5), (3, 0)]
    assert J.replicate(df, 3, "k", 100).select(F.sum("k")).first()[0] == 3 * 6 + 3 * 300


def small(spark):
    item = spark.createDataFrame([(1, "M", "2014J", "TMA", 10, 20.0), (2, "M", "2014J", "CMA", 10, 0.0), (3, "M", "2014J", "TMA", 3, 10.0)], "id_assessment int, code_module string, code_presentation string, assessment_type string, deadline int, weight double")
    length = spark.createDataFrame([("M", "2014J", 21, 3)], "code_module string, code_presentation string, length_days int, n_weeks int")
    handed = spark.createDataFrame([(1, 7, 12, 0, 39.0), (2, 7, 30, 0, 40.0), (1, 8, 12, 1, None), (3, 7, 15, 0, 80.0)], "id_assessment int, id_student long, date_submitted int, is_banked int, score double")
    return item, length, handed


def test_submission_flags(spark):
    item, length, handed = small(spark)
    got = {(r.id_assessment, r.id_student): r for r in fact_submission(handed, item, length).collect()}
    late, cma, banked = got[1, 7], got[2, 7], got[1, 8]
    assert (late.is_late, late.days_late, late.is_pass_score, late.is_beyond_course) == (True, 2, False, False)
    assert (cma.is_late, cma.is_pass_score, cma.is_beyond_course, cma.week_no) == (False, True, True, 4)
    assert (banked.is_late, banked.days_late, banked.score_missing, banked.is_pass_score) == (False, None, True, None)


def test_snapshot(spark):
    item, length, handed = small(spark)
    enrolled = spark.createDataFrame([(7, "M", "2014J", None), (9, "M", "2014J", 8)], "id_student long, code_module string, code_presentation string, date_unregistration int")
    daily = spark.createDataFrame([(7, "M", "2014J", 1, -3, -1, 4), (7, "M", "2014J", 1, 15, 2, 6), (7, "M", "2014J", 2, 15, 2, 1)], "id_student long, code_module string, code_presentation string, id_site int, date int, week_no int, sum_click int")
    week = fact_student_week(enrolled, length, daily, fact_submission(handed.where("id_assessment <> 2"), item, length), item, -1)
    got = {(r.id_student, r.week_no): r for r in week.collect()}
    assert sorted(got) == [(s, w) for s in (7, 9) for w in (-1, 0, 1, 2)] and "final_result" not in week.columns
    assert [(got[7, w].clicks_week, got[7, w].clicks_cum, got[7, w].active_days_week, got[7, w].sites_week) for w in (-1, 0, 1, 2)] == [(4, 4, 1, 1), (0, 4, 0, 0), (0, 4, 0, 0), (7, 11, 1, 2)]
    assert [got[7, w].avg_score_cum for w in (0, 1, 2)] == [None, 39.0, 59.5]
    assert [got[7, w].n_tma_missed_cum for w in (-1, 0, 1, 2)] == [0, 1, 1, 0] and [got[9, w].n_tma_missed_cum for w in (0, 1, 2)] == [1, 2, 2]
    assert [got[9, w].is_enrolled for w in (-1, 0, 1, 2)] == [True, True, False, False]


@pytest.fixture(scope="module")
def raw(spark, sf_dir, tmp_path_factory):
    return StagedTables(spark, bridge.raw_tables(spark, sf_dir), str(tmp_path_factory.mktemp("raw") / "t"))


@pytest.fixture(scope="module")
def staged_w(spark, raw, tmp_path_factory):
    return StagedWarehouse(spark, raw, str(tmp_path_factory.mktemp("staged")), -1)


@pytest.fixture(scope="module")
def done(spark, raw, tmp_path_factory):
    """A pipeline that has run, and its rows."""
    out = Pipeline(spark, raw, str(tmp_path_factory.mktemp("out")))
    return out, out.run()


def test_gate_catches_planted_faults(spark, raw, tmp_path):
    w = StagedWarehouse(spark, raw, f"{tmp_path}/w", -1)
    week, metrics = w.fact_student_week, {name: contract.measured(name, df) for name, df in w.tables().items()}
    run = lambda week: gate(w.tables() | {"fact_student_week": week}, -1, metrics | {"fact_student_week": contract.measured("fact_student_week", week)})
    assert rows(run(week).report(spark).where("n_failures > 0")) == []
    one = week.where("week_no = 0").limit(1)
    faults = {
        "fact_student_week: key is unique": week.unionByName(one),
        "snapshot grid is whole": week.join(one.select("id_student", "week_no"), ["id_student", "week_no"], "left_anti").select(week.columns),
        "running totals never fall": week.withColumn("clicks_cum", F.when(F.col("week_no") == 2, -1).otherwise(F.col("clicks_cum"))),
        "clicks are conserved": week.withColumn("clicks_week", F.col("clicks_week") + 1),
        "fact_student_week -> fact_enrollment": week.unionByName(one.withColumn("id_student", F.lit(-5).cast("long"))),
        "fact_student_week: weeks of the course": week.withColumn("week_no", F.when(F.col("week_no") == 2, 77).otherwise(F.col("week_no"))),
    }
    for name, broken in faults.items():
        found = {r.check_name for r in run(broken).report(spark).where("n_failures > 0").collect()}
        assert name in found
    with pytest.raises(Q.GateError):
        run(week.unionByName(one)).enforce(spark)
    with pytest.raises(Q.GateError):
        gate(w.tables() | {"fact_student_week": week.withColumn("final_result", F.lit("Pass"))}, -1)


def test_pipeline_publishes_and_repeats(spark, raw, done):
    out, first = done
    assert out.run() == first and first["fact_student_week"] > 0
    assert out.versions.remove_old() and len(out.versions._names("versions")) == 1
    w = out.published()
    assert Q.fingerprint(w.fact_student_week.select(sorted(w.fact_student_week.columns))).first() == Q.fingerprint(Warehouse(spark, raw).fact_student_week).first()
    pruned = w.fact_student_week.where("week_no = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_no" in pruned
    mart = out.versions.read("mart_weekly_activity")
    assert mart.where("mart_created_at is null").count() == 0 < mart.count()
    assert {r.table_name: r.ok for r in files.read_report(spark, f"{out.out}/report").collect()} == dict.fromkeys([*RAW, *Warehouse.TABLES, *MARTS], True)


def test_fingerprint_and_differences(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (2, 0.2)], "k int, x double")
    same = df.orderBy(F.desc("k")).withColumn("x", F.col("x") + 1e-12)
    assert Q.fingerprint(df).first() == Q.fingerprint(same).first() != Q.fingerprint(df.distinct()).first()
    other = spark.createDataFrame([(2, 0.2 + 1e-9), (3, 0.3), (4, 0.5)], "k int, x double")
    mine = spark.createDataFrame([(1, 0.1), (2, 0.2), (4, 0.4)], "k int, x double")
    assert rows(Q.differences(mine, other, ["k"])) == [(1, "only left"), (3, "only right"), (4, "values differ")]


def test_typed_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,n,x\n1, 5 ,?\n2,,1.5\n3,12a,2\n")
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType().add("id", IntegerType()).add("n", IntegerType()).add("x", DoubleType())
    with pytest.raises(files.BadValuesError, match="n: 1"):
        files.read_typed_csv(spark, str(path), schema)
    assert rows(files.read_typed_csv(spark, str(path), schema, check=False)) == [(1, 5, None), (2, None, 1.5), (3, None, 2.0)]
    (tmp_path / "empty.csv").write_text("")
    assert files.missing_inputs(spark, {"t": str(path), "e": f"{tmp_path}/empty.csv", "no": f"{tmp_path}/no.csv"}) == ["e", "no"]
    with pytest.raises(ValueError):
        files.write_table(spark.range(3), f"{tmp_path}/out", expected=4)
    assert files.jdbc_options("jdbc:x", "t", "id")["partitionColumn"] == "id" and files.kafka_options("h:1", "t")["subscribe"] == "t"


def test_reports_refuse_wrong_parameters(spark, sf_dir, staged_w):
    w = staged_w
    assert {"risk_flags", "overview", "q05"} <= set(REPORTS)
    for given in ({}, {"week": 2, "wek": 3}):
        with pytest.raises(ValueError):
            run_report(w, "risk_flags", **given)
    with pytest.raises(ValueError):
        run_report(w, "no_such_report")
    assert run_report(w, "risk_flags", week=2).count() > 0


def test_outcomes_do_not_reach_the_list(spark, sf_dir, staged_w):
    got = R.label_flip(staged_w, 2).first()
    assert got.n_before == got.n_after == got.n_same > 0 and got.precision_before != got.precision_after


def test_documents_round_trip(spark, sf_dir, staged_w):
    w = staged_w
    flat = L.unnest(L.nested_timeline(w))
    assert Q.fingerprint(flat).first() == Q.fingerprint(L.document_rows(L.documents(w))).first()


def test_days_are_written_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, -3), (2, 5), (3, 5)], "k int, date int")
    files.write_by_day(df, f"{tmp_path}/days")
    assert sorted(p.name for p in (tmp_path / "days").glob("date=*")) == ["date=-3", "date=5"]
    assert rows(spark.read.parquet(f"{tmp_path}/days").select("k", "date")) == rows(df)


def test_weeks_come_from_the_tables(spark):
    from cohortlake.plans.warehouse import dim_week

    clicks = spark.createDataFrame([(-9,), (3,)], "date int")
    length = spark.createDataFrame([(3,), (2,)], "n_weeks int")
    assert [tuple(r) for r in dim_week(clicks, length).orderBy("week_no").collect()] == [(w, 7 * w, 7 * w + 6, w < 0) for w in (-2, -1, 0, 1, 2)]
    assert dim_week(clicks.where("date > 99"), length).count() == 3


def test_missed_items_are_the_changes_added_up(spark, sf_dir, staged_w):
    from cohortlake.plans.warehouse import WEEKLY, missed_items

    w = staged_w
    listed = missed_items(w.fact_enrollment, w.dim_presentation, w.dim_assessment, w.fact_submission, -1).select(*WEEKLY, "n_tma_missed_cum")
    added = w.fact_student_week.where("n_tma_missed_cum <> 0").select(*WEEKLY, "n_tma_missed_cum")
    assert rows(listed) == rows(added) and added.count() > 0


def test_report_keeps_the_last_run_of_each_table(spark, tmp_path):
    path = f"{tmp_path}/report"
    files.append_report(spark, path, [("a", 1, 2, 0.5), ("b", 3, None, 0.1)])
    files.append_report(spark, path, [("a", 2, 2, 0.4)])
    assert {r.table_name: (r.n_rows, r.n_expected, r.ok) for r in files.read_report(spark, path).collect()} == {"a": (2, 2, True), "b": (3, None, True)}


def test_effect_of_stored_layouts(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 8).cast("int").alias("week_no"), F.col("id").cast("string").alias("text"))
    rows.repartition(8, "id").write.parquet(f"{tmp_path}/plain")
    files.write_partitioned(rows, f"{tmp_path}/weeks", "week_no", ["id"])
    got = {r.layout: r for r in files.stored_effect({n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("plain", "weeks")}, "week_no = 3").collect()}
    assert got["plain"].n_rows == got["weeks"].n_rows == 500
    assert got["plain"].files_hit == got["plain"].n_files > 1 and got["plain"].bytes_hit == got["plain"].n_bytes
    assert got["weeks"].bytes_hit < got["weeks"].n_bytes / 4 and got["weeks"].files_hit < got["weeks"].n_files


def test_pipeline_refuses_planted_faults_and_keeps_the_former_version(spark, raw, done):
    """A null, a value out of range, lost submissions, a key twice and a count that isn't as expected, all told at once."""
    good, rows_ = done
    before = good.versions.current()
    faults = {
        **raw,
        "student_vle": raw["student_vle"].withColumn("sum_click", F.when(F.col("id_student") % 5 != 0, F.col("sum_click"))),
        "student_assessment": raw["student_assessment"].withColumn("score", F.col("score") + 1000),
        "assessments": raw["assessments"].where("id_assessment % 100 <> 1"),
        "student_info": raw["student_info"].withColumn("gender", F.col("code_presentation")),
    }
    with pytest.raises(Q.GateError) as e:
        Pipeline(spark, faults, good.out, expected={("fact_submission", "flag is_late"): 1_000_007}).run()
    found = str(e.value)
    for name in ("fact_vle_daily: null: sum_click", "fact_submission: never: score < 0 or score > 100", "every submission is kept", "dim_student: key is unique", "fact_submission: flag is_late is 1000007"):
        assert name in found, found
    assert good.versions.current() == before and good.published().fact_student_week.count() == rows_["fact_student_week"]
    assert {r.table_name: r.ok for r in files.read_report(spark, f"{good.out}/report").collect()}["fact_submission"] is False


def test_a_failure_between_two_tables_leaves_the_former_version(spark, raw, done, monkeypatch):
    out, rows_ = done
    before, write, there = out.versions.current(), contract.write_measured, len(out.versions._names("versions"))

    def breaks(name, *args):
        if name == "dim_assessment":
            raise OSError("disk full")
        return write(name, *args)

    monkeypatch.setattr(contract, "write_measured", breaks)
    with pytest.raises(OSError):
        out.run()
    assert out.versions.current() == before and len(out.versions._names("versions")) == there + 1
    assert out.published().fact_enrollment.count() == rows_["fact_enrollment"]
    gone = out.versions.remove_old()
    assert gone and not any(g in before for g in gone) and out.published().dim_week.count() > 0


def test_versions(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/v")
    with pytest.raises(FileNotFoundError):
        v.current()
    folders = [v.new() for _ in range(3)]
    with pytest.raises(FileNotFoundError):
        v.publish(folders[0])
    for i, f in enumerate(folders):
        spark.range(i + 1).write.parquet(f"{f}/t")
        v.publish(f)
        assert v.read("t").count() == i + 1
    assert v.back() == folders[1] and v.read("t").count() == 2
    assert sorted(f"{tmp_path}/v/versions/{n}" for n in v.remove_old()) == sorted([folders[0], folders[2]]) and v.read("t").count() == 2


def test_inputs_are_checked_first(spark, raw, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(NotReadyError, match="vle: absent or empty"):
        Pipeline(spark, raw, f"{tmp_path}/out", inputs={"vle": f"{tmp_path}/empty.csv"}).run()
    with pytest.raises(NotReadyError, match="courses: not given; student_vle: no date"):
        Pipeline(spark, {**{n: raw[n] for n in RAW if n != "courses"}, "student_vle": raw["student_vle"].drop("date")}, f"{tmp_path}/out").run()
    assert not (tmp_path / "out").exists()


def test_weeks_before_the_first_are_kept(spark, raw, tmp_path):
    """Clicks in week -4 move the start of the grid."""
    early = raw["student_vle"].where("id_student % 2 = 0").withColumn("date", F.lit(-22))
    out = Pipeline(spark, {**raw, "student_vle": raw["student_vle"].unionByName(early)}, str(tmp_path))
    out.run()
    w = out.published()
    assert w.first_week == -4 and w.fact_student_week.agg(F.min("week_no")).first()[0] == -4
    assert w.fact_student_week.agg(F.sum("clicks_week")).first()[0] == w.fact_vle_daily.agg(F.sum("sum_click")).first()[0]


def test_each_table_is_read_once_by_the_gate(done):
    w = done[0].published()
    plan = contract.relations(w.tables(), w.first_week)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= len(Warehouse.TABLES) + 4  # the weeks and the size of the grid read dimensions again


def test_metrics_are_the_same_observed_and_measured(spark, raw, tmp_path):
    w = Warehouse(spark, raw, -1)
    for name, by in (("dim_assessment", None), ("fact_student_week", ("week_no", ["id_student"]))):
        df = getattr(w, name)
        got = contract.write_measured(name, df, f"{tmp_path}/{name}", by)
        assert got == contract.measured(name, df) and got["rows"] > 0
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == got["rows"]
    empty = w.fact_student_week.where("week_no > 99")
    assert set(contract.write_measured("fact_student_week", empty, f"{tmp_path}/none").values()) == {0}
    assert set(CONTRACT) >= set(Warehouse.TABLES)


def test_bag_difference_counts_copies(spark):
    a = spark.createDataFrame([(1, 0.1, "x"), (1, 0.1, "x"), (2, None, "y"), (3, 1.0, None)], "k int, x double, t string")
    same = a.select("t", "k", (F.col("x") + 1e-12).alias("x"))
    assert Q.bag_difference(a, same).count() == 0
    other = spark.createDataFrame([(1, 0.1, "x"), (2, None, "y"), (2, None, "y"), (3, 1.0, "null"), (4, 2.0, "z")], "k int, x double, t string")
    got = sorted(map(tuple, Q.bag_difference(a, other).collect()))
    assert got == sorted([('{"k":1,"t":"x","x":0.1}', 2, 1), ('{"k":2,"t":"y","x":null}', 1, 2), ('{"k":3,"t":null,"x":1.0}', 1, 0), ('{"k":3,"t":"null","x":1.0}', 0, 1), ('{"k":4,"t":"z","x":2.0}', 0, 1)])
    with pytest.raises(ValueError):
        Q.bag_difference(a, a.drop("t"))


def test_scans_tell_what_was_read(spark, tmp_path):
    from cohortlake.sources.scans import run_scanned

    rows = spark.range(8000).select("id", (F.col("id") % 8).cast("int").alias("week_no"))
    files.write_partitioned(rows, f"{tmp_path}/weeks", "week_no", ["id"])
    stored = spark.read.parquet(f"{tmp_path}/weeks")
    got, one = run_scanned(stored.where("week_no = 3").agg(F.count("*").alias("n")))
    whole = run_scanned(stored.agg(F.sum("id")))[1]
    assert got[0].n == one.rows == 1000 and one.partitions == 1 and whole.partitions == 8
    assert 0 < one.files < whole.files and 0 < one.bytes < whole.bytes and one.scans == 1
    a, b = (files.write_bucketed(rows, f"bucketed_{x}_{tmp_path.name}", f"{tmp_path}/{x}", ["id"], 4) for x in "ab")
    joined = run_scanned(a.join(b.select("id", F.lit(1).alias("x")).hint("merge"), "id").groupBy().agg(F.count("*").alias("n")))
    assert joined[0][0].n == 8000 and joined[1].exchanges == 1  # of the count alone


def test_staged_tables_are_written_once(spark, sf_dir, tmp_path):
    import copy

    from cohortlake.plans import staged

    raw = bridge.raw_tables(spark, sf_dir)
    w = staged.StagedWarehouse(spark, raw, str(tmp_path / "w"), -1)
    other = copy.copy(w)
    assert rows(other.fact_submission) == rows(w.fact_submission) == rows(Warehouse(spark, raw, -1).fact_submission)
    assert {p.name for p in (tmp_path / "w").iterdir()} == {"raw", "dim_assessment", "dim_presentation", "fact_submission"}
    assert {p.name for p in (tmp_path / "w" / "raw").iterdir()} == {"assessments", "courses", "student_assessment"}
    plan = w.fact_student_week._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    first = staged.staged(spark, sf_dir, bridge.raw_tables, -1)
    assert first is staged.staged(spark, sf_dir, bridge.raw_tables, -1) is not staged.staged(spark, sf_dir, bridge.raw_tables, -2)


def test_published_tables_are_loaded_into_a_row_store(spark, done, tmp_path):
    from cohortlake.sources.rowstore import RowStore

    out, rows_ = done
    store = RowStore(spark, f"jdbc:derby:memory:{tmp_path.name};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    assert out.load(store) == rows_
    same = Q.reconcile_counts({n: df.select(df.columns[0]) for n, df in out.published().tables().items()}, {n: store.read(n) for n in rows_})
    assert same.where("not is_equal").count() == 0 < same.count()
