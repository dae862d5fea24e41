"""The stream against batch: in order, late, replayed, stopped and restarted."""

from pyspark.sql import functions as F

from cohortlake.plans.warehouse import Warehouse
from cohortlake.sources import bridge
from cohortlake.streaming import weekly as S


def clicks(spark, sf_dir):
    return bridge.raw_tables(spark, sf_dir)["student_vle"].select("code_module", "code_presentation", "id_student", "id_site", "date", "sum_click")


def put(df, path, name):
    """One file, so that one trigger reads it."""
    df.coalesce(1).write.mode("append").option("compression", "none").parquet(f"{path}/{name}")


def run(spark, path, tmp_path, name, sums=S.watermarked, files=1):
    log, checkpoint = f"{tmp_path}/{name}-log", f"{tmp_path}/{name}-checkpoint"
    query = S.start(sums(S.file_stream(spark, f"{path}/*", files)), log, checkpoint)
    query.awaitTermination()
    return query, log


def totals(df, column):
    return {r.week_no: r.n for r in df.groupBy("week_no").agg(F.sum(column).alias("n")).collect()}


def test_in_order_equals_batch(spark, sf_dir, tmp_path):
    w = Warehouse(spark, bridge.raw_tables(spark, sf_dir))
    data = clicks(spark, sf_dir)
    for i, week in enumerate(range(-1, 4)):
        put(data.where(F.floor(F.col("date") / 7) == week), tmp_path / "in", f"w{i}")
    for name, sums in (("marked", S.watermarked), ("running", S.running)):
        query, log = run(spark, tmp_path / "in", tmp_path, name, sums)
        got = S.compare(w, S.read_log(spark, log)).collect()
        assert sum(r.n_week_differs + r.n_cum_differs + r.n_stream_only for r in got) == 0 and sum(r.clicks_stream for r in got) == sum(r.clicks_batch for r in got) > 0
        seen = S.progress(query)
        assert seen["dropped"] == 0 and (seen["state_end"] < seen["state_max"]) == (name == "marked")


def test_late_rows_are_dropped_and_accounted_for(spark, sf_dir, tmp_path):
    data = clicks(spark, sf_dir)
    in_time, late = S.split_late(data.where("date < 0"), 300)
    late = late.persist()
    put(in_time, tmp_path / "in", "a0")
    for i, week in enumerate(range(0, 4)):
        put(data.where(F.floor(F.col("date") / 7) == week), tmp_path / "in", f"a{i + 1}")
    # the watermark of a batch follows from the batches before it, so the late file comes last, after all weeks
    log, checkpoint = f"{tmp_path}/log", f"{tmp_path}/checkpoint"
    start = lambda: S.start(S.watermarked(S.file_stream(spark, f"{tmp_path}/in/*", 1)), log, checkpoint)
    start().awaitTermination()
    put(late, tmp_path / "in", "z")
    query = start()  # a restart from the checkpoint reads the new file alone
    query.awaitTermination()
    missing = data.agg(F.sum("sum_click")).first()[0] - S.latest(S.read_log(spark, log)).agg(F.sum("clicks_week")).first()[0]
    assert missing == late.agg(F.sum("sum_click")).first()[0] > 0
    assert S.progress(query)["dropped"] > 0


def test_a_batch_that_runs_again_overwrites_itself(spark, sf_dir, tmp_path):
    data = clicks(spark, sf_dir)
    put(data, tmp_path / "in", "a")
    _, log = run(spark, tmp_path / "in", tmp_path, "x", S.running)
    before = totals(S.latest(S.read_log(spark, log)), "clicks_week")
    again = S.read_log(spark, log).where("batch_id = 0").drop("batch_id").cache()
    again.count()
    again.write.mode("overwrite").parquet(f"{log}/batch_id=0")
    assert totals(S.latest(S.read_log(spark, log)), "clicks_week") == before == totals(data.withColumn("week_no", F.floor(F.col("date") / 7)), "sum_click")


def test_messages_decode(spark):
    df = spark.createDataFrame([('{"id_student": 3, "date": -1, "sum_click": 2}',), ("broken",)], "value string")
    assert [(r.id_student, r.date, r.sum_click) for r in S.decoded(df).collect()] == [(3, -1, 2), (None, None, None)]


def test_append_keeps_batches_and_replaces_one_that_runs_again(spark, sf_dir, tmp_path):
    data = clicks(spark, sf_dir)
    for i, week in enumerate(range(0, 3)):
        put(data.where(F.floor(F.col("date") / 7) == week), tmp_path / "in", f"a{i}")
    rows = lambda: S.file_stream(spark, f"{tmp_path}/in/*", 1)
    for checkpoint in ("first", "lost"):  # without its checkpoint the stream runs again from the start
        S.append(rows(), f"{tmp_path}/table", f"{tmp_path}/{checkpoint}").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/table")
        assert got.select("batch_id").distinct().count() == 3
        assert sorted(map(tuple, got.drop("batch_id").collect())) == sorted(map(tuple, data.where("date between 0 and 20").collect()))


def test_compacted_log_has_the_same_view(spark, sf_dir, tmp_path):
    """Before and after compaction, after a replayed batch, and after the old batches are gone."""
    from cohortlake.streaming.log import CompactedLog

    data = clicks(spark, sf_dir)
    for i, week in enumerate(range(-1, 4)):
        put(data.where(F.floor(F.col("date") / 7).isin(week, week - 2)), tmp_path / "in", f"w{i}")
    _, log = run(spark, tmp_path / "in", tmp_path, "c", S.running)
    rows = lambda df: sorted((r.id_student, r.code_module, r.code_presentation, r.week_no, r.clicks_week, r.batch_id) for r in df.collect())
    want = rows(S.latest(S.read_log(spark, log)))
    own = CompactedLog(spark, log, f"{tmp_path}/bases")
    assert rows(own.latest()) == want and own.base()[1] == -1
    old = spark.read.parquet(f"{log}/batch_id=1")
    old = spark.createDataFrame(old.collect(), old.schema)
    for complete in (1, 3, 2):  # a base that is older than the one that holds isn't made
        own.compact(complete)
        assert rows(own.latest()) == want and own.base()[1] == max(complete, own.base()[1])
    assert own.base()[1] == 3 and own.tail(3).select("batch_id").distinct().count() == 1
    old.write.mode("overwrite").parquet(f"{log}/batch_id=1")
    assert rows(own.latest()) == want
    assert own.remove_old() == [f"batch_id={i}" for i in range(4)] and rows(own.latest()) == want
    old.write.mode("overwrite").parquet(f"{log}/batch_id=1")
    assert rows(own.latest()) == want and len(own.bases._names("versions")) == 1


def test_raw_late_rows_are_counted_apart_from_dropped_sums(spark, sf_dir, tmp_path):
    from cohortlake.streaming.watch import observed, watching

    data = clicks(spark, sf_dir)
    in_time, late = S.split_late(data.where("date < 0"), 300)
    put(in_time, tmp_path / "in", "a0")
    for i, week in enumerate(range(0, 4)):
        put(data.where(F.floor(F.col("date") / 7) == week), tmp_path / "in", f"a{i + 1}")
    log, checkpoint = f"{tmp_path}/log", f"{tmp_path}/checkpoint"
    start = lambda: S.start(S.watermarked(observed(S.file_stream(spark, f"{tmp_path}/in/*", 1), -1, 5)), log, checkpoint)
    with watching(spark) as watch:
        first = start()
        first.awaitTermination()
        seen = watch.of(first)
        want = in_time.unionByName(data.where("date between 0 and 27")).agg(F.count("*"), F.sum("sum_click"), F.min("date"), F.max("date")).first()
        assert (seen.rows, seen.clicks, seen.late_rows, seen.dropped_sums) == (want[0], want[1], 0, 0) and seen.batches >= 5
        assert (seen.last_time - seen.first_time).days == want[3] - want[2] and seen.state_max > seen.state_end > 0
        put(late, tmp_path / "in", "z")
        second = start()
        second.awaitTermination()
        seen = watch.of(second)
    assert seen.rows == seen.late_rows == late.count() > seen.dropped_sums > 0


def test_state_on_disk_restarts_from_its_checkpoint(spark, sf_dir, tmp_path):
    from cohortlake.streaming.watch import state_on_disk

    data = clicks(spark, sf_dir)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with state_on_disk(spark):
        for i, week in enumerate(range(-1, 4)):
            put(data.where(F.floor(F.col("date") / 7).isin(week, week - 3)), tmp_path / "in", f"w{i}")
            if i in (1, 4):  # stops after two files, starts again from the checkpoint
                query, log = run(spark, tmp_path / "in", tmp_path, "r", S.running)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert "rocksdbCommitCheckpointLatency" in str(query.lastProgress["stateOperators"][0]["customMetrics"])
    assert any((tmp_path / "r-checkpoint").rglob("*.changelog"))
    weekly = data.withColumn("week_no", F.floor(F.col("date") / 7)).where("week_no between -1 and 3")
    twice = weekly.where("week_no between -1 and 0")  # weeks that came with two files
    want = totals(weekly.unionByName(twice), "sum_click")
    assert totals(S.latest(S.read_log(spark, log)), "clicks_week") == want
