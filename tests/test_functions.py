"""Column functions and statistics on rows worked out by hand (FIXTURES.md, section 1.2)."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.functions import stats as S


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_weeks(spark):
    days = [-25, -8, -7, -1, 0, 6, 7, 269]
    assert one(spark, [(d,) for d in days], "d int", C.week_of(F.col("d"))) == [(w,) for w in (-4, -2, -1, -1, 0, 0, 1, 38)]
    assert one(spark, [(-1,), (3,)], "w int", C.first_day(F.col("w")), C.last_day(F.col("w"))) == [(-7, -1), (21, 27)]
    assert one(spark, [(269,), (7,), (8,)], "n int", C.weeks_in(F.col("n"))) == [(39,), (1,), (2,)]


def test_windows_start_on_day_zero(spark):
    df = spark.createDataFrame([(d,) for d in range(-7, 25)], "d int").withColumn("w", F.window(C.event_time(F.col("d")), "7 days"))
    assert all(r.a == math.floor(r.d / 7) for r in df.select("d", C.week_of_window(F.col("w")).alias("a")).collect())


def test_flags_rates_and_labels(spark):
    assert one(spark, [(None,), (True,), (False,)], "b boolean", C.flag(F.col("b"))) == [(False,), (True,), (False,)]
    assert one(spark, [(1, 3), (1, 0), (0, 4), (57, 200)], "a int, b int", C.percent(F.col("a"), F.col("b"))) == [(33.3,), (None,), (0.0,), (28.5,)]
    assert one(spark, [("10-20",), (None,), ("90-100%",)], "b string", C.repaired_band(F.col("b"))) == [("10-20%",), ("Unknown",), ("90-100%",)]
    assert one(spark, [(4,), (3,), (2,), (1,)], "s int", C.risk_level(F.col("s"))) == [("high",), ("high",), ("medium",), ("low",)]
    assert one(spark, [(None, 5), (5, 5), (6, 5)], "u int, d int", C.enrolled_at(F.col("u"), F.col("d"))) == [(True,), (False,), (True,)]
    assert one(spark, [("2014J",), ("x",)], "p string", C.year_of(F.col("p")), C.semester_of(F.col("p"))) == [(2014, "J"), (None, "")]


def test_fisher_interval(spark):
    low, high = C.fisher_interval(F.col("r"), F.col("n"))
    got = one(spark, [(0.5, 28), (1.0, 10), (-1.0, 10), (0.5, 3), (None, 9)], "r double, n int", low, high)
    z, half = math.atanh(0.5), 1.959963984540054 / 5
    assert got[0] == pytest.approx((math.tanh(z - half), math.tanh(z + half)))
    assert got[1:] == [(1.0, 1.0), (-1.0, -1.0), (None, None), (None, None)]


def test_quantiles_two_ways(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(1, 11)], "k int, x double")
    assert tuple(df.agg(*S.quartiles("x", ["a", "b", "c"])).first()) == (10.75, 30.5, 60.25)
    for p, want in ((0.25, 10.75), (0.5, 30.5), (0.75, 60.25), (1.0, 100.0)):
        assert S.quantile_by_position(df, [], "x", p, "q").first().q == want


def test_tied_ranks_and_spearman(spark):
    df = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 3.0), ("a", 2, 2.0), ("a", 4, 1.0), ("b", 1, 1.0), ("b", 2, 2.0)], "k string, x int, y double")
    assert sorted(r[0] for r in df.where("k = 'a'").select(S.average_rank("x", ["k"])).collect()) == [1.0, 2.5, 2.5, 4.0]
    got = {r.k: r for r in S.spearman(df, "x", "y", ["k"]).collect()}
    assert got["b"].rho == pytest.approx(1.0) and got["b"].ci_low is None and got["a"].rho == pytest.approx(-4.5 / math.sqrt(4.5 * 5))


def test_percent_rank_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert sorted((r[0] for r in df.select(S.percent_rank_of("x", [])).collect()), key=str) == [0.0, 100.0, 50.0, None]


def test_suppression_counts_people_not_rows(spark):
    rows = [("p", i % n, b, r) for b, n in (("A", 29), ("B", 30)) for i in range(30) for r in [("Pass" if i % 2 else "Fail")]]
    df = spark.createDataFrame(rows, "k string, id int, band string, result string")
    run = lambda least: S.group_gap(df, ["k"], "id", F.col("band"), {"a": "A", "b": "B"}, {"ok": F.col("result") == "Pass"}, least).first()
    hidden, shown = run(30), run(29)
    assert (hidden.n_people_a, hidden.n_rows_a, hidden.ok_rate_a, hidden.label_a, hidden.ok_gap) == (None, None, None, "n < 30", None)
    assert (hidden.n_people_b, hidden.ok_rate_b) == (30, 50.0)
    assert (shown.n_people_a, shown.n_rows_a, shown.ok_gap) == (29, 30, 0.0)


def test_share_of_total(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert sorted((r.k, r.n, r.pct) for r in S.share_of_total(df, ["k"], F.count("*"), "n", "pct").collect()) == [("a", 2, 66.7), ("b", 1, 33.3)]


def test_ranks_and_quantiles_as_by_windows(spark):
    """Two-level ranks and bracketed quantiles against the window and the aggregate: ties, nulls, signs, one row, one value."""
    import random

    from cohortlake.operators import ranking as K

    r = random.Random(7)
    values = [0.0, -0.5, 1e-300, -1e300, 3.0, None, float("inf"), 5.0]
    rows = [(g, i, r.choice(values) if i % 3 else r.gauss(0, 10 ** (i % 7))) for i in range(600) for g in "ab"] + [("one", 0, 2.0), ("same", 0, 1.0), ("same", 1, 1.0), ("none", 0, None)]
    df = spark.createDataFrame([(*x, float(x[1] % 5)) for x in rows], "k string, i int, x double, n_below double")
    rank = {(t.k, t.i): t.q for t in K.with_average_rank(df.drop("n_below"), ["k"], "x", "q").collect()}
    assert rank == {(t.k, t.i): t.q for t in df.select("k", "i", S.average_rank("x", ["k"]).alias("q")).collect()}
    percent = {(t.k, t.i): t.q for t in K.with_percent_rank(df.drop("n_below"), ["k"], "x", "q").collect()}
    want = {(t.k, t.i): t.q for t in df.select("k", "i", S.percent_rank_of("x", ["k"]).alias("q")).collect()}
    assert percent.keys() == want.keys() and all(percent[k] == want[k] or abs(percent[k] - want[k]) < 1e-9 for k in want)
    finite = df.where("x is null or abs(x) < 1e299")
    probs = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {t.k: t for t in K.exact_quantiles(finite, ["k"], "x", probs).collect()}
    exact = {t.k: t for t in finite.groupBy("k").agg(F.count("x").alias("n"), *(S.quantile("x", p).alias(n) for n, p in probs.items())).where("n > 0").collect()}
    assert got.keys() == exact.keys() == {"a", "b", "one", "same"}
    for k, t in exact.items():
        assert got[k].n == t.n and all(math.isclose(got[k][n], t[n], rel_tol=1e-12) for n in probs), k
    assert K.exact_quantiles(finite, [], "x", {"m": 0.5}).first().m == pytest.approx(finite.agg(S.quantile("x", 0.5)).first()[0])
    assert K.exact_quantiles(finite.where("k = 'none'"), ["k"], "x", probs).count() == 0
    order = [t.x for t in spark.createDataFrame([(v,) for _, _, v in rows], "x double").select("x", K.value_range(F.col("x")).alias("g")).orderBy(F.col("g"), F.col("x").asc_nulls_last()).collect()]
    assert order == sorted((v for v in order if v is not None)) + [None] * sum(v is None for v in order)


def test_sketches_merge_within_their_error(spark):
    from cohortlake.operators import sketches as K

    n, groups = 60_000, 20
    df = spark.range(n).select((F.col("id") % groups).alias("g"), (F.col("id") * 7919 % n).cast("double").alias("x"))
    one = K.sketch(df, ["g"], "x")
    got = K.quantiles(K.merged(one.withColumn("all", F.lit(1)), ["all"]), ["all"], {f"p{p}": p / 100 for p in (1, 25, 50, 75, 99)}).first()
    assert got.n == n and all(abs(got[f"p{p}"] / n - p / 100) <= K.rank_error() + 1 / n for p in (1, 25, 50, 75, 99))
    assert K.sketch(df.withColumn("x", F.lit(None).cast("double")), ["g"], "x").count() == 0
