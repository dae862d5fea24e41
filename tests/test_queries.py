"""Every registered query of the warehouse against its SQL."""

import pytest
from oracle import connection, problem

from cohortlake.plans import queries
from cohortlake.plans.oracle import ORACLES
from cohortlake.plans.queries import QUERIES
from cohortlake.plans.warehouse import Warehouse


@pytest.fixture(scope="module", autouse=True)
def shared(spark, sf_dir):
    """One warehouse for all queries, its tables kept, so that each query is quick."""
    w, build = queries.warehouse(spark, sf_dir), queries.warehouse
    w.raw = {k: df.persist() for k, df in w.raw.items()}
    for name in Warehouse.TABLES:
        setattr(w, name, getattr(w, name).persist())
    queries.warehouse = lambda *_: w
    yield w
    queries.warehouse = build
    spark.catalog.clearCache()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    assert problem(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_keys():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) - set(ORACLES) == {"approx_quantiles", "frame_fingerprint"}


def test_layouts_agree(spark, sf_dir):
    for q in ("q07", "q09", "q14", "q18"):
        rows = [sorted(map(str, QUERIES[f"bench_{q}_{k}"](spark, sf_dir).collect())) for k in ("star", "norm", "wide")]
        assert rows[0] == rows[1] == rows[2] and rows[0]


def test_stored_layouts_agree_and_are_read(shared, tmp_path):
    """The four workloads over stored wide and normalised tables: the answers of the star, from the stored files alone."""
    from cohortlake.plans import layouts as L

    w = L.store_layouts(shared, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"wide", "norm"}
    assert not {"code_module", "is_late", "week_no"} & set(w.stored["norm"]["fact_submission"].columns)
    assert w.stored["wide"]["wide_presentation"].count() == shared.dim_presentation.count()
    asks = [lambda x: L.bench_q07(x), lambda x: L.bench_q09(x), lambda x: L.bench_q14(x, queries.RISK_WEEK), lambda x: L.bench_q18(x, queries.PRESENTATION, 20)]
    for ask in asks:
        got = [sorted(map(str, ask(L.layout(w, k)).collect())) for k in ("star", "norm", "wide")]
        assert got[0] == got[1] == got[2] and got[0]
    assert "wide_clicks" in L.layout(w, "wide").clicks.inputFiles()[0]


def test_approximate_quantiles_are_near(spark, sf_dir):
    exact = {r.week_no: r.median_clicks for r in QUERIES["median_manual"](spark, sf_dir).collect()}
    assert all(abs(r.q50 - exact[r.week_no]) <= 2 for r in QUERIES["approx_quantiles"](spark, sf_dir).collect())


def test_sketches_are_read_without_the_facts(spark, shared, sf_dir):
    """Ranks of the returned quartiles among the exact values lie within the bound of the sketch."""
    from cohortlake.operators import sketches
    from cohortlake.plans import reports as R

    stored = queries.written(R.click_sketches(shared), "sketches")
    got = R.approximate_quartiles(stored)
    assert "sum_click" not in got._jdf.queryExecution().optimizedPlan().toString()
    values = {}
    for r in shared.fact_vle_daily.select("week_no", "sum_click").collect():
        values.setdefault(r.week_no, []).append(r.sum_click)
    for r in got.collect():
        own = sorted(values[r.week_no])
        for p, q in ((0.25, r.q25), (0.5, r.q50), (0.75, r.q75)):
            below, upto = sum(v < q for v in own) / len(own), sum(v <= q for v in own) / len(own)
            assert below - sketches.rank_error() <= p <= upto + sketches.rank_error() + 1 / len(own)


def test_no_window_over_an_offering(spark, shared, sf_dir):
    for name in ("average_rank", "spearman", "spearman_pairs", "percent_rank_student", "exact_quantiles"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in plan.splitlines() if "Window [" in x):
            assert "range_no" in line, (name, line[:200])


def test_a_wide_table_builds_only_what_it_reads(spark, sf_dir, tmp_path):
    from cohortlake.plans import layouts as L
    from cohortlake.plans.staged import StagedWarehouse
    from cohortlake.sources.bridge import raw_tables

    w = StagedWarehouse(spark, raw_tables(spark, sf_dir), str(tmp_path), -1)
    assert L.wide(w)["wide_submission"].count() == w.fact_submission.count() > 0
    L.bench_q07(L.layout(w, "wide")).collect()
    L.bench_q07(L.layout(w, "norm")).collect()
    assert set(w.written) == {"dim_presentation", "dim_student", "dim_assessment", "fact_submission"}
    assert {"student_vle", "vle", "student_registration"}.isdisjoint(w.raw._read)
