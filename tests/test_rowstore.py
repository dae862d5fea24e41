"""Loads into a row store that runs within the session's JVM."""

import pytest
from pyspark.sql import functions as F

from cohortlake.plans.contract import CONTRACT
from cohortlake.plans.warehouse import Warehouse
from cohortlake.sources import bridge
from cohortlake.sources.rowstore import LoadError, RowStore, load_all


@pytest.fixture()
def store(spark, tmp_path):
    return RowStore(spark, f"jdbc:derby:memory:{tmp_path.name};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, text=40, writers=3, batch=100)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_tables_are_loaded_twice_and_read_back(spark, sf_dir, store):
    w = Warehouse(spark, bridge.raw_tables(spark, sf_dir), -1)
    tables = {name: getattr(w, name).persist() for name in ("dim_assessment", "dim_student", "fact_submission", "fact_enrollment")}
    for counts in (None, {name: df.count() for name, df in tables.items()}):
        assert load_all(store, tables, {n: CONTRACT[n].keys for n in tables}, counts) == {n: df.count() for n, df in tables.items()}
    for name, df in tables.items():
        back = store.read(name, "id_assessment" if "id_assessment" in df.columns else "id_student", 4)
        assert back.rdd.getNumPartitions() == 4
        assert rows(back, df.columns) == rows(df, df.columns) and not store.has(f"{name}__new")


def test_a_load_that_differs_leaves_the_former_table(spark, store):
    good = spark.range(50).select(F.col("id").cast("int"), F.lit("x").alias("t"))
    store.load(good, "items", ["id"])
    with pytest.raises(LoadError, match="50 rows in the store, expected 51"):
        store.load(good, "items", ["id"], expected=51)
    with pytest.raises(LoadError, match="items"):
        store.load(good.unionByName(good.where("id = 3")), "items", ["id"])  # the key is refused
    with pytest.raises(LoadError, match="items"):
        store.load(good.withColumn("id", F.when(F.col("id") > 0, F.col("id"))), "items", ["id"])
    with pytest.raises(Exception):
        store.load(good.withColumn("t", F.lit("y" * 41)), "items", ["id"])  # a text that doesn't fit isn't cut
    assert store.count("items") == 50 and rows(store.read("items"), ["id", "t"]) == rows(good, ["id", "t"])
    store.load(good.where("id < 7"), "items", ["id"])
    assert store.count("items") == 7
    store.load(good.where("id < 0"), "items", ["id"])
    assert store.count("items") == 0 == store.read("items", "id").count()
    with pytest.raises(ValueError):
        RowStore(spark, "jdbc:other:x")
