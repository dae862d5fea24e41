"""Raw tables to a published warehouse: check the inputs, write a version while measuring it, check it, and only then point to it.

A version holds the staging tables (``staging/<name>``), the warehouse tables and the marts.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.files import append_report, missing_inputs
from ..sources.rowstore import RowStore, load_all
from ..sources.versions import Versions
from . import contract, layouts, reports
from .contract import CONTRACT, Metrics
from .warehouse import OFFERING, Warehouse

RAW = {
    "courses": [*OFFERING, "module_presentation_length"], "assessments": [*OFFERING, "id_assessment", "assessment_type", "date", "weight"], "vle": ["id_site", *OFFERING, "activity_type", "week_from", "week_to"],
    "student_info": ["id_student", *OFFERING, "final_result", "imd_band"], "student_registration": ["id_student", *OFFERING, "date_registration", "date_unregistration"],
    "student_assessment": ["id_assessment", "id_student", "date_submitted", "is_banked", "score"], "student_vle": ["id_student", *OFFERING, "id_site", "date", "sum_click"],
}
MARTS = {"mart_weekly_activity": reports.weekly_activity, "mart_student_pairs": reports.spearman_pairs}


class NotReadyError(RuntimeError):
    """An input is absent, empty or lacks columns; nothing was written."""


def check_ready(spark: SparkSession, raw: Mapping[str, DataFrame], inputs: Mapping[str, str] | None = None) -> None:
    """The first step: every file of ``inputs`` is there and not empty, every raw table is given with the columns it needs."""
    problems = [f"{n}: absent or empty" for n in missing_inputs(spark, dict(inputs or {}))]
    for name, columns in RAW.items():
        if name not in raw:
            problems.append(f"{name}: not given")
        elif lacking := sorted(set(columns) - set(raw[name].columns)):
            problems.append(f"{name}: no {', '.join(lacking)}")
    if problems:
        raise NotReadyError("; ".join(problems))


def gate(tables: dict[str, DataFrame], first_week: int, metrics: Mapping[str, Metrics] | None = None, expected: Mapping[tuple[str, str], int] | None = None) -> Q.Gate:
    """All checks: promises and totals from ``metrics`` (measured here if they aren't given), keys and links by one scan."""
    metrics = metrics or {name: contract.measured(name, df) for name, df in tables.items()}
    found = contract.faults(metrics, expected)
    found["running totals never fall"] = sum(n for check, n in found.items() if ": rising: " in check)
    spark = tables["fact_student_week"].sparkSession
    return Q.Gate().add_report(contract.as_report(spark, found)).add_report(contract.relations(tables, first_week))


class Pipeline:
    """Runs over raw tables by name; ``out`` gets a version of all tables and marts, and the pointer to it if all checks hold.

    ``inputs``: raw table -> path, checked before anything else. ``expected``: (table, metric) -> known value.
    """

    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], out: str, first_week: int | None = None, inputs: Mapping[str, str] | None = None, expected: Mapping[tuple[str, str], int] | None = None) -> None:
        self.spark, self.raw, self.out, self.first_week, self.inputs, self.expected = spark, raw, out.rstrip("/"), first_week, inputs, expected
        self.versions = Versions(spark, out)

    def run(self) -> dict[str, int]:
        """Rows of each table. Later tables are built from the written ones, so nothing is computed twice, and each table
        is written once, in the form in which it is published."""
        check_ready(self.spark, self.raw, self.inputs)
        folder, report = self.versions.new(), []
        try:
            metrics = self._build(folder, report)
            self.versions.publish(folder)
        finally:  # a run that fails leaves its report too
            append_report(self.spark, f"{self.out}/report", report)
        return {name: metrics[name]["rows"] for name in Warehouse.TABLES}

    def _build(self, folder: str, report: list[tuple[str, int, int | None, float]]) -> dict[str, Metrics]:
        metrics, raw = {}, {}
        for name in RAW:
            began, path = time.time(), f"{folder}/staging/{name}"
            metrics[name] = contract.write_raw(name, self.raw[name], path)
            raw[name] = self.spark.read.parquet(path)
            report.append((name, metrics[name]["rows"], None, time.time() - began))
        kept = {own: metrics[raw]["rows"] for _, ((raw, a), (own, b), *_) in contract.CONSERVED if a == b == "rows"}
        w = Warehouse(self.spark, raw, self.first_week)
        for name in Warehouse.TABLES:
            began, path = time.time(), f"{folder}/{name}"
            by = ("week_no", [*OFFERING, "id_student"]) if name == "fact_student_week" else None
            metrics[name] = contract.write_measured(name, getattr(w, name), path, by)
            setattr(w, name, self._read(folder, name))
            report.append((name, metrics[name]["rows"], kept.get(name), time.time() - began))
        if bad := {check.split(":")[0] for check, n in contract.faults(metrics, self.expected).items() if n}:
            # tasks that ran again after a loss are observed twice: a fault is confirmed on what was written
            metrics |= {name: contract.measured(name, getattr(w, name)) for name in Warehouse.TABLES if name in bad or not bad <= set(Warehouse.TABLES)}
            metrics |= {name: contract.measured_raw(name, df) for name, df in raw.items()}
        gate(w.tables(), w.first_week, metrics, self.expected).enforce(self.spark)
        for name, build in MARTS.items():
            began = time.time()
            own = contract.write_measured(name, layouts.stamped(build(w)), f"{folder}/{name}")
            report.append((name, own["rows"], None, time.time() - began))
            self._accept(name, own, self._read(folder, name))
        return metrics

    def _accept(self, name: str, own: Metrics, mart: DataFrame) -> None:
        """A mart has rows, keeps its promises, and its key is unique."""
        wrong = {check: n for check, n in contract.faults({name: own}).items() if n} | ({} if own["rows"] else {f"{name}: has rows": 1})
        if twice := Q.key_report(mart, CONTRACT[name].keys, name).where("not is_unique").collect():  # one row
            wrong[f"{name}: key is unique"] = twice[0].n_rows - twice[0].n_keys
        if wrong:
            raise Q.GateError("; ".join(f"{k}: {n}" for k, n in wrong.items()))

    def _read(self, folder: str, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{folder}/{name}")
        return df.withColumn("week_no", F.col("week_no").cast("int")) if name == "fact_student_week" else df

    def load(self, store: RowStore) -> dict[str, int]:
        """The published tables into a row store, each put in place of the former one only if its rows are as many as
        those of the files (which keep their counts, so that no column is read for it)."""
        w = self.published()
        counts = {name: df.count() for name, df in w.tables().items()}
        return load_all(store, w.tables(), {name: CONTRACT[name].keys for name in counts}, counts)

    def published(self) -> Warehouse:
        """The published tables as a warehouse; it stays with the version that holds now."""
        folder = self.versions.current()
        w = Warehouse(self.spark, {}, self.first_week)
        for name in Warehouse.TABLES:
            setattr(w, name, self._read(folder, name))
        return w
