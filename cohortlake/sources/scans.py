"""What a query read, taken from its executed plan: files, bytes, partitions and rows of its scans, and its shuffles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row


@dataclass
class Scanned:
    files: int = 0
    bytes: int = 0
    partitions: int = 0
    rows: int = 0
    scans: int = 0
    exchanges: int = 0


def _nodes(plan: Any) -> Iterator[tuple[str, Any]]:
    """Name and node of a physical plan as it ran: through adaptive stages, a reused exchange counted where it first stands."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
        return
    yield name, plan
    if name == "ReusedExchangeExec":
        return
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _metric(plan: Any, name: str) -> int:
    metrics = plan.metrics()
    return metrics.apply(name).value() if metrics.contains(name) else 0


def run_scanned(df: DataFrame) -> tuple[list[Row], Scanned]:
    """The rows of a small result, and what was read for them."""
    rows, out = df.collect(), Scanned()
    for name, plan in _nodes(df._jdf.queryExecution().executedPlan()):
        if name == "FileSourceScanExec":
            out.scans += 1
            out.files += _metric(plan, "numFiles")
            out.bytes += _metric(plan, "filesSize")
            out.partitions += _metric(plan, "numPartitions")
            out.rows += _metric(plan, "numOutputRows")
        out.exchanges += name == "ShuffleExchangeExec"
    return rows, out
