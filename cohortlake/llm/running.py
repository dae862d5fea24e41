"""Places and running totals of rows in order, for groups of any size: no window over a group, no group in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialise


def _changes(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    """For each row but the first: does it differ from the one before in any of the columns? Nulls are equal."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for i in columns:
        a, b = batch.column(i).slice(1), batch.column(i).slice(0, batch.num_rows - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        out |= np.array(differ) | (np.array(a.is_null()) != np.array(b.is_null()))
    return out


def running(df: DataFrame, group: list[str], order: list[str], sums: Sequence[str] = (), name: str = "running") -> DataFrame:
    """``df`` with ``place`` (rows of its group before the row), ``number`` (rows of the table before it) and, for each
    column of ``sums`` (whole numbers, no nulls), ``upto_<column>``: its total over the group up to and with the row.

    The rows are ranged over the tasks by group and order and written with what each task counts by itself; a large group
    lies in several tasks. The driver gets one row for each task: its first and last group, with their rows and sums. What
    earlier tasks hold of a task's first group is added as the table is read again. ``order`` should tell all rows apart,
    down to copies; nulls come first; without ``group`` all rows are one.
    """
    own = [StructField(c, LongType()) for c in ("part", "run", "at", "place_here", *(f"here_{c}" for c in sums))]
    schema = StructType([*df.schema.fields, *own])
    arrow = to_arrow_schema(schema)
    groups, summed = [df.columns.index(c) for c in group], [df.columns.index(c) for c in sums]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, at, place, last = TaskContext.get().partitionId(), -1, 0, 0, None
        totals = np.zeros(len(summed), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = [batch.column(i)[0].as_py() for i in groups]
            changed = np.concatenate([[last is None or first != last], _changes(batch, groups)])
            rows = np.arange(n)
            start = np.maximum.accumulate(np.where(changed, rows, -1))
            here = np.where(start >= 0, rows - start, rows + place)
            made = [np.full(n, part), run + np.cumsum(changed), at + rows, here]
            for j, i in enumerate(summed):
                upto = np.append(0, np.cumsum(np.array(batch.column(i), np.int64)))
                made.append(np.where(start >= 0, upto[1:] - upto[np.maximum(start, 0)], upto[1:] + totals[j]))
                totals[j] = made[-1][-1]
            run, at, place, last = int(made[1][-1]), at + n, int(here[-1]) + 1, [batch.column(i)[n - 1].as_py() for i in groups]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), *(pa.array(m, pa.int64()) for m in made)], schema=arrow)

    ordered = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    stage = materialise(ordered.mapInArrow(count, schema), name)
    head = F.col("run") == 0
    whole = [*(F.max_by(f"here_{c}", "at").alias(f"tail_{c}") for c in sums)]
    key = F.struct(F.lit(0).alias("_"), *group)
    edges = stage.groupBy("part").agg(
        F.count("*").alias("n"), F.max("run").alias("runs"), F.count_if(head).alias("head_n"), (F.max_by("place_here", "at") + 1).alias("tail_n"), F.min_by(key, "at").alias("head_key"), F.max_by(key, "at").alias("tail_key"), *whole
    )
    before, rows, carried, key_before = [], 0, [0] * (1 + len(sums)), None
    for e in sorted(edges.collect(), key=lambda r: r.part):  # one row for each task
        if e.head_key != key_before:
            carried = [0] * (1 + len(sums))
        before.append((e.part, rows, *carried))
        ends = [e.tail_n, *(e[f"tail_{c}"] for c in sums)]
        carried = [a + b for a, b in zip(carried, ends)] if e.runs == 0 else ends
        rows, key_before = rows + e.n, e.tail_key
    spark = df.sparkSession
    more = spark.createDataFrame(before, ", ".join(f"{c} long" for c in ("part", "rows_before", "place_before", *(f"before_{c}" for c in sums))))
    added = lambda here, more: F.col(here) + F.when(head, F.col(more)).otherwise(0)
    return stage.join(F.broadcast(more), "part").select(  # as many rows as there were tasks
        *df.columns, added("place_here", "place_before").alias("place"), (F.col("at") + F.col("rows_before")).alias("number"), *(added(f"here_{c}", f"before_{c}").alias(f"upto_{c}") for c in sums)
    )
