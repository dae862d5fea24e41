"""What the text operators share: the shared folder, written intermediate tables, and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, tests on one machine get a temporary folder for the session; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cohortlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with a number if one of ``columns`` (in any case) has it already."""
    taken, out, i = {c.lower() for c in columns}, name, 0
    while out.lower() in taken:
        i += 1
        out = f"{name}_{i}"
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives a lost executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    if owner := getattr(context, "_cohortlake_owner", None):
        _written(context).setdefault(owner, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _written(context: SparkContext) -> dict[str, list[str]]:
    if not hasattr(context, "_cohortlake_written"):
        context._cohortlake_written = {}
    return context._cohortlake_written


@contextlib.contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables that ``materialise`` writes within belong to ``owner``, which can release them; others are never removed."""
    context = spark.sparkContext
    before = getattr(context, "_cohortlake_owner", None)
    context._cohortlake_owner = owner
    try:
        yield
    finally:
        context._cohortlake_owner = before


def release(spark: SparkSession, owner: str, *keep: DataFrame) -> None:
    """Remove the tables of ``owner``, but for those that ``keep`` reads.

    To be called when all results that rest on them have been written: a stage of a pipeline does it for the one before.
    """
    read = [f.split("://")[-1].removeprefix("file:") for df in keep for f in df.inputFiles()]
    paths, jvm = _written(spark.sparkContext).setdefault(owner, []), spark.sparkContext._jvm
    for path in list(paths):
        plain = path.split("://")[-1].removeprefix("file:")
        if not any(plain in f for f in read):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            paths.remove(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is written by now.

    Its cleaner deletes them when nothing on the driver refers to the shuffle any more, which it learns from garbage
    collections alone; a job of many written steps would keep those of all steps until its end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application: they don't share the driver's code.

    Also bounds the rows and bytes that go to a Python worker at once, as texts are long, and a row may hold many of them.
    """
    context = spark.sparkContext
    if int(spark.conf.get(_ROWS)) > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    if getattr(context, "_cohortlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="cohortlake-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._cohortlake_shipped = True


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system at its end.

    Python workers outlive their tasks, and several of them share an executor's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not in every C library
            ctypes.CDLL(None).malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def batches(rows: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One Arrow batch from columns as lists or arrays, none if there are no rows."""
    arrays = [pa.array(rows[f.name], type=f.type) for f in schema]
    if len(arrays[0]):
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def hash_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most about ``limit`` rows, chosen by a hash of ``key``: the same rows on every run.

    The fraction comes from a count, so that no sort of the whole table is needed.
    """
    n = df.count()
    if n <= limit:
        return df
    buckets = 1_000_000
    keep = max(1, int(buckets * limit / n))
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)) < keep)


def slices(lengths: Iterable[int], target: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to about ``target``; a longer row stands alone."""
    lo = total = 0
    hi = 0
    for hi, n in enumerate(lengths):
        if total and total + n > target:
            yield lo, hi
            lo, total = hi, 0
        total += n
    if total or lo <= hi:
        yield lo, hi + 1
