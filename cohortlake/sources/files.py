"""Typed reading, idempotent writing, and connector options."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..operators.quality import bad_cast_audit


class BadValuesError(ValueError):
    """A column holds values that its type cannot."""


def cleaned(text: Column) -> Column:
    """Trimmed; blank and ``?`` are null."""
    t = F.trim(text)
    return F.when((t != "") & (t != "?"), t)


def text_schema(schema: StructType) -> StructType:
    out = StructType()
    for f in schema:
        out = out.add(f.name, StringType())
    return out


def read_typed_csv(spark: SparkSession, path: str, schema: StructType, check: bool = True) -> DataFrame:
    """CSV read as text, cleaned, then cast; malformed rows fail, values that do not cast are refused by column."""
    raw = spark.read.schema(text_schema(schema)).option("header", True).option("mode", "FAILFAST").csv(path)
    text = raw.select(*(cleaned(F.col(f.name)).alias(f.name) for f in schema))
    if check:
        bad = bad_cast_audit(text, {f.name: f.dataType.simpleString() for f in schema}).where("n_bad > 0").collect()  # a row for each column
        if bad:
            raise BadValuesError(", ".join(f"{r.column_name}: {r.n_bad}" for r in bad))
    return text.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def missing_inputs(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Names of inputs that are absent or empty, by the store's own listing."""
    out = []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, path in paths.items():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p) or fs.getContentSummary(p).getLength() == 0:
            out.append(name)
    return out


def write_table(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Overwrites the table, counts its rows as they are written, and fails if they are not as many as expected.

    Tasks that ran again after a loss are observed twice, so a count that differs is taken again from the table.
    """
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    n = seen.get.get("n") or 0
    if expected is not None and n != expected:
        n = df.sparkSession.read.parquet(path).count()
    if expected is not None and n != expected:
        raise ValueError(f"{path}: {n} rows, expected {expected}")
    return n


def write_partitioned(df: DataFrame, path: str, by: str, cluster: list[str]) -> None:
    """Partitions by ``by``; within each, rows are ranged and sorted by ``cluster``, so that row groups can be skipped."""
    df.repartitionByRange(by, *cluster).sortWithinPartitions(by, *cluster).write.mode("overwrite").partitionBy(by).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A table of the session's catalog at ``path``, in ``buckets`` files by a hash of ``keys`` and sorted by them: tables with
    the same keys and number of buckets join without a shuffle. Rows are dealt first, so that a bucket is one file."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def scratch(spark: SparkSession, name: str) -> str:
    """An unused path in the folder of ``spark.checkpoint.dir``; a temporary one where a local session has none set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cohortlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder: for what a plan would otherwise compute several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_report(spark: SparkSession, path: str, rows: list[tuple[str, int, int | None, float]]) -> None:
    """Appends (table, rows, expected, seconds) of a run."""
    got = spark.createDataFrame(rows, "table_name string, n_rows long, n_expected long, seconds double")
    got.withColumn("ok", F.col("n_expected").isNull() | (F.col("n_rows") == F.col("n_expected"))).withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each table over all runs."""
    entries = spark.read.schema("table_name string, n_rows long, n_expected long, seconds double, ok boolean, at timestamp").json(path)
    newest = entries.groupBy("table_name").agg(F.max_by(F.struct("n_rows", "n_expected", "seconds", "ok", "at"), "at").alias("x"))
    return newest.select("table_name", "x.*")


def stored_effect(layouts: dict[str, DataFrame], rows: str) -> DataFrame:
    """For each stored table: its files and bytes, and those of the files that hold rows of the filter ``rows``.

    Looks at every row; what a query really read comes from ``scans.run_scanned``.
    """
    parts = []
    for name, df in layouts.items():
        hit = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.expr(rows).alias("hit"))
        files = hit.groupBy("file").agg(F.max("size").alias("size"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"), F.count_if("hit").alias("n"))
        sums = files.agg(
            F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.count_if("hit").alias("files_hit"),
            F.coalesce(F.sum(F.when(F.col("hit"), F.col("size"))), F.lit(0)).alias("bytes_hit"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        )
        parts.append(sums.select(F.lit(name).alias("layout"), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_by_day(df: DataFrame, path: str, day: str = "date") -> None:
    """One directory per day, for replay."""
    df.repartition(day).write.mode("overwrite").partitionBy(day).parquet(path)


def jdbc_options(url: str, name: str, key: str | None = None, partitions: int = 8, batch: int = 10_000) -> dict[str, str]:
    """Options of a JDBC table; with ``key`` a read is split over it."""
    out = {"url": url, "dbtable": name, "batchsize": str(batch), "isolationLevel": "READ_COMMITTED", "truncate": "true"}
    return out | ({"partitionColumn": key, "numPartitions": str(partitions)} if key else {})


def kafka_options(servers: str, topic: str, per_trigger: int = 250_000) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "true"}
