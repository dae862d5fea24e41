"""Weekly clicks from an event stream, its update log, and its reconciliation with batch.

An event-time window of seven days under a watermark bounds the state; update mode, because the last weeks would never
close in append mode. Each micro-batch writes a directory of its own, so a batch that runs again overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.columns import event_time, week_of, week_of_window
from ..operators.relational import latest_by_key
from ..sources.files import kafka_options

CLICK_SCHEMA = "code_module string, code_presentation string, id_student long, id_site int, date int, sum_click int"
KEYS = ["id_student", "code_module", "code_presentation"]
LOG_SCHEMA = "id_student long, code_module string, code_presentation string, week_no int, clicks_week long, processed_at timestamp, batch_id long"


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 7) -> DataFrame:
    return spark.readStream.schema(CLICK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 250_000) -> DataFrame:
    """Clicks from a topic; the session needs Spark's Kafka connector."""
    return decoded(spark.readStream.format("kafka").options(**kafka_options(servers, topic, per_trigger)).load())


def decoded(messages: DataFrame) -> DataFrame:
    """Columns from JSON messages in ``value``."""
    return messages.select(F.from_json(F.col("value").cast("string"), CLICK_SCHEMA).alias("m")).select("m.*")


def running(clicks: DataFrame) -> DataFrame:
    """Weekly sums without a watermark: the state keeps every key."""
    return clicks.withColumn("week_no", week_of(F.col("date"))).groupBy(*KEYS, "week_no").agg(F.sum("sum_click").alias("clicks_week"))


def windowed(timed: DataFrame) -> DataFrame:
    """Weekly sums by event-time window of ``event_time``; batch and stream alike."""
    got = timed.groupBy(*KEYS, F.window("event_time", "7 days").alias("w")).agg(F.sum("sum_click").alias("clicks_week"))
    return got.select(*KEYS, week_of_window(F.col("w")).alias("week_no"), "clicks_week")


def watermarked(clicks: DataFrame, delay: str = "7 days") -> DataFrame:
    return windowed(clicks.withColumn("event_time", event_time(F.col("date"))).withWatermark("event_time", delay))


def start(sums: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there, in update mode; batch n writes ``log/batch_id=n``."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("processed_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{log}/batch_id={number}")

    return sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def append(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends new rows to a table with a column ``batch_id``; a batch that runs again replaces its own rows."""

    def save(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("batch_id", F.lit(number).cast("long"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table)

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All batches; the schema keeps a log without batches readable."""
    return spark.read.schema(LOG_SCHEMA).parquet(log)


def latest(log: DataFrame) -> DataFrame:
    return latest_by_key(log, [*KEYS, "week_no"], "batch_id")


def progress(query: StreamingQuery) -> dict[str, int]:
    """Rows dropped by the watermark (after partial sums) and state sizes of a finished query."""
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    return {
        "batches": len(query.recentProgress), "dropped": sum(s["numRowsDroppedByWatermark"] for s in states),
        "state_max": max((s["numRowsTotal"] for s in states), default=0), "state_end": states[-1]["numRowsTotal"] if states else 0,
    }


def split_late(clicks: DataFrame, thousandths: int) -> tuple[DataFrame, DataFrame]:
    """The rows in time, and the same share of each run held back as late, by a hash of the row."""
    late = F.pmod(F.xxhash64(*clicks.columns), F.lit(1000)) < thousandths
    return clicks.where(~late), clicks.where(late)


def compare(w, log: DataFrame) -> DataFrame:
    """Per week: keys and clicks on both sides, weeks and running totals that differ, keys that batch lacks."""
    batch = w.fact_vle_daily.groupBy(*KEYS, "week_no").agg(F.sum("sum_click").alias("clicks_batch"))
    got = batch.join(latest(log).select(*KEYS, "week_no", F.col("clicks_week").alias("clicks_stream")), [*KEYS, "week_no"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    so_far = Window.partitionBy(*KEYS).orderBy("week_no")
    got = got.select(*KEYS, "week_no", "clicks_batch", "clicks_stream", F.sum(zero("clicks_batch")).over(so_far).alias("cum_batch"), F.sum(zero("clicks_stream")).over(so_far).alias("cum_stream"))
    return got.groupBy("week_no").agg(
        F.count("clicks_batch").alias("n_batch"), F.count("clicks_stream").alias("n_stream"), F.count_if(zero("clicks_batch") != zero("clicks_stream")).alias("n_week_differs"), F.count_if(F.col("cum_batch") != F.col("cum_stream")).alias("n_cum_differs"),
        F.count_if(F.col("clicks_batch").isNull()).alias("n_stream_only"), F.sum(zero("clicks_batch")).alias("clicks_batch"), F.sum(zero("clicks_stream")).alias("clicks_stream"),
    )
