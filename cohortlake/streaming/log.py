"""Compaction of the stream's update log: a base with one row for each key and week, and the batches after it.

A base is a version of :class:`Versions`; its pointer moves when it is whole. The latest view reads the base and the batches
beyond its number. Once a base holds, older batches are in it: they can be removed, and one that is written again, because
the stream replays it, changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .weekly import LOG_SCHEMA, latest, read_log


@dataclass
class CompactedLog:
    """``log``: the folder that the stream writes, a directory for each batch. ``root``: where the bases are kept."""

    spark: SparkSession
    log: str
    root: str

    @property
    def bases(self) -> Versions:
        return Versions(self.spark, self.root)

    def base(self) -> tuple[DataFrame, int]:
        """The base that holds and the last batch in it; an empty one and -1 before the first."""
        try:
            folder = self.bases.current()
        except FileNotFoundError:
            return self.spark.createDataFrame([], LOG_SCHEMA), -1
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/base"), self.spark.read.parquet(f"{folder}/upto").first()[0]  # one row

    def tail(self, upto: int) -> DataFrame:
        """Batches after ``upto``: directories before it aren't read."""
        return read_log(self.spark, self.log).where(F.col("batch_id") > upto)

    def latest(self) -> DataFrame:
        """The latest update of each key and week."""
        base, upto = self.base()
        return latest(base.unionByName(self.tail(upto)))

    def compact(self, complete: int) -> int:
        """A new base of everything up to batch ``complete``, which the stream has committed; rows in it."""
        base, upto = self.base()
        if complete <= upto:
            return base.count()
        versions = self.bases
        folder = versions.new()
        latest(base.unionByName(self.tail(upto).where(F.col("batch_id") <= complete))).write.parquet(f"{folder}/base")
        self.spark.range(1).select(F.lit(complete).cast("long").alias("upto")).write.parquet(f"{folder}/upto")
        versions.publish(folder)
        return self.spark.read.parquet(f"{folder}/base").count()

    def remove_old(self) -> list[str]:
        """Removes the batches that the base holds, and former bases; names of the batches."""
        _, upto = self.base()
        self.bases.remove_old()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.log).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = []
        for s in fs.listStatus(path(self.log)):
            name = s.getPath().getName()
            if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= upto:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)
