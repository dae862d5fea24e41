"""A warehouse whose tables are written when they are first asked for, and read from then on.

Built lazily, the snapshot's plan holds every builder below it, and a report that uses it twice holds them twice: a
hundred scans where a few do. Here each table is computed once for an application and a state of its inputs; what nobody
asks for is never built.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import scratch
from .warehouse import Warehouse


class StagedTables(Mapping):
    """Tables by name, each written at its first use."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], path: str) -> None:
        self.spark, self.tables, self.path, self._read = spark, tables, path, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = stage(self.spark, self.tables[name], f"{self.path}/{name}")
        return self._read[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def stage(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class StagedWarehouse(Warehouse):
    """``path``: a folder of its own."""

    def __init__(self, spark: SparkSession, raw: Mapping[str, DataFrame], path: str, first_week: int | None = None) -> None:
        super().__init__(spark, StagedTables(spark, raw, f"{path}/raw"), first_week)
        self.path, self.written, self.lock = path, {}, threading.RLock()  # copies share them


def _staged(name: str) -> cached_property:
    build = getattr(Warehouse, name).func

    def get(self: StagedWarehouse) -> DataFrame:
        with self.lock:
            if name not in self.written:
                self.written[name] = stage(self.spark, build(self), f"{self.path}/{name}")
        return self.written[name]

    own = cached_property(get)
    own.__set_name__(StagedWarehouse, name)
    return own


for _name in Warehouse.TABLES:
    setattr(StagedWarehouse, _name, _staged(_name))

_known: dict[tuple, StagedWarehouse] = {}


def inputs_state(spark: SparkSession, folder: str) -> tuple:
    """Name, length and time of every file in a folder of Parquet tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def staged(spark: SparkSession, folder: str, raw: Callable[[SparkSession, str], Mapping[str, DataFrame]], first_week: int | None = None) -> StagedWarehouse:
    """The staged warehouse over a folder: the same one as long as the application runs and the folder's files stay."""
    key = (spark.sparkContext.applicationId, inputs_state(spark, folder), first_week)
    if key not in _known:
        _known[key] = StagedWarehouse(spark, raw(spark, folder), scratch(spark, "warehouse"), first_week)
    return _known[key]
