"""A set of tables that is published in one step: versioned folders, and a pointer that is written last.

``<root>/versions/<name>/<table>`` holds a version; ``<root>/pointers/<number>`` names one, and the highest number holds. A
pointer file is written under another name and then renamed, which a store does whole or not at all, and never over
an existing one; two publishers at once get two numbers. Until the pointer stands, readers see the version before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._names("pointers") if n.isdigit()]

    def _read(self, pointer: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/pointers/{pointer}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def new(self) -> str:
        """The folder of a new version; nothing reads it yet."""
        return f"{self.root}/versions/{uuid.uuid4().hex}"

    def publish(self, folder: str) -> None:
        """The version in ``folder`` is what readers get from now on."""
        name = folder.rstrip("/").rsplit("/", 1)[-1]
        if not self._fs.exists(self._path(f"{self.root}/versions/{name}")):
            raise FileNotFoundError(folder)
        draft = self._path(f"{self.root}/pointers/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(name.encode()))
        out.close()
        number = int(self._pointers()[-1]) + 1 if self._pointers() else 0
        while self._fs.exists(self._path(f"{self.root}/pointers/{number:012d}")) or not self._fs.rename(draft, self._path(f"{self.root}/pointers/{number:012d}")):
            number += 1

    def current(self) -> str:
        """The folder that holds now."""
        pointers = self._pointers()
        if not pointers:
            raise FileNotFoundError(f"{self.root}: nothing is published")
        return f"{self.root}/versions/{self._read(pointers[-1])}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.current()}/{table}")

    def back(self) -> str:
        """The version before holds again, by a new pointer."""
        pointers = self._pointers()
        if len(pointers) < 2:
            raise FileNotFoundError(f"{self.root}: no version before")
        folder = f"{self.root}/versions/{self._read(pointers[-2])}"
        self.publish(folder)
        return folder

    def remove_old(self, keep: int = 1) -> list[str]:
        """Removes all versions but those of the last ``keep`` pointers, drafts that failed included; to be called when
        nobody builds or reads them any more."""
        pointers = self._pointers()
        held = {self._read(p) for p in pointers[-keep:]}
        gone = [n for n in self._names("versions") if n not in held]
        for p in pointers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/pointers/{p}"), False)
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/versions/{n}"), True)
        return gone
