"""Tables in a relational row store over JDBC: written beside the old table, counted there, and only then put in its place.

Tasks write their partitions in transactions of their own, so a task that runs again can leave rows twice; the count and the
primary key find that, and the former table stays. Statements that differ between stores are data (``STATEMENTS``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

STATEMENTS = {
    "derby": {"rename": 'RENAME TABLE "{old}" TO "{new}"', "not_null": 'ALTER TABLE "{table}" ALTER COLUMN "{column}" NOT NULL'},
    "postgresql": {"rename": 'ALTER TABLE "{old}" RENAME TO "{new}"', "not_null": 'ALTER TABLE "{table}" ALTER COLUMN "{column}" SET NOT NULL'},
}


class LoadError(RuntimeError):
    """The table in the store isn't what was sent; the former one stays."""


@dataclass
class RowStore:
    """``url``: a JDBC URL whose driver the session has. ``text``: characters of a text column; longer values are refused
    by the store, not cut. ``writers``: tasks that write at once, each over a connection."""

    spark: SparkSession
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    text: int = 255
    writers: int = 8
    batch: int = 10_000

    def __post_init__(self) -> None:
        kind = self.url.split(":")[1]
        if kind not in STATEMENTS:
            raise ValueError(f"no statements for {kind}")
        self.say = STATEMENTS[kind]

    @contextmanager
    def _connection(self) -> Iterator[Any]:
        """One transaction on the driver, for statements that move no rows."""
        jvm = self.spark.sparkContext._jvm
        options = jvm.java.util.Properties()
        for k, v in self.properties.items():
            options.setProperty(k, v)
        con = jvm.java.sql.DriverManager.getConnection(self.url, options)
        con.setAutoCommit(False)
        try:
            yield con
            con.commit()
        except BaseException:
            con.rollback()
            raise
        finally:
            con.close()

    def _run(self, con: Any, statement: str) -> None:
        s = con.createStatement()
        s.execute(statement)
        s.close()

    def _number(self, con: Any, query: str) -> int:
        s = con.createStatement()
        rows = s.executeQuery(query)
        rows.next()
        out = rows.getLong(1)
        s.close()
        return out

    def has(self, table: str) -> bool:
        with self._connection() as con:
            found = con.getMetaData().getTables(None, None, table, None)
            out = found.next()
            found.close()
        return out

    def count(self, table: str) -> int:
        with self._connection() as con:
            return self._number(con, f'SELECT count(*) FROM "{table}"')

    def load(self, df: DataFrame, table: str, keys: list[str], expected: int | None = None) -> int:
        """``df`` in place of ``table``, with a primary key; the number of rows. ``expected``: rows it must have, counted in
        ``df`` unless given."""
        side = f"{table}__new"
        expected = df.count() if expected is None else expected
        if self.has(side):
            with self._connection() as con:
                self._run(con, f'DROP TABLE "{side}"')
        types = ", ".join(f"{f.name} VARCHAR({self.text})" for f in df.schema if f.dataType.typeName() == "string")
        writer = df.coalesce(self.writers).write.format("jdbc").options(url=self.url, dbtable=f'"{side}"', batchsize=str(self.batch), isolationLevel="READ_COMMITTED", **self.properties)
        (writer.option("createTableColumnTypes", types) if types else writer).mode("errorifexists").save()
        try:
            with self._connection() as con:
                n = self._number(con, f'SELECT count(*) FROM "{side}"')
                if n != expected:
                    raise LoadError(f"{table}: {n} rows in the store, expected {expected}")
                for c in keys:
                    self._run(con, self.say["not_null"].format(table=side, column=c))
                columns = ", ".join(f'"{c}"' for c in keys)
                self._run(con, f'ALTER TABLE "{side}" ADD PRIMARY KEY ({columns})')
        except Exception as e:
            with self._connection() as con:
                self._run(con, f'DROP TABLE "{side}"')
            raise e if isinstance(e, LoadError) else LoadError(f"{table}: {e}") from e
        there = self.has(table)
        with self._connection() as con:  # both or neither
            if there:
                self._run(con, f'DROP TABLE "{table}"')
            self._run(con, self.say["rename"].format(old=side, new=table))
        return n

    def read(self, table: str, split: str | None = None, parts: int = 8) -> DataFrame:
        """The table; with ``split``, a whole-number column, in ``parts`` reads at once between its ends in the store."""
        options = {"url": self.url, "dbtable": f'"{table}"', **self.properties}
        if split:
            with self._connection() as con:
                low, high = (self._number(con, f'SELECT coalesce({f}("{split}"), 0) FROM "{table}"') for f in ("min", "max"))
            options |= {"partitionColumn": f'"{split}"', "lowerBound": str(low), "upperBound": str(max(high, low + 1)), "numPartitions": str(parts)}
        return self.spark.read.format("jdbc").options(**options).load()


def load_all(store: RowStore, tables: dict[str, DataFrame], keys: dict[str, list[str]], counts: dict[str, int] | None = None) -> dict[str, int]:
    """Rows of each table in the store. ``counts``: what the tables were published with, so that they aren't counted again."""
    return {name: store.load(df, name, keys[name], (counts or {}).get(name)) for name, df in tables.items()}
