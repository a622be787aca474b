"""Key-value tables of SQLite files as a Spark data source, read by row id ranges."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The tables of an editor's storage, and the keys that hold chats in each.
CURRENT, CURRENT_KEYS = "cursorDiskKV", ("composerData:", "chatData:", "bubbleId:")
LEGACY, LEGACY_KEYS = "ItemTable", ("composer.composerData", "workbench.panel.aichat.view.aichat.chatdata")


@dataclass
class Rows(InputPartition):
    """Row ids from ``low`` up to, not including, ``high``."""

    low: int
    high: int


class KeyValueReader(DataSourceReader):
    """Reads (key, value) of one table; values are text, bytes are decoded and left null where they are no UTF-8."""

    def __init__(self, options: dict[str, str]):
        self.path, self.table, self.rows = options["path"], options.get("table", CURRENT), int(options.get("rowsaread", "100000"))
        self.prefixes = [p for p in options.get("prefixes", "").split("\n") if p]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def _name(self) -> str:
        return '"' + self.table.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        con = self._open()
        try:
            if not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.table,)).fetchone():
                return []
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self._name()}").fetchone()
        finally:
            con.close()
        return [] if low is None else [Rows(at, min(at + self.rows, high + 1)) for at in range(low, high + 1, self.rows)]

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was none to read
            return
        con = self._open()
        try:
            wanted = " OR ".join("substr(key, 1, ?) = ?" for _ in self.prefixes) or "1"
            values = [x for p in self.prefixes for x in (len(p), p)]
            found = con.execute(f"SELECT key, value FROM {self._name()} WHERE rowid >= ? AND rowid < ? AND ({wanted})", (partition.low, partition.high, *values))
            while rows := found.fetchmany(1000):
                yield pa.RecordBatch.from_arrays([pa.array([_text(r[i]) for r in rows], pa.string()) for i in (0, 1)], names=["key", "value"])
        finally:
            con.close()


def _text(value: object) -> str | None:
    if isinstance(value, bytes):
        try:
            return value.decode()
        except UnicodeDecodeError:
            return None
    return None if value is None else str(value)


class KeyValueSource(DataSource):
    """format("sqlite_kv"): options path (a file that every executor can open), table, prefixes (one a line), rowsARead."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema: object) -> DataSourceReader:
        path = self.options.get("path", "")
        if not path or ":" in path.split("/")[0]:
            raise ValueError("sqlite_kv reads a file path that every machine can open, not a store's address")
        return KeyValueReader(self.options)


def chat_storage(spark: SparkSession, path: str, rows_a_read: int = 100_000) -> DataFrame:
    """(key, value, layout) of the chats in a storage file: the current table's, then the legacy one's; a table that isn't there has none."""
    spark.dataSource.register(KeyValueSource)

    def table(name: str, prefixes: tuple[str, ...], layout: str) -> DataFrame:
        found = spark.read.format("sqlite_kv").options(path=path, table=name, prefixes="\n".join(prefixes), rowsARead=rows_a_read).load()
        return found.withColumn("layout", F.lit(layout))

    return table(CURRENT, CURRENT_KEYS, "current").unionByName(table(LEGACY, LEGACY_KEYS, "legacy"))
