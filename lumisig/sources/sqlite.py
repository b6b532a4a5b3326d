"""Signature tables in SQLite files, as a Spark data source.

    SqliteImages.register(spark)
    spark.read.format("sqlite_images").load("/shared/images.sqlite")

The file is opened read-only and must be reachable under its path by the executors. Ranges of the
table's row ids are read by different tasks; rows must have blobs of the right length.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Columns of the legacy table.
SCHEMA = "post_id int, avglf1 double, avglf2 double, avglf3 double, sig binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def open_readonly(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "images")
        self.rows, self.blob = int(options.get("rowsperpartition", 200_000)), int(options.get("bloblength", 240))
        if not self.table.isidentifier():
            raise ValueError(f"not a table name: {self.table}")

    def partitions(self) -> list[_Range]:
        with open_readonly(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        return [_Range(0, -1)] if low is None else [_Range(i, min(i + self.rows - 1, high)) for i in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open_readonly(self.path) as db:
            for row in db.execute(f"SELECT {', '.join(COLUMNS)} FROM {self.table} WHERE rowid BETWEEN ? AND ? ORDER BY post_id", (partition.low, partition.high)):
                if len(row[4]) != self.blob:
                    raise ValueError(f"post {row[0]}: signature blob must be {self.blob} bytes, got {len(row[4])}")
                yield row


class SqliteImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_images"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def write(rows: DataFrame, path: str) -> int:
    """Write a table as one SQLite file on the driver, a partition at a time; returns how many rows."""
    n = 0
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE images (id INTEGER PRIMARY KEY, post_id INTEGER UNIQUE, avglf1 REAL, avglf2 REAL, avglf3 REAL, sig BLOB)")
        ordered = rows.select(*COLUMNS).orderBy("post_id").toLocalIterator()
        while part := [(*r[:4], bytes(r[4])) for r in islice(ordered, 10_000)]:
            db.executemany("INSERT INTO images (post_id, avglf1, avglf2, avglf3, sig) VALUES (?, ?, ?, ?, ?)", part)
            n += len(part)
    return n
