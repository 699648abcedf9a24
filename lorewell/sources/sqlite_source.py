"""SQLite files as a data source of Spark: tables are read by ranges of rowids, in batches or as a stream of changed files."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a task if rowids have no gaps, tasks of a file at most, and rows of an Arrow batch.
ROWS, TASKS, BATCH = 100_000, 4_096, 10_000
#: What a column of a type keeps of a value, by SQLite's own types; anything else is null.
KEPT = {
    "bigint": ("CASE WHEN typeof({c}) = 'integer' THEN {c} END", pa.int64()),
    "double": ("CASE WHEN typeof({c}) IN ('integer', 'real') THEN CAST({c} AS REAL) END", pa.float64()),
    "string": ("CASE WHEN typeof({c}) <> 'blob' THEN CAST({c} AS TEXT) END", pa.string()),
    "binary": ("CAST({c} AS BLOB)", pa.binary()),
}
#: Types of columns by a part of the type they are declared with, the first that fits.
DECLARED = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))


def files(path: str) -> list[str]:
    """Files that a path names: one, those of a folder, or those of a pattern; a folder that all executors see."""
    local = unquote(urlsplit(path).path) if path.startswith("file:") else path
    if "://" in local:
        raise ValueError(f"SQLite reads files of mounted folders only, not {path}")
    found = [os.path.join(local, n) for n in os.listdir(local)] if os.path.isdir(local) else [local] if os.path.exists(local) else glob.glob(local)
    return sorted(f for f in found if os.path.isfile(f) and not f.endswith(("-wal", "-shm", "-journal")))


def fingerprint(file: str) -> list[int]:
    """Size and time of a file and of the log of its writes: these change if its rows do."""
    marks = []
    for f in (file, f"{file}-wal"):
        at = os.stat(f) if os.path.exists(f) else None
        marks += [at.st_size, at.st_mtime_ns] if at and (f == file or at.st_size) else [0, 0]
    return marks


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(file: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"{Path(file).absolute().as_uri()}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def columns(db: sqlite3.Connection, table: str) -> dict[str, str]:
    """Columns of a table and the types of Spark that fit their declarations; none if there is no such table."""
    return {r[1]: next((t for part, t in DECLARED if part in r[2].upper()), "string") for r in db.execute(f"PRAGMA table_info({quoted(table)})")}


@dataclass
class Rows(InputPartition):
    """Rows of a file between two rowids, both included; all rows where a table has no rowids."""

    file: str
    marks: list[int]
    first: int | None = None
    last: int | None = None


def ranges(file: str, table: str, rows: int) -> Iterator[Rows]:
    """The tasks of a file: ranges of as many rowids, more where one file would make over TASKS of them."""
    marks, db = fingerprint(file), connect(file)
    try:
        if not columns(db, table):
            return
        try:
            low, high = (db.execute(f"SELECT {end}(rowid) FROM {quoted(table)}").fetchone()[0] for end in ("min", "max"))
        except sqlite3.OperationalError:  # a table made without rowids
            low = None
        if low is None:  # or a view, whose rowids are null, or no rows
            yield Rows(file, marks)
            return
        step = max(rows, -(-(high - low + 1) // TASKS))
        for first in range(low, high + 1, step):
            yield Rows(file, marks, first, min(first + step - 1, high))
    finally:
        db.close()


def unchanged(part: Rows) -> None:
    if fingerprint(part.file) != part.marks:
        raise RuntimeError(f"{part.file} changed while it was read")


def read(part: Rows, table: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows of a range as Arrow batches; fails if the file is not, or at the end no more, the one that was planned for."""
    types = [f.dataType.simpleString() for f in schema]
    wrong = [f"{f.name} {t}" for f, t in zip(schema, types, strict=True) if t not in KEPT]
    if wrong:
        raise ValueError(f"columns of SQLite are {', '.join(KEPT)}, not {', '.join(wrong)}")
    out = pa.schema([(f.name, KEPT[t][1]) for f, t in zip(schema, types, strict=True)])
    unchanged(part)
    db = connect(part.file)
    try:
        have = columns(db, table)
        chosen = ", ".join(KEPT[t][0].format(c=quoted(f.name)) if f.name in have else "NULL" for f, t in zip(schema, types, strict=True))
        within, ends = (" WHERE rowid BETWEEN ? AND ?", (part.first, part.last)) if part.first is not None else ("", ())
        cursor = db.execute(f"SELECT {chosen or 'NULL'} FROM {quoted(table)}{within}", ends)
        while batch := cursor.fetchmany(BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*batch, strict=True), out.types, strict=False)], schema=out)
    finally:
        db.close()
    unchanged(part)


class _Batch(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.rows, self.schema = options["path"], options["table"], int(options.get("rows", ROWS)), schema

    def partitions(self):
        return [r for f in files(self.path) for r in ranges(f, self.table, self.rows)] or [Rows("", [])]

    def read(self, partition):
        return read(partition, self.table, self.schema) if partition.file else iter(())


class _Stream(_Batch, DataSourceStreamReader):
    """An offset is every file's fingerprint; a batch reads the files whose fingerprint is another than before."""

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {f: fingerprint(f) for f in files(self.path)}

    def partitions(self, start, end):
        changed = [f for f, marks in end.items() if start.get(f) != marks and os.path.exists(f)]
        return [r for f in changed for r in ranges(f, self.table, self.rows)] or [Rows("", [])]

    def commit(self, end):
        pass


class SqliteSource(DataSource):
    """`spark.read.format("sqlite").option("table", t).load(path)` once SqliteSource is registered.

    path: a file, folder or pattern in a folder that the driver and all executors see. Several tasks read a file, each
    a range of `rows` (100,000) rowids. With a schema (bigint, double, string, binary) only its columns are read; columns
    that a file lacks, values of other types than declared and bytes in texts give nulls. Without one, columns are those
    of all files, typed as the first that has them declares. A file without the table has no rows; one that changes
    while it is read fails the task. As a stream, a batch holds all rows of the files that are new or have changed:
    unchanged ones are not opened, and a reader keeps the latest row of a key.
    """

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        known = {}
        for f in files(self.options["path"]):
            db = connect(f)
            known = columns(db, self.options["table"]) | known
            db.close()
        if not known:
            raise ValueError(f"no file of {self.options['path']} has a table {self.options['table']}")
        return ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in known.items())

    def reader(self, schema):
        return _Batch(self.options, schema)

    def streamReader(self, schema):
        return _Stream(self.options, schema)


def rows(spark: SparkSession, path: str, table: str, schema: str | None = None, per_task: int = ROWS) -> DataFrame:
    """Rows of a table in SQLite files, as SqliteSource reads them."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("table", table).option("rows", per_task)
    return (reader.schema(schema) if schema else reader).load(path)


def changes(spark: SparkSession, path: str, table: str, schema: str, per_task: int = ROWS) -> DataFrame:
    """The same as a stream: rows of the files that are new or have changed since the last batch."""
    spark.dataSource.register(SqliteSource)
    return spark.readStream.format("sqlite").option("table", table).option("rows", per_task).schema(schema).load(path)
