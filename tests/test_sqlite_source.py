"""SQLite files read in ranges, by columns and as a stream, against sqlite3 itself."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from lorewell.sources import sqlite_source


def fill(path, statements):
    with sqlite3.connect(path) as db:
        for s, values in statements:
            db.executemany(s, values) if values else db.execute(s)
    db.close()
    return str(path)


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    values = [(i, f"t{i}", i / 4) for i in range(-50, 25_000) if i % 3]
    at = fill(tmp_path / "a.db", [("CREATE TABLE facts (id INTEGER PRIMARY KEY, name TEXT, score REAL)", None), ("INSERT INTO facts VALUES (?, ?, ?)", values)])
    df = sqlite_source.rows(spark, f"file://{at}", "facts", per_task=4_000)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")] and df.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, df.collect())) == values
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 7
    narrow = sqlite_source.rows(spark, at, "facts", "score double, absent string")
    assert sorted(r.score for r in narrow.where("absent IS NULL").collect()) == [v[2] for v in values]


def test_files_that_differ(spark, tmp_path):
    fill(tmp_path / "a.db", [('CREATE TABLE "od""d" (k TEXT PRIMARY KEY, v) WITHOUT ROWID', None), ('INSERT INTO "od""d" VALUES (?, ?)', [("a", 1), ("b", None)])])
    fill(tmp_path / "b.db", [('CREATE TABLE "od""d" (k INTEGER, w BLOB)', None), ('INSERT INTO "od""d" VALUES (?, ?)', [(7, b"\xff"), ("text", "x"), (None, None), (2.5, 3)])])
    fill(tmp_path / "c.db", [("CREATE TABLE other (k)", None)])
    fill(tmp_path / "d.db", [('CREATE TABLE "od""d" (k)', None)])
    fill(tmp_path / "e.db", [('CREATE TABLE src (k)', None), ("INSERT INTO src VALUES (?)", [("of a view",)]), ('CREATE VIEW "od""d" AS SELECT k FROM src', None)])
    df = sqlite_source.rows(spark, str(tmp_path), 'od"d')
    assert df.dtypes == [("k", "string"), ("v", "string"), ("w", "binary")] or sorted(df.columns) == ["k", "v", "w"]
    got = {(r.k, r.v, bytes(r.w) if r.w is not None else None) for r in df.collect()}
    assert got == {("a", "1", None), ("b", None, None), ("7", None, b"\xff"), ("text", None, b"x"), (None, None, None), ("2.5", None, b"3"), ("of a view", None, None)}
    numbers = sqlite_source.rows(spark, str(tmp_path / "b.db"), 'od"d', "k bigint")
    assert sorted(r.k for r in numbers.where("k IS NOT NULL").collect()) == [7] and numbers.count() == 4
    assert sqlite_source.rows(spark, str(tmp_path / "c.db"), 'od"d', "k string").collect() == []
    with pytest.raises(Exception, match="no file of"):
        sqlite_source.rows(spark, str(tmp_path / "c.db"), 'od"d').collect()
    with pytest.raises(Exception, match="not k date"):
        sqlite_source.rows(spark, str(tmp_path / "b.db"), 'od"d', "k date").collect()


def test_far_rowids_make_a_bounded_number_of_tasks(tmp_path):
    at = fill(tmp_path / "a.db", [("CREATE TABLE t (id INTEGER PRIMARY KEY)", None), ("INSERT INTO t VALUES (?)", [(-(2**63),), (0,), (2**63 - 1,)])])
    parts = list(sqlite_source.ranges(at, "t", 1000))
    assert len(parts) == sqlite_source.TASKS and parts[0].first == -(2**63) and parts[-1].last == 2**63 - 1
    assert all(a.last + 1 == b.first for a, b in zip(parts, parts[1:], strict=False))


def test_a_file_that_changes_is_refused(spark, tmp_path):
    at = fill(tmp_path / "a.db", [("CREATE TABLE t (id INTEGER)", None), ("INSERT INTO t VALUES (?)", [(i,) for i in range(30_000)])])
    schema = spark.createDataFrame([], "id bigint").schema
    part = next(sqlite_source.ranges(at, "t", 100_000))
    batches = sqlite_source.read(part, "t", schema)
    assert next(batches).num_rows == 10_000
    os.utime(at, ns=(1, 1))  # writers wait for readers, but a file can be put in the place of another
    with pytest.raises(RuntimeError, match="changed"):
        list(batches)
    fill(at, [("INSERT INTO t VALUES (?)", [(i,) for i in range(9_000)])])
    with pytest.raises(RuntimeError, match="changed"):
        next(sqlite_source.read(part, "t", schema))


def test_a_stream_skips_files_that_are_as_before(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), f"file://{tmp_path}/state"
    folder.mkdir()
    make = ("CREATE TABLE t (id INTEGER)", None)
    a = fill(folder / "a.db", [make, ("INSERT INTO t VALUES (?)", [(1,), (2,)])])
    fill(folder / "b.db", [make, ("INSERT INTO t VALUES (?)", [(3,)])])

    def go():
        rows = sqlite_source.changes(spark, str(folder), "t", "id bigint")
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination(60)
        return sorted(r.id for r in spark.read.schema("id bigint").parquet(out).collect())

    assert go() == [1, 2, 3]
    fill(folder / "c.db", [make, ("INSERT INTO t VALUES (?)", [(4,)])])
    fill(a, [("INSERT INTO t VALUES (?)", [(5,)])])
    assert go() == [1, 1, 2, 2, 3, 4, 5]
    assert go() == [1, 1, 2, 2, 3, 4, 5]
