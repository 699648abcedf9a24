"""Versions of a table in a folder: every change writes a new version, readers take the latest complete one.

A version's rows lie in a folder of their own, under a name nobody else writes to; the version itself is a small file with
that name, which is created in one step and only if it isn't there. So of several writers one gets a number, and what a
writer that failed has left behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions, in order."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isFile()]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def _rows_of(spark: SparkSession, path: str, number: int) -> str:
    at, fs = _files(spark, f"{path}/v{number:08d}")
    told = fs.open(at)
    try:
        return told.readUTF()
    finally:
        told.close()


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """One version for a whole job, so that several reads agree."""
    have = versions(spark, path)
    return spark.read.parquet(f"{path}/{_rows_of(spark, path, have[-1])}") if have else None


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Writes the next version and gives its number; fails, and leaves no version, if another writer took it meanwhile."""
    spark = df.sparkSession
    number, rows = (versions(spark, path) or [0])[-1] + 1, f"rows-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{path}/{rows}")
    commit(spark, path, number, rows)
    return number


def commit(spark: SparkSession, path: str, number: int, rows: str) -> None:
    at, fs = _files(spark, f"{path}/v{number:08d}")
    try:
        mark = fs.create(at, False)
    except Exception as e:
        raise FileExistsError(f"version {number} of {path} was written by another") from e
    mark.writeUTF(rows)
    mark.close()


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all versions but the last `keep`; gives the numbers of those deleted."""
    old = versions(spark, path)[:-keep]
    for n in old:
        for name in (_rows_of(spark, path, n), f"v{n:08d}"):
            at, fs = _files(spark, f"{path}/{name}")
            fs.delete(at, True)
    return old
