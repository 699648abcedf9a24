"""Tables in the folder that the cluster names in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, and in local mode, a temporary folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: later plans start there, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(*tables: DataFrame) -> str:
    """A name that changes if a file of the tables does: from the files' paths, sizes and times, without reading them."""
    files = None
    for df in tables:
        own = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        files = own if files is None else files.unionByName(own)
    total = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0]
    return f"{int(total or 0) & (2**64 - 1):016x}"


def drop_table(df: DataFrame) -> None:
    """Deletes a table that cut() made, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
