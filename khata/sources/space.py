"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="khata-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/khata-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows, written as a table and reread: calculated once for all that reads them, and safe from lost executors."""
    at = new_folder(rows.sparkSession)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(spark: SparkSession, path: str) -> list[int]:
    """The numbered folders below a path that Spark wrote to their end, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
