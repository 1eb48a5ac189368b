"""Vector files: {"version": n, "vectors": [...]} of inputs and expected outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, path: str, vector: str) -> DataFrame:
    """One row per vector. vector: the DDL of one."""
    return spark.read.schema(f"version int, vectors array<struct<{vector}>>").option("multiLine", True).json(path).select(F.explode("vectors").alias("v")).select("v.*")


def write_vectors(df: DataFrame, path: str, version: int = 1) -> None:
    """All rows as one vector file: a fixture's few rows."""
    df.agg(F.lit(version).alias("version"), F.collect_list(F.struct("*")).alias("vectors")).coalesce(1).write.mode("overwrite").json(path)


def read_messages(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Labelled messages in JSON lines."""
    return spark.read.schema(ddl).json(path)
