"""Tables written in between, so that later plans start from files that the loss of an executor leaves whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine, as in tests.
FALLBACK = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or FALLBACK).rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table of its own, read back."""
    path = f"{shared_dir(df.sparkSession)}/sortilege/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table is sent to every executor.
BROADCAST_ROWS = 100_000


def fitting(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, as a bounded count tells; else as it is, so that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
