"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in tests on one machine.
FALLBACK = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; FALLBACK where that is unset on one machine. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or FALLBACK).rstrip("/")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under plain column names c0_, c1_, ... that clash with no column of an operator, and the new name of each."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


class Scratch:
    """A folder of Parquet tables under the shared folder.

    A written table survives the loss of the executors that made it. `save`
    returns the table as reread; `drop` deletes those that no later plan reads.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sortilege/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
