"""Resumable collection, incremental scores and flag rates as streams (STM-01..04)."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import types as T

from calibrant.functions.structure import before_cutoff
from calibrant.sources.sinks import upsert


def land(source: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each new batch to ``write`` once and stop when all is read; a restart goes on from the checkpoint (STM-01)."""
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def settled(items: DataFrame, cutoff: str) -> DataFrame:
    """Items created and last changed before the cut-off (STM-02, STM-03)."""
    return items.where(before_cutoff(cutoff, F.col("created_at"), F.col("updated_at")))


def upsert_into(spark: SparkSession, folder: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that merges into a table of generations: readers see the last whole one (STM-04)."""

    def write(batch: DataFrame, number: int) -> None:
        old = f"{folder}/{number - 1}"
        merged = batch if number == 0 else upsert(spark.read.parquet(old), batch, keys, version)
        latest = merged if number else upsert(batch.limit(0), batch, keys, version)
        latest.write.mode("overwrite").parquet(f"{folder}/{number}")

    return write


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last generation that was wholly written."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files_of = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files_of.listStatus(path(folder))]
    whole = [int(n) for n in names if n.isdigit() and files_of.exists(path(f"{folder}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{folder}/{max(whole)}")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all nodes share; a folder of this machine only where all work is on it."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    return tempfile.mkdtemp(prefix="stream-")


def flag_rates(events: DataFrame, threshold: float, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Share of values at or above a threshold per kind and tumbling window; works on streams and tables alike."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg((F.col("value") >= threshold).cast("double")).alias("rate")).select(F.col("w.start").alias("start"), "event_type", "n", "rate")
