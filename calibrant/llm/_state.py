"""Where jobs keep what they must not lose: the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own where it is unset and all work is on this machine, as in tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a reliable checkpoint; cuts the lineage and outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables of an iteration in the shared folder: each outlives executors, and the last one replaces those before."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, kind), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before(self) -> None:
        """Delete the table before the last; nothing may read it any more."""
        drop_folder(self.spark, f"{self.folder}/{self.n - 1}")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder inside the shared one."""
    folder = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    path, files = _hadoop(spark, folder)
    files.mkdirs(path)
    return files.makeQualified(path).toString()


def drop_folder(spark: SparkSession, folder: str) -> None:
    path, files = _hadoop(spark, folder)
    files.delete(path, True)


def _hadoop(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
