"""Checkpoints and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the session names none, a local folder
    serves if the driver is the only machine, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4()}"


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all that is in it, wherever Spark can write."""
    store, at = _path(spark, folder)
    store.delete(at, True)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _path(spark, path)
    return store.exists(at)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    store, at = _path(spark, folder)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def checkpoint(frame: DataFrame) -> DataFrame:
    """`frame`, written to the shared folder."""
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint()


def staged(frame: DataFrame) -> tuple[DataFrame, str]:
    """`frame`, written as compressed columns to a folder of its own in the shared folder, and that folder. Far smaller
    than a checkpoint, and readers take the columns that they need."""
    folder = new_folder(frame.sparkSession, "staged")
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder), folder


def kept(frame: DataFrame, folder: str) -> DataFrame:
    """`frame`, written as a checkpoint, so that the folder it was read from can go."""
    out = checkpoint(frame)
    delete(frame.sparkSession, folder)
    return out
