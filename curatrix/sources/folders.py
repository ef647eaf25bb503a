"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the one that all executors share, removed when the driver ends.

    The folder is that of ``spark.checkpoint.dir``. Only a local session, whose tasks share the driver's disk, gets one
    of its own where that is unset.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", top)
    folder = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, path = located(spark, folder)
    system.deleteOnExit(path)
    return folder


def located(spark: SparkSession, folder: str):
    """The file system of a folder and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no frame reads any more."""
    system, path = located(spark, folder)
    system.delete(path, True)


def shared_copy(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share, and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
