"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.store import shared_folder

#: Bytes of an Arrow batch: a task holds one in the executor and one in Python.
BATCH_BYTES = "2m"
#: Rows of a slice of an Arrow batch in Python; texts can be long.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: it cuts the lineage and outlives executors."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`materialize`, with the folder, for :func:`curatrix.sources.store.remove` once nothing reads it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, which hold whole texts; their rows stay as they are set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of few rows. Spark bounds the bytes of a batch; this bounds what Python makes of one at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(k, BATCH_ROWS)


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009..U+000D, as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
