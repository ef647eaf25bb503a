"""Streams: a change log with the last row of each key, and windowed counts.

A micro-batch costs what it holds, not what the table holds: its last row of each
key goes to a folder of its own, which a replay after a failure overwrites with
the same rows. Readers merge the folders by key; :func:`compact` merges them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from curatrix.operators.dedup import latest


def follow(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or one file; at most ``files`` of them in a micro-batch."""
    reader = spark.readStream.schema(schema)
    path = path.rstrip("/")
    # Streams take a plain path for a folder, but a pattern may also match a file; this one matches just the path.
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def log_changes(stream: DataFrame, folder: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    """Append the last row by ``order`` of each key of each micro-batch to the log; ends when all present input is read."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, schema: StructType | str, key: str, order: list[str]) -> DataFrame:
    """The last row of each key of a log; of rows equal by ``order`` that of the later batch."""
    columns = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    both = StructType([*columns.fields]).add("batch", "long")
    return latest(spark.read.schema(both).parquet(folder), key, [*order, "batch"]).drop("batch")


def compact(spark: SparkSession, folder: str, target: str, schema: StructType | str, key: str, order: list[str]) -> None:
    """The merged log as the first batch of the new log ``target``; later batches have higher numbers."""
    current(spark, folder, schema, key, order).write.mode("overwrite").parquet(f"{target}/batch=-1")


def windowed(stream: DataFrame, time: str, keys: list[str], *, width: str, lateness: str, values: dict[str, Column] | None = None) -> DataFrame:
    """Rows counted by tumbling window and ``keys``, with more aggregates in ``values``; state older than ``lateness`` is dropped.

    Also takes a table that isn't a stream, and then counts all its rows. Times without zone are read in the session's zone.
    """
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    aggs = [F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in (values or {}).items()]]
    rows = stream.withWatermark(time, lateness) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, width).alias("span"), *keys).agg(*aggs)
    return out.select(F.col("span.start").alias("start"), F.col("span.end").alias("stop"), *keys, "n", *(values or {}))


def write_windows(windows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append windows once the watermark has closed them."""
    return windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
