"""Sources and sinks: line-delimited JSON, CSV, Parquet and text by suffix, keyed upserts, and shared copies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatrix.operators.dedup import latest
from curatrix.sources.folders import located as _located
from curatrix.sources.folders import remove, shared_copy, shared_folder  # noqa: F401


def read_rows(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Rows of .jsonl, .json (an array), .csv (with header) or .parquet; bad lines fail, and null texts of CSV are empty."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "jsonl":
        return reader.option("mode", "FAILFAST").json(path)
    if kind == "json":
        return reader.option("mode", "FAILFAST").option("multiLine", "true").json(path)
    if kind == "csv":
        return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).na.fill("")
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for {path}")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text, a line a row, as a single file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest_sources(spark: SparkSession, path: str) -> list[dict]:
    """The sources of a manifest, JSON or, where that can be read, YAML."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("this manifest needs a reader of YAML") from e
        value = yaml.safe_load(text) or {}
    else:
        value = json.loads(text)
    found = value.get("sources") or []
    if not isinstance(found, list):
        raise ValueError(f"the sources of {path} are not a list")
    return found


def prediction_paths(spark: SparkSession, inputs: list[str], ending: str = "predictions.jsonl") -> list[str]:
    """Files named by paths, patterns or folders, each once: a folder stands for its files with the ending, by name."""
    out: list[str] = []
    for given in inputs:
        system, path = _located(spark, given)
        if any(c in given for c in "*?[]"):
            found = sorted(str(s.getPath()) for s in system.globStatus(path) or [])
        elif system.exists(path) and system.getFileStatus(path).isDirectory():
            found = sorted(str(s.getPath()) for s in system.listStatus(path) if str(s.getPath().getName()).endswith(ending))
        else:
            found = [given]
        out += [f for f in found if f not in out]
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, pins: DataFrame) -> DataFrame:
    """``pins`` (path, expected) with ``ok``: whether the file is there with that SHA-256."""
    return pins.join(files.select("path", "sha256"), "path", "left").withColumn("ok", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)))


def sources(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """All enabled sources of a manifest, their mapped columns renamed and their provenance added as columns."""
    out: DataFrame | None = None
    for m in manifest:
        if not m.get("enabled", True):
            continue
        rows = read_rows(spark, m["local_path"])
        if m.get("mapping"):
            rows = rows.select(*[F.col(path).alias(name) for name, path in m["mapping"].items()])
        rows = rows.withColumns(
            {k: F.lit(m.get(k)) for k in ("license_status", "intended_usage", "provenance_status", "training_eligible")}
        ).withColumn("source_name", F.lit(m["name"]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("the manifest has no enabled source")
    return out


def upsert(existing: DataFrame | None, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of both, the last by ``order`` of each key; of equal ones the new row."""
    new = new.withColumn("_new", F.lit(1))
    both = new if existing is None else existing.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    return latest(both, key, [*order, "_new"]).drop("_new")
