"""Keyed tables in a folder: created once, upserted by versions, scanned whole or in batches.

A table is a folder of Parquet versions; an upsert writes the next one whole before readers see it, so a failure leaves the
former version as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatrix.sources.store import _located, upsert

_TEXTS = lambda *names: ", ".join(f"{n} string" for n in names)
#: The tables and their columns.
TABLES = {
    "jd_raw": _TEXTS("id", "source", "url", "crawl_time", "job_title", "company", "location", "salary", "raw_text", "html", "meta_json"),
    "jd_clean": _TEXTS("id", "raw_id", "job_title", "company", "location", "clean_text", "sections_json", "labels_json"),
    "resume_clean": _TEXTS("id", "clean_text", "sections_json", "labels_json"),
    "sft_samples": _TEXTS("id", "task_type", "source_group", "messages_json", "meta_json"),
}


class Tables:
    """The tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        system, path = _located(self.spark, f"{self.folder}/{name}")
        if not system.exists(path):
            return []
        done = (str(s.getPath().getName()) for s in system.listStatus(path) if system.exists(_located(self.spark, f"{s.getPath()}/_SUCCESS")[1]))
        return sorted(int(n[1:]) for n in done if n[:1] == "v" and n[1:].isdigit())

    def create(self) -> None:
        """Make the tables that aren't there."""
        for name, columns in TABLES.items():
            if not self._versions(name):
                self.spark.createDataFrame([], columns).write.parquet(f"{self.folder}/{name}/v0")

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"there is no table {name}")
        schema = StructType.fromDDL(TABLES[name])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Add rows by id; those there are replaced. Structs, maps and lists are kept as JSON, columns named meta, sections,
        labels and messages under their names with ``_json``."""
        packed = rows.select(
            *((F.to_json(F.col(c)) if not rows.schema[c].dataType.simpleString().startswith("string") and rows.schema[c].dataType.simpleString().startswith(("struct", "array", "map")) else F.col(c).cast("string")).alias(c) for c in rows.columns)
        )
        for c in ("meta", "sections", "labels", "messages"):
            if c in packed.columns:
                packed = packed.withColumnRenamed(c, f"{c}_json")
        names = StructType.fromDDL(TABLES[name]).names
        new = packed.select(*(F.col(n) if n in packed.columns else F.lit(None).cast("string").alias(n) for n in names))
        versions = self._versions(name)
        old = self.read(name) if versions else None
        upsert(old, new, "id", []).select(*names).write.parquet(f"{self.folder}/{name}/v{versions[-1] + 1 if versions else 0}")
        for v in versions[:-1]:  # the last stays for those that read it now
            system, path = _located(self.spark, f"{self.folder}/{name}/v{v}")
            system.delete(path, True)

    def batches(self, name: str, size: int = 1000) -> Iterator[list[Row]]:
        """The rows in lists of ``size``, a partition at a time in the driver."""
        if size <= 0:
            raise ValueError("the size of batches must be positive")
        batch: list[Row] = []
        for row in self.read(name).toLocalIterator():
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch
