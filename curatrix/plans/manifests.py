"""Freshness of derived data: what it was made from, whether that has changed since, and manifests of runs.

Manifests are JSON files of one line, written by Spark, so they lie in any store. Digests of folders are made of the digests
of their files, sorted by name, without reading them in the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.audits import meta, samples_profile
from curatrix.sources.store import _located


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _located(spark, path)
    return bool(system.exists(p))


def folder_digest(spark: SparkSession, path: str) -> tuple[int, str]:
    """(bytes, SHA-256) of a file or of the data files of a folder."""
    files = spark.read.format("binaryFile").load(path).filter(~F.regexp_extract("path", "([^/]+)$", 1).rlike("^[_.]"))
    one = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("d"))
    row = one.agg(
        F.coalesce(F.sum("length"), F.lit(0)),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "d"))), lambda s: s["d"]), ""), 256)
    ).first()
    return int(row[0]), row[1]


def raw_state(rows: DataFrame) -> dict:
    """Number of rows, the last crawl and the characters of texts and other data."""
    meta_column = "meta_json" if "meta_json" in rows.columns else "meta"
    row = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.max("crawl_time").cast("string"), F.lit("")), F.coalesce(F.sum(F.length("raw_text")), F.lit(0)),
        F.coalesce(F.sum(F.length(meta_column)), F.lit(0))
    ).first()
    return dict(zip(("row_count", "max_crawl_time", "raw_text_chars", "meta_chars"), row, strict=True))


def transform_digest(files: Sequence[str], parameters: dict | None = None) -> str:
    """SHA-256 of the names and contents of code files and of the parameters of a step."""
    digest = hashlib.sha256()
    for f in files:
        digest.update(Path(f).name.encode() + b"\0" + Path(f).read_bytes() + b"\0")
    digest.update(json.dumps(parameters or {}, ensure_ascii=False, sort_keys=True).encode())
    return digest.hexdigest()


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_manifest(spark: SparkSession, rows: DataFrame, output: str, manifest: str, transform: str) -> dict:
    """Record what ``output`` was made from: the state of the raw rows, the digest of the transform and that of the output."""
    size, digest = folder_digest(spark, output)
    value = {
        "schema_version": 1, "created_at": datetime.now(timezone.utc).isoformat(), "transform_sha256": transform, "raw_state": raw_state(rows),
        "output": {"path": output, "bytes": size, "sha256": digest}
    }
    write_json(spark, value, manifest)
    return value


def verify_manifest(spark: SparkSession, manifest: str, rows: DataFrame | None, transform: str) -> dict:
    """Whether the output that a manifest records is still what its inputs give, and if not why."""
    if not exists(spark, manifest):
        return {"fresh": False, "reasons": ["missing_manifest"]}
    said, reasons = read_json(spark, manifest), []
    if said.get("transform_sha256") != transform:
        reasons.append("transform_changed")
    state = raw_state(rows) if rows is not None else {}
    if rows is None:
        reasons.append("missing_raw_rows")
    elif state != said.get("raw_state"):
        reasons.append("raw_rows_changed")
    output = said.get("output") or {}
    if not exists(spark, output.get("path") or "/nowhere"):
        reasons.append("missing_output")
    elif folder_digest(spark, output["path"])[1] != output.get("sha256"):
        reasons.append("output_changed")
    return {"fresh": not reasons, "reasons": reasons, "recorded_raw_state": said.get("raw_state"), "current_raw_state": state}


def changed_at(spark: SparkSession, path: str) -> tuple[int, int]:
    """(first, last) time of change of the data files of a path, in milliseconds."""
    system, p = _located(spark, path)
    if system.getFileStatus(p).isFile():
        t = system.getFileStatus(p).getModificationTime()
        return t, t
    times, files = [], system.listFiles(p, True)
    while files.hasNext():
        s = files.next()
        if not str(s.getPath().getName()).startswith((".", "_")):
            times.append(s.getModificationTime())
    return (min(times), max(times)) if times else (0, 0)


def dependency(spark: SparkSession, name: str, inputs: Sequence[str], outputs: Sequence[str]) -> dict:
    """Whether every output is as new as the newest input."""
    missing = [p for p in (*inputs, *outputs) if not exists(spark, p)]
    if missing:
        return {"name": name, "fresh": False, "missing": missing}
    newest = max(changed_at(spark, p)[1] for p in inputs)
    oldest = min(changed_at(spark, p)[0] for p in outputs)
    return {"name": name, "fresh": oldest >= newest, "missing": [], "newest_input": newest, "oldest_output": oldest}


def freshness(spark: SparkSession, steps: Sequence[tuple[str, Sequence[str], Sequence[str]]], manifest: dict | None = None) -> dict:
    """The freshness of all steps (name, inputs, outputs): a step is stale where it, or one that makes its inputs, is."""
    found, stale = [], set()
    for name, inputs, outputs in steps:
        one = dependency(spark, name, inputs, outputs)
        behind = sorted(p for p in inputs if p in stale)
        if behind:
            one = one | {"fresh": False, "stale_inputs": behind}
        if not one["fresh"]:
            stale.update(outputs)
        found.append(one)
    fine = all(s["fresh"] for s in found) and (manifest is None or manifest["fresh"])
    return {"fresh": fine, "steps": found, "stale_steps": [s["name"] for s in found if not s["fresh"]], "normalization": manifest}


def blockers(report: dict, readiness: DataFrame) -> list[str]:
    """What keeps training from starting: stale steps and the blockers of tasks that aren't ready."""
    bad = readiness.filter("not ready_for_sft").collect()
    return [f"stale:{n}" for n in report["stale_steps"]] + [f"{r['task']}:{b}" for r in bad for b in (r["blockers"] or ["not_ready"])]


def samples_manifest(spark: SparkSession, path: str, rows: DataFrame) -> dict:
    """Rows, digest, tasks and distinct sources of a file of samples (id, source_group, source_id, task_type, meta)."""
    if not exists(spark, path):
        return {"path": path, "exists": False, "rows": 0, "sha256": ""}
    task = F.coalesce(F.nullif(meta("dataset_task"), F.lit("")), F.col("task_type"), F.lit("unknown"))
    one = samples_profile(rows).first()
    counts = {r["task"]: r["n"] for r in rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        "path": path, "exists": True, "rows": int(one["rows"]), "sha256": folder_digest(spark, path)[1], "task_counts": counts,
        "unique_source_groups": int(one["unique_source_groups"]), "source_group_ratio": one["source_group_ratio"]
    }


def run_manifest(
    spark: SparkSession, stage: str, parameters: dict, datasets: dict[str, tuple[str, DataFrame]], output: str, readiness: dict | None = None
) -> dict:
    """What a run was started with, written beside its output."""
    value = {
        "stage": stage, "parameters": parameters, "parameters_sha256": transform_digest((), parameters),
        "datasets": {n: samples_manifest(spark, p, df) for n, (p, df) in datasets.items()}, "readiness": readiness or {}, "output_dir": output
    }
    write_json(spark, value, f"{output.rstrip('/')}/run_manifest")
    return value


def multitask(spark: SparkSession, tasks: dict[str, DataFrame], sizes: dict[str, int], split: str, seed: str = "42") -> DataFrame:
    """Samples of several tasks (id, source_group, messages, meta): of each as many as asked, one of every source before the
    second of any; those with equal content once, all in hash order."""
    from curatrix.operators.adverts import with_meta
    from curatrix.operators.resumes import once_by_content
    from curatrix.operators.selection import hash_order, round_robin

    parts = []
    for name, rows in tasks.items():
        marked = rows.select(
            "id", "source_group", "messages", F.coalesce("meta", F.lit("{}")).alias("meta")
        ).withColumn("h", hash_order(f"{seed}:{name}:{split}", F.col("id")))
        chosen = round_robin(
            marked.withColumn("g", hash_order(f"{seed}:{name}:{split}:g", F.col("source_group"))), "source_group", ["g", "h", "id"], sizes[name]
        )
        parts.append(
            chosen.select("id", "source_group", "messages", with_meta(F.col("meta"), dataset_task=F.lit(name), dataset_split=F.lit(split)).alias("meta"))
        )
    return once_by_content(reduce(DataFrame.unionByName, parts)).orderBy(hash_order(f"{seed}:shuffle:{split}", F.col("id")))
