"""Exact and near duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.sources.folders import shared_copy

#: Texts by which a side of a cell of comparisons is cut.
CELL_TEXTS = 500


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; an aggregate, so equal keys meet pre-aggregated and none is a hot task."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


def surplus(df: DataFrame, key: str) -> DataFrame:
    """How many rows are more than one of their key."""
    return df.groupBy(key).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("surplus_rows"), F.count_if(F.col("count") > 1).alias("duplicated_keys")
    )


def shingles(text: str, size: int) -> set[str]:
    if not text:
        return set()
    return {text} if len(text) <= size else {text[i : i + size] for i in range(len(text) - size + 1)}


def shingle_counts(df: DataFrame, text: Column, id_col: str, size: int = 5) -> DataFrame:
    """Number of distinct shingles by row."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(shingles(t, size)))

    return df.select(id_col, count(text).alias("n_shingles"))


def shingle_numbers(text: str, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = max(1, len(points) - size + 1)
    mixed = np.full(n, min(len(points), size), dtype=np.uint64)
    for k in range(min(len(points), size)):
        mixed = (mixed + points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def part_keys(own: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of the set ``own``, sorted, of which two sets with at least ``threshold`` in common share one.

    Sizes fall into classes, each 1 / threshold times the one below, so sizes of such sets are of one class or of two in a
    row. Each set is cut by its hashes into one part more than the most hashes that a set of a class may differ in from one of
    its class or the next; so one part is the same in both. It is cut for its own class and for the one below.
    """
    step = 1 / min(threshold, 0.999)
    bounds = [1.0]
    while bounds[-1] <= len(own):
        bounds.append(bounds[-1] * step)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((own ^ (own >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))))
    keys = []
    for c in range(max(0, len(bounds) - 3), len(bounds) - 1):
        parts = int((step - 1) / (step + 1) * bounds[c] * step * (1 + step) + 1e-6) + 1
        at = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        ends = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
        key = sums[ends[1:]] - sums[ends[:-1]] + np.arange(parts, dtype=np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64(c + 1) * np.uint64(0xD6E8FEB8)
        keys.append((key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(keys)


def jaccard_pairs(df: DataFrame, id_col: str, bucket: str, text: str, threshold: float = 0.9, size: int = 5) -> DataFrame:
    """Pairs of distinct normalised texts in a bucket whose shingle sets have at least ``threshold`` in common.

    Texts count once, by their least id. Sets of shingles are never written: a set goes under hashes of its parts
    (:func:`part_keys`), which few others share, and the texts that share one are read again and compared on their whole sets.
    Texts to compare are dealt to cells, and one goes to a cell once, however many partners it has there.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(bucket).cast("string").alias("b"), F.col(text).alias("t")).filter("b is not null and t <> ''")
    rows = rows.select("id", "b", "t", F.xxhash64("b", "t").alias("node"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch, keys, sizes = whole.slice(k, 200), [], []
                for t in batch.column("t").to_pylist():
                    own = shingle_numbers(t, size)
                    keys.append(part_keys(own, threshold))
                    sizes.append(len(own))
                many = [len(x) for x in keys]
                columns = [np.concatenate(keys).view(np.int64), np.repeat(batch.column("node").to_numpy(), many), np.repeat(np.array(sizes, dtype=np.int32), many)]
                columns = [*map(pa.array, columns), batch.column("b").take(pa.array(np.repeat(np.arange(batch.num_rows), many)))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n", "b"])

    once = rows.groupBy("b", "t").agg(F.first("node").alias("node"))
    dealt = once.mapInArrow(keyed, "key long, node long, n int, b string").select(F.xxhash64("key", "b").alias("key"), "node", "n")
    a, c = dealt.alias("a"), dealt.alias("c")
    alike = (F.col("a.key") == F.col("c.key")) & (F.col("a.node") < F.col("c.node")) & (F.col("c.n") >= threshold * F.col("a.n") - 1e-6) & (F.col("a.n") >= threshold * F.col("c.n") - 1e-6)
    pairs = shared_copy(a.join(c, alike).select(F.col("a.node").alias("x"), F.col("c.node").alias("y")).distinct(), "pairs")
    wanted = shared_copy(pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct(), "wanted")
    texts = shared_copy(rows.join(wanted, "node").groupBy("node", "b", "t").agg(F.min("id").alias("id")).select("node", "id", "t"), "texts")
    cells = F.lit(max(1, -(-wanted.count() // CELL_TEXTS)))
    placed = pairs.select("x", "y", F.pmod(F.hash("x"), cells).alias("i"), F.pmod(F.hash("y"), cells).alias("j"))
    needed = placed.select("i", "j", F.col("x").alias("node")).unionByName(placed.select("i", "j", F.col("y").alias("node"))).distinct().join(texts, "node")
    needed = needed.select(F.col("i").alias("k"), F.col("j").alias("l"), "node", "id", "t")  # else the two sides' columns can't be told apart

    def compared(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        sets = {node: shingle_numbers(t, size) for node, t in zip(own["node"], own["t"], strict=True)}
        ids = {node: None if pd.isna(i) else int(i) for node, i in zip(own["node"], own["id"], strict=True)}
        out = []
        for x, y in zip(found["x"], found["y"], strict=True):
            if ids[x] is None or ids[y] is None or ids[x] == ids[y]:
                continue
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            score = shared / (len(sets[x]) + len(sets[y]) - shared)
            if score >= threshold:
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y]), score))
        return pd.DataFrame(out, columns=["left_id", "right_id", "jaccard"])

    both = placed.groupBy("i", "j").cogroup(needed.groupBy("k", "l"))
    return both.applyInPandas(compared, "left_id long, right_id long, jaccard double")


def greedy(df: DataFrame, bucket: str, order: str, text: str, threshold: float = 0.9, size: int = 5) -> DataFrame:
    """Rows kept when compared, in order, with the rows kept before in their bucket.

    The order decides what is kept, so a bucket is one task; buckets are titles, companies and places or beginnings of
    texts, not sources. Equal texts should be dropped before.
    """
    names = df.columns

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        pdf = pdf.sort_values(order, kind="stable")
        kept, seen, rows = [], set(), []
        for i, t in enumerate(pdf[text]):
            if t in seen:
                continue
            mine = shingles(t, size)
            for other, theirs in kept:
                union = len(mine | theirs)
                if union and len(mine & theirs) / union >= threshold:
                    break
                matcher = SequenceMatcher(None, t, other)
                if matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold:
                    break
            else:
                kept.append((t, mine))
                seen.add(t)
                rows.append(i)
        return pdf.iloc[rows][names]

    return df.groupBy(bucket).applyInPandas(keep, df.schema)


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key: a keyed upsert."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")
