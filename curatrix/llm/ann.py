"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Equal vectors are one entry, which keeps the smallest of their ids that any
result can need. Coarse centroids, about the square root of the rows in number
up to :data:`MOST_CELLS`, and the residuals' codebooks are fitted on a bounded
sample of SAMPLE_PER_CELL vectors a cell, chosen by a hash of the id; every entry
is then indexed under its nearest centroid as :data:`SUBSPACES` bytes. On a part
of the sample the true neighbours are known: a query visits as many of its
nearest cells as hold :data:`REACH` of them there, so clustered vectors need few
and shapeless ones many.

A query ranks the rows of its cells by asymmetric distance tables; only codes
travel to it, and only its best :data:`RERANK` of all cells are joined with the
original vectors and measured again in double precision. Large cells and many
queries of a cell are dealt out in blocks of bounded size. What leaves a block
are the query's best within the distance that, by the sample, holds
:data:`WITHIN` times RERANK rows, so it does not grow with the cells visited. A
query that finds fewer rows than asked for visits all cells, at any distance.

Defined results: vectors that are null, zero, hold null or non-finite
components, or aren't of the commonest length take no part, nor do rows without
an id; of rows with one vec_id the least vector counts; ties go to the smaller
vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

#: Bounds of the number of cells and of the sample, which holds at most their product in rows.
MOST_CELLS = 2048
SAMPLE_PER_CELL = 64
LEAST_SAMPLE = 20_000
#: Share of the true neighbours of sampled queries that the visited cells must hold, and the number of these queries.
REACH = 0.95
TRIALS = 500
SUBSPACES = 16
CODES = 256
RERANK = 300
#: Rows, by the sample, within the distance that a query looks to, as a multiple of RERANK.
WITHIN = 2
#: Rows and queries of a cell that meet in one block.
BLOCK_ROWS = 16384
BLOCK_QUERIES = 1024
ROUNDS = 12


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of double."""
    v = F.col(embedding).cast("array<double>")
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds; empty ones move to rows far from theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=k)
        by_cell = np.argsort(at, kind="stable")
        sums = np.zeros_like(c)
        sums[n > 0] = np.add.reduceat(x[by_cell], (np.cumsum(n) - n)[n > 0], axis=0)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            far = (d[np.arange(len(x)), at] + (x * x).sum(1)).argsort()[::-1]
            c[n == 0] = x[far[: int((n == 0).sum())]]
    return c


class Index:
    """Coarse centroids, codebooks, and the number of cells that a query visits."""

    def __init__(
        self, sample: np.ndarray, cells: int, subspaces: int = SUBSPACES, codes: int = CODES, rounds: int = ROUNDS, seed: int = 7,
        reach: float = REACH, k: int = 10
    ):
        x = sample.astype(np.float64)
        self.coarse = kmeans(x, max(1, min(cells, len(x) // 8)), rounds, seed)
        rest = x - self.coarse[self.nearest(x, 1)[:, 0]]
        edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        self.parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.books = [kmeans(rest[:, a:b], min(codes, len(x)), rounds, seed + i) for i, (a, b) in enumerate(self.parts)]
        self.probes = self.needed(x, reach, k)
        home = self.nearest(x, 1)[:, 0]
        codes = self.codes(x, home)
        coded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        self.error = float((((x - self.coarse[home]) - coded) ** 2).sum(1).mean())
        self.sample = x.astype(np.float32)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.coarse * self.coarse).sum(1)[None, :] - 2 * x @ self.coarse.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def needed(self, x: np.ndarray, reach: float, k: int) -> int:
        """The cells to visit that hold a share ``reach`` of the ``k`` true neighbours of rows of ``x`` among all of it."""
        if len(x) < 2:
            return 1
        home, places = self.nearest(x, 1)[:, 0], []
        for q in range(0, min(len(x), TRIALS), 50):
            own = x[q : min(q + 50, TRIALS)]
            d = (x * x).sum(1)[None, :] - 2 * own @ x.T
            d[np.arange(len(own)), np.arange(q, q + len(own))] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
            order = self.nearest(own, len(self.coarse))
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
            places.append(np.take_along_axis(place, home[near], axis=1).ravel())
        every = np.sort(np.concatenate(places))
        return int(every[min(len(every) - 1, int(np.ceil(reach * len(every))) - 1)]) + 1

    def cutoff(self, q: np.ndarray, share: float) -> np.ndarray:
        """The squared distance, with the mean error of codes, within which a share of the sample lies, of each query."""
        x = self.sample
        m = min(len(x) - 1, max(3, int(np.ceil(share * len(x)))))
        out = [np.partition((x * x).sum(1) - 2 * (x @ row.astype(np.float32)), m)[m] + (row * row).sum() for row in q]
        return np.array(out) + self.error

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[cell]
        return np.stack(
            [((k * k).sum(1)[None, :] - 2 * rest[:, a:b] @ k.T).argmin(1) for (a, b), k in zip(self.parts, self.books, strict=True)], axis=1
        ).astype(np.uint8)

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of one query to coded rows of a cell, by tables."""
        rest = q - self.coarse[cell]
        total = np.zeros(len(codes))
        for i, ((a, b), k) in enumerate(zip(self.parts, self.books, strict=True)):
            total += ((rest[a:b] - k) ** 2).sum(1)[codes[:, i]]
        return total


def fit(vectors: DataFrame, rows: int, *, most_cells: int = MOST_CELLS, **params) -> Index | None:
    """An index fitted on a bounded sample of ``rows`` distinct vectors, or None without any."""
    cells = max(1, min(most_cells, round(rows**0.5)))
    found = vectors.orderBy(F.xxhash64("entry"), "entry").limit(max(LEAST_SAMPLE, SAMPLE_PER_CELL * cells)).select("v").collect()
    return Index(np.array([r["v"] for r in found]), cells, **params) if found else None


def _visit(index_rows: DataFrame, entries: DataFrame, queries: DataFrame, shared, probes: int, rerank: int, k: int, share: float | None) -> DataFrame:
    """(query_id, vec_id, score, rank) of the best ``k`` of each query (vec_id, v), within the distance of a share of rows."""

    def probe(frames):
        for pdf in frames:
            if len(pdf):
                q = np.array(pdf["v"].tolist())
                near = shared.value.nearest(q, probes)
                cut = np.full(len(q), np.inf) if share is None else shared.value.cutoff(q, share)
                yield pd.DataFrame(
                    {
                        "cell": near.ravel(), "query_id": np.repeat(pdf["vec_id"].to_numpy(), near.shape[1]), "cut": np.repeat(cut, near.shape[1]),
                        "q": [v for v in q.astype(np.float32) for _ in range(near.shape[1])]
                    }
                )

    asked = queries.mapInPandas(probe, "cell int, query_id long, cut double, q array<float>")
    # Block numbers of both sides; the counts have one row a cell.
    blocks = index_rows.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).cast("int").alias("row_blocks"))
    rounds = asked.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / BLOCK_QUERIES) + 1).cast("int").alias("query_blocks"))
    sizes = materialize(blocks.join(rounds, "cell"), "cells")
    left = index_rows.join(F.broadcast(sizes), "cell").withColumn("row_block", F.pmod(F.xxhash64("entry"), "row_blocks").cast("int")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))
    )
    right = asked.join(F.broadcast(sizes), "cell").withColumn(
        "query_block", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int")
    ).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))

    def rank(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        who, what, near = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(rows) and len(asking):
            ids = rows["entry"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(ids), -1)[order]
            cell = int(rows["cell"].iloc[0])
            for query_id, q, cut in zip(asking["query_id"], asking["q"], asking["cut"], strict=True):
                d = shared.value.distances(np.asarray(q, dtype=np.float64), cell, codes)
                best = np.flatnonzero(d <= cut)
                best = best[np.argsort(d[best], kind="stable")[:rerank]]
                who.append(np.full(len(best), query_id))
                what.append(ids[best])
                near.append(d[best])
        return pd.DataFrame({"query_id": np.concatenate(who), "entry": np.concatenate(what), "near": np.concatenate(near)})

    keys = ["cell", "row_block", "query_block"]
    found = left.select(*keys, "entry", "codes").groupBy(*keys).cogroup(
        right.select(*keys, "query_id", "cut", "q").groupBy(*keys)
    ).applyInPandas(rank, "query_id long, entry long, near double")
    first = found.withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy("near", "entry"))).filter(F.col("rn") <= rerank)
    measured = first.select("query_id", "entry").join(entries, "entry").join(
        queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id"
    )
    gaps = F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    each = measured.select("query_id", F.explode("ids").alias("vec_id"), F.sqrt(gaps).alias("score")).filter("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)


def search(
    rows: DataFrame, queries: Column, *, k: int = 10, probes: int | None = None, rerank: int = RERANK, subspaces: int = SUBSPACES,
    most_cells: int = MOST_CELLS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of all other rows, for the rows where ``queries`` (on vec_id) holds."""
    spark = rows.sparkSession
    vectors = materialize(usable(rows), "vectors")
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], empty)
    vectors = vectors.filter(F.size("v") == lengths[0]["n"])
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest of any query but themselves.
    ids = vectors.withColumn("rn", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("rn") <= k + 1)
    entries = materialize(
        ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "ids", "v"), "entries"
    )
    size = entries.count()
    shared = spark.sparkContext.broadcast(fit(entries, size, subspaces=subspaces, most_cells=most_cells, k=k))

    def code(frames):
        for pdf in frames:
            if len(pdf):
                x = np.array(pdf["v"].tolist())
                cell = shared.value.nearest(x, 1)[:, 0]
                yield pd.DataFrame({"cell": cell, "entry": pdf["entry"], "codes": [c.tobytes() for c in shared.value.codes(x, cell)]})

    index_rows = materialize(entries.select("entry", "v").mapInPandas(code, "cell int, entry long, codes binary"), "index")
    asked = materialize(vectors.filter(queries), "asked")
    found = materialize(_visit(index_rows, entries, asked, shared, probes or shared.value.probes, max(rerank, k), k, WITHIN * max(rerank, k) / size), "found")
    others = vectors.count() - 1
    full = found.groupBy("query_id").count().filter(F.col("count") >= min(k, others)).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if others and not short.isEmpty():
        again = _visit(index_rows, entries, short, shared, len(shared.value.coarse), max(rerank, k), k, None)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
