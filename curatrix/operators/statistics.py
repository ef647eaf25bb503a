"""Exact percentiles of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells into which a group's values are dealt by approximate quantiles, and the accuracy of these.
CELLS, ACCURACY = 256, 4096


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], cells: int = CELLS) -> DataFrame:
    """(group, n, one column a share): the least value up to which that share of the group's values lies.

    Values are dealt to cells between approximate quantiles, so a group of any size is spread. Counts by cell tell which
    cell holds a rank, and only its distinct values are put in order; the result is exact whatever the quantiles.
    """
    rows = df.select(group, F.col(value).alias("v")).filter("v is not null")
    edges = rows.groupBy(group).agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], ACCURACY).alias("edges"))
    # The number of edges below a value is its cell; equal values share one.
    cell = F.aggregate("edges", F.lit(0), lambda a, e: a + (e < F.col("v")).cast("int"))
    counts = rows.groupBy(group, "v").agg(F.count(F.lit(1)).alias("c")).join(edges, group).select(group, "v", "c", cell.alias("cell"))
    sizes = counts.groupBy(group, "cell").agg(F.sum("c").alias("c"))
    by_cell = W.partitionBy(group).orderBy("cell")
    sizes = sizes.select(
        group, "cell", (F.sum("c").over(by_cell) - F.col("c")).alias("before"), F.sum("c").over(W.partitionBy(group)).alias("n"),
        F.col("c").alias("held")
    )
    wanted = F.array(
        *(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p) - F.lit(1e-9))).alias("k")) for name, p in shares.items())
    )
    asked = sizes.select("*", F.inline(wanted)).filter((F.col("k") > F.col("before")) & (F.col("k") <= F.col("before") + F.col("held")))
    inside = counts.join(asked.select(group, "cell").distinct(), [group, "cell"]).withColumn("upto", F.sum("c").over(W.partitionBy(group, "cell").orderBy("v")))
    found = asked.join(inside, [group, "cell"]).filter(F.col("before") + F.col("upto") >= F.col("k")).groupBy(group, "n", "name").agg(F.min("v").alias("v"))
    return found.groupBy(group, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
