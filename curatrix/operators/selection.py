"""Tiers, quotas, samples and splits. Seeded shuffles are orders by a salted hash, which any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.sources.folders import shared_folder


def hash_order(seed: str, key: Column) -> Column:
    """A repeatable random order of keys."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def quota(df: DataFrame, family: str, n: int, order: list) -> DataFrame:
    """The first ``n`` rows of each family."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(family).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with its rank from 0 in the given order.

    The rows are written in order, and a row's rank is its place in its file and the rows of the files before, so no task
    sees more than its share; what is summed over are the files.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "ranked")
    df.orderBy(*order).write.parquet(folder)
    back = spark.read.schema(df.schema).parquet(folder).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = back.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_file", (F.sum("_n").over(W.orderBy("_file")) - F.col("_n")).alias("_before"))
    return back.join(before, "_file").withColumn(name, F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def rate_cap(df: DataFrame, in_family: Column, rate: float, order: list) -> DataFrame:
    """All rows outside the family, and as many first ones of it as make at most ``rate`` of the result."""
    marked = df.withColumn("fam", F.coalesce(in_family, F.lit(False)))
    limit = marked.filter(~F.col("fam")).agg(F.floor(F.count(F.lit(1)) * (rate / (1 - rate))).alias("most"))
    kept = ranked(marked.filter("fam"), order).withColumn("most", limit.scalar()).filter(F.col("rank") < F.col("most"))
    return marked.filter(~F.col("fam")).select(*df.columns).unionByName(kept.select(*df.columns))


def sample(df: DataFrame, n: int | None, seed: str, key: str) -> DataFrame:
    """``n`` rows by a hash of the key; all where n is None."""
    return df if n is None else df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def round_robin(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """``n`` rows, one of every group before the second of any."""
    ranked = df.withColumn("depth", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.orderBy("depth", *order).limit(n)


def partners(df: DataFrame, key: str, group: str, seed: str, same: int, other: int) -> DataFrame:
    """(left, right, kind): each row with the next ``same`` of its group (positive) and the next ``other`` of other groups
    (negative), in hash order and round the end; both sides are structs of the columns of ``df``.

    Rows are numbered by group and hash, and partners are found by number, so every row is met about as often and no group
    is a task of its own.
    """
    placed = ranked(
        df.select(F.struct(*df.columns).alias("row"), F.col(group).alias("g"), hash_order(seed, F.col(key)).alias("h"), F.col(key).alias("k")),
        ["g", "h", "k"], "place"
    ).select("row", "g", "place")
    sizes = placed.groupBy("g").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))
    total = placed.agg(F.count(F.lit(1)).alias("n"))
    asked = placed.join(sizes, "g").withColumn("rest", total.scalar() - F.col("n"))
    at, numbers = F.col("place") - F.col("begin"), lambda n, most: F.filter(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda i: (i <= most) & F.lit(n > 0))
    own = F.transform(numbers(same, F.col("n") - 1), lambda i: F.struct(F.lit("positive").alias("kind"), (F.col("begin") + (at + i) % F.col("n")).alias("to")))
    beyond = lambda x: F.when(x < F.col("begin"), x).otherwise(x + F.col("n"))
    others = F.transform(numbers(other, F.col("rest")), lambda i: F.struct(F.lit("negative").alias("kind"), beyond((at + i - 1) % F.col("rest")).alias("to")))
    pairs = asked.select(F.col("row").alias("left"), F.inline(F.concat(own, others)))
    return pairs.join(placed.select(F.col("place").alias("to"), F.col("row").alias("right")), "to").select("left", "right", "kind")


def split_sizes(df: DataFrame, key: str, seed: str, train: float, valid: float) -> DataFrame:
    """``df`` with ``split``: shares of the whole by rank in hash order, at least one row each.

    Ranks come from counts by hash prefix, so no task sees all rows.
    """
    marked = df.withColumn("h", hash_order(seed, F.col(key))).withColumn("cell", F.substring("h", 1, 3))
    sizes = marked.groupBy("cell").count()
    before = sizes.select("cell", (F.sum("count").over(W.orderBy("cell")) - F.col("count")).alias("before"))
    ranked = marked.join(before, "cell").withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy("h", key)) + F.col("before") - 1)
    n = marked.agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.withColumn("n", n.scalar())
    n_valid = F.greatest(F.lit(1), (F.col("n") * valid).cast("long"))
    n_test = F.greatest(F.lit(1), F.col("n") - (F.col("n") * train).cast("long") - n_valid)
    n_train = F.greatest(F.lit(1), F.col("n") - n_valid - n_test)
    named = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_valid, "valid").otherwise("test")
    return ranked.withColumn("split", named).select(*df.columns, "split")


def split_samples(df: DataFrame, key: str, seed: str, train: float, valid: float) -> DataFrame:
    """As :func:`split_sizes`; fewer than three rows are all train, and the first of them is valid and test too."""
    few = df.select(key).limit(3).count()
    if few >= 3:
        return split_sizes(df, key, seed, train, valid)
    every = df.withColumn("split", F.lit("train"))
    first = df.orderBy(hash_order(seed, F.col(key)), key).limit(1)
    return every.unionByName(first.withColumn("split", F.lit("valid"))).unionByName(first.withColumn("split", F.lit("test")))


def split_two(df: DataFrame, key: str, seed: str, valid: float) -> DataFrame:
    """``df`` with ``split`` train or valid, one row of each at least; fewer than two rows are both."""
    if df.select(key).limit(2).count() < 2:
        return df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("valid")))
    n = df.count()
    n_valid = max(1, int(n * valid))
    n_train = max(1, n - n_valid)
    rank = ranked(df.withColumn("_h", hash_order(seed, F.col(key))), ["_h", key])
    return rank.withColumn("split", F.when(F.col("rank") < n_train, "train").otherwise("valid")).drop("rank", "_h")


def _prefixed(name: str):
    return lambda k: F.concat(F.lit(f"{name}:"), k.cast("string"))


def split_linked(df: DataFrame, links: list[str], seed: str, train: float, valid: float, checkpoint) -> DataFrame:
    """``df`` (id and array columns of keys ``links``) with ``split``: rows that share a key, directly or through others, stay
    together, and the sizes of :func:`split_samples` hold for such groups."""
    keyed = [df.select("id", F.explode(F.array_distinct(F.transform(F.col(c), _prefixed(c)))).alias("k")) for c in links]
    keys = keyed[0]
    for more in keyed[1:]:
        keys = keys.unionByName(more)
    least = keys.groupBy("k").agg(F.min("id").alias("a"))
    roots = components(keys.join(least, "k").select("a", F.col("id").alias("b")), checkpoint)
    named = df.select("id").distinct().join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    groups = split_samples(named.select("root").distinct(), "root", seed, train, valid)
    return df.join(named, "id").join(groups, "root").drop("root")


def preassigned(df: DataFrame, split: Column, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """``df`` with ``split`` as assigned; raises where a row has none."""
    out = df.withColumn("split", split)
    bad = out.filter(~F.coalesce(F.col("split").isin(*splits), F.lit(False))).limit(3).collect()
    if bad:
        raise ValueError(f"rows without a split: {bad}")
    return out


def review(df: DataFrame, tier: str, n: int, seed: str, strategy: str = "balanced") -> DataFrame:
    """``n`` rows (id, quality_score, quality_risk_score) of each tier: by a hash, or those of the lowest scores."""
    if strategy not in ("balanced", "lowest-score"):
        raise ValueError(f"unknown strategy {strategy}")
    order = [hash_order(seed, F.col("id")), "id"] if strategy == "balanced" else [
        F.coalesce("quality_score", F.lit(0)), -F.coalesce("quality_risk_score", F.lit(0)), "id"
    ]
    return quota(df, tier, n, order)


def components(edges: DataFrame, checkpoint) -> DataFrame:
    """(node, root) by rounds of least labels over edges (a, b); ``checkpoint`` writes and rereads a frame."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        nearest = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(nearest, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        new = checkpoint(low.join(jump, "low", "left").select("node", "root", F.least("low", F.coalesce("jump", "low")).alias("new")))
        if new.filter("new <> root").isEmpty():
            return new.select("node", F.col("new").alias("root"))
        labels = new.select("node", F.col("new").alias("root"))


def isolated(df: DataFrame, group: str, split: str, priority: list[str]) -> DataFrame:
    """Rows whose group isn't kept in a split of higher priority."""
    rank = F.lit(len(priority))
    for i, s in reversed(list(enumerate(priority))):
        rank = F.when(F.col(split) == s, i).otherwise(rank)
    marked = df.withColumn("r", rank).filter(F.col("r") < len(priority))
    first = marked.groupBy(group).agg(F.min("r").alias("first"))
    return marked.join(first, group).filter(F.col("r") == F.col("first")).select(*df.columns)
