"""Quality rules: repetition limits and a hashed n-gram log-likelihood ratio (native).

Two multinomials over hashed 1- and 2-grams are estimated, one from trusted
documents (labelled good and not toxic), one from the whole raw corpus. The
score of a document is the mean over its n-grams of
``log p_trusted(bucket) - log p_raw(bucket)``; documents below a fixed
threshold are rejected, and so are those that fail the base rules. Both counts
of a bucket get a prior of the same odds, so a bucket that was hardly seen says
hardly anything and the threshold means the same for small and large corpora.

Defined results: null and empty texts have no words, fail the base rule and get
score 0; without trusted documents every score is 0; repeated rows are judged
one by one; columns of the input other than ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import words

#: Hash buckets of the two multinomials; the model is one array of this length.
BUCKETS = 1 << 16
#: Most labelled documents that stand for the trusted target.
TRUSTED_ROWS = 20_000
#: Documents with a mean log ratio (nats per n-gram) below this are rejected.
MIN_SCORE = -0.2
#: Raw n-grams added to every bucket, of which the trusted side gets its overall share.
PRIOR = 10.0
WINDOW = 5


def hashes(ws: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def pairs(h: Column) -> Column:
    """A 64-bit hash of each two neighbours of ``h``."""
    return F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h), F.lit(1))), lambda x, i: F.xxhash64(F.get(h, i), x))


def trusted_ids(labels: DataFrame, rows: int) -> DataFrame:
    """Ids of documents that all their labels call good and not toxic; at most ``rows``, chosen by a hash of the id."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.filter("q = 1 and t = 0 and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.lit(1).alias("trusted"))


def weights(docs: DataFrame, labels: DataFrame, buckets: int, rows: int, prior: float) -> DataFrame:
    """One row with the array of log ratios by bucket. Counts cover all documents."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels, rows)), "doc_id", "left")
    found = flagged.select("trusted", hashes(words(F.col("text"))).alias("h")).select("trusted", F.explode(F.concat("h", pairs(F.col("h")))).alias("gram"))
    found = found.select("trusted", F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket"))
    counts = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    cells = every.join(counts, "bucket", "left").na.fill(0, ["raw", "good"])
    whole = cells.agg(
        F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("cells")
    )
    share = F.col("all_good") / F.col("all_raw")
    ratio = lambda c: F.log((c["good"] + prior * share) / ((c["raw"] + prior) * share))
    return whole.select(F.transform("cells", lambda c: F.when(F.col("all_good") > 0, ratio(c)).otherwise(0.0)).alias("w"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the word hashes ``h``, the pair hashes ``h2`` and the base counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("ws", words(F.col("text"))).withColumn("lines", lines)
    out = out.withColumns({
        "word_chars": F.length(F.array_join("ws", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "h": hashes(F.col("ws")),
    }).drop("ws", "lines")
    out = out.withColumn("n_words", F.size("h").cast("long")).withColumn("h2", pairs(F.col("h")))
    # Five words are two pairs and the last word.
    out = out.withColumn(
        "runs",
        F.transform(
            F.slice("h", F.lit(WINDOW), F.greatest(F.size("h"), F.lit(1))), lambda x,
            i: F.xxhash64(F.get(F.col("h2"), i), F.get(F.col("h2"), i + 2), x)
        )
    )
    out = out.withColumn(
        "by_hash",
        F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    same = lambda x, i: F.coalesce(
        F.get(F.col("by_hash"), i - 1)["h"] == x["h"], F.lit(False)
    ) | F.coalesce(F.get(F.col("by_hash"), i + 1)["h"] == x["h"], F.lit(False))
    out = out.withColumn("at", F.sort_array(F.transform(F.filter("by_hash", same), lambda x: x["i"])))
    cover = F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - x, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return out.withColumn("n_repeat_words", repeated).drop("runs", "by_hash", "at")


#: The columns that :func:`quality` adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def quality(
    docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, min_score: float = MIN_SCORE,
    prior: float = PRIOR
) -> DataFrame:
    """The columns of ``docs``, which needs ``doc_id`` and ``text``, with those of :data:`ADDED`, which replace columns of the
    same names."""
    names = [c for c in docs.columns if c not in ADDED]
    inner = _judged(docs.select("doc_id", "text", F.struct(*names).alias("row")), labels, buckets, trusted_rows, min_score, prior)
    return inner.select("row.*", *ADDED)


def _judged(docs: DataFrame, labels: DataFrame, buckets: int, trusted_rows: int, min_score: float, prior: float) -> DataFrame:
    """``docs`` (doc_id, text, row) with the columns of :data:`ADDED`."""
    model = weights(docs, labels, buckets, trusted_rows, prior)
    # h, h2 and w have one reference each below, so the optimizer keeps the weights out of the rows.
    out = measured(docs).withColumn("w", model.scalar())
    summed = lambda h: F.aggregate(h, F.lit(0.0), lambda a, g: a + F.get(F.col("w"), F.pmod(g, F.lit(buckets)).cast("int")))
    total = summed(F.concat("h", "h2"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score)).drop("h", "h2", "w")


def keep_good(
    docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, min_score: float = MIN_SCORE,
    prior: float = PRIOR
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    inner = _judged(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), labels, buckets, trusted_rows, min_score, prior)
    # The optimizer moves no filter below a column that isn't deterministic; moved, it would repeat every count.
    return inner.withColumn("fixed", F.monotonically_increasing_id()).filter("kept and fixed >= 0").select("row.*")
