"""Mixing sources to target token weights by entropy balancing (native).

Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share all
words of the corpus; a target stops at :data:`MOST` times its source's words and
the excess is shared again by weight. Within a source every document gets the
rate that changes the least, in the sense of a bounded entropy, while the
expected words meet the target: with ``x = (size / mean size) ** TILT`` the rate
is ``MOST * e^(a x) / (MOST - 1 + e^(a x))``, an exponential tilt with the
ceiling MOST that is 1 for ``a = 0``. The multiplier ``a`` of a source is the
minimum of the convex dual, found for all sources at once by guarded Newton
steps; each step is one distributed aggregation over (source, size) cells.

Rates become whole copies by rounding cumulative rates over cells in order of
falling size, so roundings do not add up; then single copies are added or taken
back, large sizes first, where they still fit what is missing. Cells of many
documents are split by a hash of the row into parts of about CELL_ROWS: ranks
within a part see that many rows (more only where a row repeats in id and text),
and cumulative sums within a source see its distinct sizes and one row for each
CELL_ROWS documents. The same input gives the same copies.

Defined results: null and empty texts have size 0, rate 1 and no words taken;
null sources form one source, the last; repeated rows count one by one and hash
alike; an empty table gives no rows; other columns are kept by :func:`remix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm.common import materialize, written
from curatrix.sources.store import remove

#: Most copies of a document, and most times its words that a source gives.
MOST = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: 0 gives all documents of a source one rate, 1 balances plain document entropies.
TILT = 0.5
#: Documents of one cell of equal source and size.
CELL_ROWS = 100_000
STEPS = 40
TOLERANCE = 1e-9
#: Passes that place single copies after the first rounding.
PASSES = 3
#: Rows of the table for each file of what is made of it: writing a file starts processes beside the executor (chmod).
FILE_ROWS = 50_000


def files_of(n: int) -> int:
    """Files at most for what is made of ``n`` rows, whatever the number of shuffle partitions."""
    return n // FILE_ROWS + 1


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the words of the text."""
    return docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"))


def targets(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, mean, target), one row a source. ``cells`` has (source, size, n)."""
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    sums = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    # With the sources in order of cap / weight, the full ones come first; the level is what the others get for a weight of 1.
    # Reckoned as if all before it were full, a later one's level is never above that of the first that isn't.
    by_cap = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(
        W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    sums = sums.withColumn("level", rest / F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
    sums = sums.withColumn("open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    capped = F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double"))
    return sums.select("source", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"), capped.alias("target"))


def rate_of(a: Column, x: Column, most: int) -> Column:
    """The tilted rate, written so that no power overflows."""
    z = a * x
    return F.when(z > 0, most / (1 + (most - 1) * F.exp(-z))).otherwise(most * F.exp(z) / (most - 1 + F.exp(z)))


def balanced(cells: DataFrame, goals: DataFrame, *, tilt: float, most: int, steps: int, tolerance: float, files: int) -> DataFrame:
    """``goals`` with the multiplier ``a`` of each source; null where the source gives all it can. Each step writes ``files`` files at most."""
    x = F.pow(F.col("size") / F.col("mean"), F.lit(tilt))
    used = cells.filter("size > 0")
    ratio = F.col("target") / F.col("source_size")
    full = F.col("target") >= F.col("source_size") * (most * (1 - 1e-12))
    state = goals.withColumns({"full": F.coalesce(full, F.lit(True)), "lo": F.lit(-1e4), "hi": F.lit(1e4)})
    state, folder = written(state.withColumn("a", F.when(F.col("full"), F.lit(0.0)).otherwise(F.log(ratio * (most - 1) / (most - ratio)))), "dual")
    for _ in range(steps):
        at = used.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & ~F.col("s.full"))
        at = at.select(F.col("s.source").alias("source"), "size", "n", "mean", "a").withColumn("x", x).withColumn("r", rate_of(F.col("a"), F.col("x"), most))
        sums = at.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.col("r")).alias("words"),
            F.sum(F.col("n") * F.col("size") * F.col("x") * F.col("r") * (1 - F.col("r") / most)).alias("slope")
        )
        new = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "words", "slope")
        gap = F.col("words") - F.col("target")
        new = new.withColumns(
            {
                "lo": F.when(gap < 0, F.col("a")).otherwise(F.col("lo")), "hi": F.when(gap > 0, F.col("a")).otherwise(F.col("hi")),
                "off": F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0))
            }
        )
        newton = F.try_divide(gap, F.col("slope"))
        step = F.col("a") - newton
        inside = F.coalesce((step > F.col("lo")) & (step < F.col("hi")), F.lit(False))
        new = new.withColumn("a", F.when(F.col("off") <= tolerance, F.col("a")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2))
        old = folder
        state, folder = written(new.select("source", "source_size", "mean", "target", "full", "lo", "hi", "a", "off").coalesce(files), "dual")
        remove(state.sparkSession, old)
        worst = state.agg(F.max("off")).first()[0] or 0.0
        if worst <= tolerance:
            break
    else:
        raise ValueError(f"the dual has not converged in {steps} steps: a source is off its target by a share of {worst}")
    return state.select("source", "source_size", "mean", "target", F.when(~F.col("full"), F.col("a")).alias("a"))


def rounded(cells: DataFrame, duals: DataFrame, *, tilt: float, most: int, passes: int) -> DataFrame:
    """Cells (source, size, part, n) with ``rate`` and the whole number ``k`` of copies over the cell."""
    x = F.pow(F.col("size") / F.col("mean"), F.lit(tilt))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(rate_of(F.col("a"), x, most), F.lit(float(most))))
    out = cells.alias("c").join(
        duals.alias("d"), F.col("c.source").eqNullSafe(F.col("d.source"))
    ).select("c.*", "source_size", "target", "mean", "a").withColumn("rate", rate)
    falling = W.partitionBy("source").orderBy(F.col("size").desc(), "part")
    total = W.partitionBy("source")
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(falling.rowsBetween(W.unboundedPreceding, 0)) + 0.5)
    out = out.withColumn("upto", upto).withColumn("k", F.col("upto") - F.coalesce(F.lag("upto").over(falling), F.lit(0)))
    out = out.withColumn("k", F.greatest(F.lit(0), F.least("k", most * F.col("n"))).cast("long"))
    for _ in range(passes):
        out = out.withColumn("gap", F.col("target") - F.sum(F.col("k") * F.col("size")).over(total))
        free = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & F.when(F.col("gap") > 0, F.col("k") < most * F.col("n")).otherwise(F.col("k") > 0)
        out = out.withColumn("could", F.when(free, F.col("size")).otherwise(0))
        fits = (F.col("could") > 0) & (F.sum("could").over(falling.rowsBetween(W.unboundedPreceding, 0)) <= F.abs("gap"))
        out = out.withColumn("k", F.col("k") + F.when(fits, F.signum("gap").cast("long")).otherwise(0))
    return out.select("source", "size", "part", "n", "source_size", "target", "rate", "k")


def mix(
    docs: DataFrame, *, tilt: float = TILT, most: int = MOST, cell_rows: int = CELL_ROWS, steps: int = STEPS, tolerance: float = TOLERANCE,
    passes: int = PASSES
) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, rate, copies, taken) of every row of ``docs`` (doc_id, source, text)."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = materialize(sized(docs).select("doc_id", key.alias("h"), "source", "size"), "sizes")
    files = files_of(rows.count())
    plain = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).coalesce(files), "cells")
    duals = balanced(plain, targets(plain, most=most), tilt=tilt, most=most, steps=steps, tolerance=tolerance, files=files)
    # Large cells are split; their number of parts follows from n alone.
    parts = plain.select("source", "size", (F.floor(F.col("n") / cell_rows) + 1).alias("parts"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    dealt = rows.alias("r").join(parts.alias("p"), same("r", "p")).select("r.*", F.pmod(F.col("h"), F.col("parts")).alias("part"))
    cells = rounded(dealt.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), duals, tilt=tilt, most=most, passes=passes)
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("h", "doc_id")) - 1
    ranked = dealt.withColumn("rank", rank)
    out = ranked.alias("r").join(
        cells.alias("c"), same("r", "c") & (F.col("r.part") == F.col("c.part"))
    ).select("r.*", "n", "source_size", "target", "rate", "k")
    copies = (F.floor(F.col("k") / F.col("n")) + F.when(F.col("rank") < F.col("k") % F.col("n"), 1).otherwise(0)).cast("long")
    return out.withColumn("copies", copies).select(
        "doc_id", "h", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def remix(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``; rows without words stay once.

    Rows that repeat id, source and text share what the mix takes of them all, as evenly as whole copies allow.
    """
    names = docs.columns
    taken = mix(docs.select("doc_id", "source", "text"), **params).groupBy("doc_id", "source", "h").agg(
        F.sum("copies").alias("all"), F.count(F.lit(1)).alias("m")
    )
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "source")
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.h") == F.col("t.h"))
    joined = rows.alias("r").join(taken.alias("t"), same).select("r.*", "all", "m")
    once = joined.filter("m = 1").select("row", F.col("all").alias("copies"))
    rank = F.row_number().over(W.partitionBy("doc_id", "source", "h").orderBy(F.xxhash64("row")))
    repeated = joined.filter("m > 1").withColumn("rank", rank)
    repeated = repeated.select("row", (F.floor(F.col("all") / F.col("m")) + F.when(F.col("rank") <= F.col("all") % F.col("m"), 1).otherwise(0)).alias("copies"))
    both = once.unionByName(repeated).filter("copies > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
