"""Sentences with marked spans, in two written forms, isolated splits of them, and their audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.text import text_or_empty
from curatrix.operators.pairing import squeezed
from curatrix.operators.sections import tagged_spans

#: The markup of spans, its labels with their names, and the share of bad rows that a source may have.
MARKUP, MARKS = r"(?d)@@(.*?)##([LKST])", "@@|##"
LABELS = {"L": "语言能力", "K": "知识技能", "S": "专业技能", "T": "通用能力"}
MOST_INVALID = 0.02
PRIORITY = ("test", "dev", "train")


def marked_spans(text: Column, tagged: Column) -> Column:
    """The spans (start, end, label, text) of a marked-up sentence; null where the markup is malformed, a span is empty or
    the sentence without markup isn't the text."""
    tagged = text_or_empty(tagged)
    parts = F.struct(
        F.regexp_extract_all(tagged, F.lit(MARKUP), F.lit(1)).alias("s"), F.regexp_extract_all(tagged, F.lit(MARKUP), F.lit(2)).alias("l"),
        F.split(tagged, MARKUP, -1).alias("g"), text_or_empty(text).alias("t")
    )

    def of(p: Column) -> Column:
        lengths = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
        spans = F.transform(
            p["s"], lambda s,
            i: F.struct(
                (lengths(p["g"], i + 1) + lengths(p["s"], i)).alias("start"), (lengths(p["g"], i + 1) + lengths(p["s"], i + 1)).alias("end"),
                F.get(p["l"], i).alias("label"), s.alias("text")
            )
        )
        plain = F.concat(F.array_join(F.zip_with(F.slice(p["g"], F.lit(1), F.size(p["s"])), p["s"], lambda g, s: F.concat(g, s)), ""), F.element_at(p["g"], -1))
        good = ~F.exists(p["g"], lambda g: g.rlike(MARKS)) & ~F.exists(p["s"], lambda s: s == "") & (plain == p["t"]) & (p["t"] != "")
        return F.when(good, spans)

    return F.get(F.transform(F.array(parts), of), 0)


def by_label(spans: Column, names: dict[str, str], distinct: bool = True) -> Column:
    """A struct of the texts of each label, and of all."""
    of = lambda label: F.transform(F.filter(spans, lambda s: s["label"] == label), lambda s: s["text"])
    lists = {name: F.array_distinct(of(label)) if distinct else of(label) for label, name in names.items()}
    every = F.concat(*lists.values()) if distinct else F.transform(spans, lambda s: s["text"])
    return F.struct(*(c.alias(n) for n, c in lists.items()), every.alias("全部技能"))


def marked_rows(rows: DataFrame, dataset: str, split: str, source: dict) -> DataFrame:
    """Rows (pos, input, output, meta as JSON) as (id, task, source_group, text, spans, label, meta, error); rows that can't
    be read have null spans and an error."""
    told = lambda *keys: F.coalesce(*(F.nullif(F.get_json_object("meta", f"$.{k}"), F.lit("")) for k in keys))
    ident = F.coalesce(told("id"), F.col("pos").cast("string"))
    job = F.coalesce(told("job_id", "global_id"), ident)
    spans = marked_spans(F.col("input"), F.col("output"))
    empty = (text_or_empty(F.col("input")) == "") | (text_or_empty(F.col("output")) == "")
    kept = {
        "language": source.get("language"), "annotation": source.get("annotation"), "license_status": source.get("license_status"),
        "intended_usage": source.get("intended_usage")
    }
    meta = F.to_json(
        F.struct(
            F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), *(F.lit(v).cast("string").alias(k) for k, v in kept.items()),
            ident.alias("upstream_id"), job.alias("job_id"), F.coalesce(told("source_domain", "source_main"), F.lit("")).alias("source_domain")
        )
    )
    out = rows.withColumn("spans", spans)
    error = F.when(empty, "missing input or output").when(F.col("spans").isNull(), "malformed markup")
    return out.select(
        F.concat_ws("_", F.lit(dataset), F.lit(split), ident).alias("id"), F.lit("jd_skill_extract").alias("task"),
        F.concat_ws(":", F.lit(dataset), job).alias("source_group"), F.lit(split).alias("split"), F.col("pos"), F.col("input").alias("text"), "spans",
        by_label(F.col("spans"), LABELS).alias("label"), meta.alias("meta"), error.alias("error")
    )


def token_rows(rows: DataFrame, dataset: str, split: str, source: dict) -> DataFrame:
    """Tagged rows (pos, idx, source, tokens, tags_skill, tags_knowledge) in the form of :func:`marked_rows`; sentences of a
    posting are numbered in order."""
    posting, origin = F.coalesce("idx", F.lit("unknown")), F.coalesce("source", F.lit("unknown"))
    number = F.row_number().over(W.partitionBy("source", "idx").orderBy("pos")) - 1
    starts = F.transform("tokens", lambda t, i: F.aggregate(F.slice("tokens", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1))
    out = rows.withColumns({"_n": number, "_s": starts})
    soft, known = (tagged_spans(F.col("tokens"), F.col(c), F.col("_s"), label) for c, label in (("tags_skill", "soft_skill"), ("tags_knowledge", "knowledge")))
    ordered = F.transform(
        F.array_sort(F.transform(F.concat(soft, known), lambda s: F.struct(s["start"], s["end"], s["label"], s["text"]))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text"))
    )
    none = F.coalesce(F.size("tokens") <= 0, F.lit(True))
    out = out.withColumn("spans", F.when(~none, ordered))
    kept = ("language", "annotation", "license", "license_status", "intended_usage")
    meta = F.to_json(
        F.struct(
            F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), *(F.lit(source.get(k)).cast("string").alias(k) for k in kept),
            F.lit(bool(source.get("deidentified"))).alias("deidentified"), posting.alias("posting_id"), origin.alias("source_domain")
        )
    )
    error = F.when(none, "missing tokens").when(F.col("spans").isNull(), "invalid tags")
    return out.select(
        F.concat_ws(
            "_", F.lit(dataset), F.lit(split), origin, posting, F.col("_n").cast("string")
        ).alias("id"), F.lit("jd_skill_extract").alias("task"), F.concat_ws(":", F.lit(dataset), F.lit(split), origin, posting).alias("source_group"),
        F.lit(split).alias("split"), "pos", F.array_join("tokens", " ").alias("text"), "spans", by_label(
            F.col("spans"), {"soft_skill": "软技能", "knowledge": "知识技能"}, distinct=False
        ).alias("label"), meta.alias("meta"), error.alias("error"),
    )


def text_key(text: Column) -> Column:
    """What makes texts the same: squeezed and in lower case."""
    return F.sha1(F.lower(squeezed(text)))


def isolate(rows: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """``rows`` (split, pos, source_group, text) with ``outcome``: kept, or why a row is dropped.

    Splits are taken in order. A row is dropped where its group or its text is kept in an earlier split, or its text stands
    earlier in its own. Every split is one pass with two joins on what is kept so far.
    """
    marked = rows.withColumn("_k", text_key(F.col("text")))
    done: list[DataFrame] = []
    for split in priority:
        part = marked.filter(F.col("split") == split)
        if done:
            kept = reduce(DataFrame.unionByName, done).filter("outcome = 'kept'")
            groups = kept.select("source_group", F.lit(True).alias("_g")).distinct()
            texts = kept.select("_k", F.lit(True).alias("_t")).distinct()
            part = part.join(groups, "source_group", "left").join(texts, "_k", "left")
        else:
            part = part.withColumns({"_g": F.lit(None).cast("boolean"), "_t": F.lit(None).cast("boolean")})
        early = F.when(F.col("_g"), "cross_split_source_group").when(F.col("_t"), "cross_split_text")
        part = part.withColumn("_early", early)
        first = part.filter("_early is null").groupBy("_k").agg(F.min("pos").alias("_first"))
        part = part.join(first, "_k", "left").withColumn(
            "outcome", F.coalesce("_early", F.when(F.col("pos") == F.col("_first"), "kept").otherwise("within_split_text"))
        )
        done.append(part.select(*rows.columns, "_k", "outcome"))
    return reduce(DataFrame.unionByName, done).drop("_k")


def dataset_report(isolated: DataFrame, invalid: DataFrame, source: dict) -> DataFrame:
    """One row about isolated rows and the invalid ones (id): counts, overlaps between splits, and readiness."""
    kept = isolated.filter("outcome = 'kept'")
    one = kept.agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if(F.col("split") == "test").alias("test_rows"), F.countDistinct("source_group").alias("unique_source_groups"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("span_count"),
        F.count_if(F.size("spans") == 0).alias("negative_rows"),
    )
    crossing = lambda key: kept.groupBy(key.alias("k")).agg(
        F.min("split").alias("a"), F.max("split").alias("b")
    ).agg(F.count_if(F.col("a") != F.col("b")).alias("n"))
    drops = isolated.agg(F.count_if(F.col("outcome") != "kept").alias("n"))
    bad = invalid.agg(F.count(F.lit(1)).alias("n"))
    out = one.withColumns(
        {
            "cross_split_source_groups": crossing(F.col("source_group")).scalar(), "cross_split_texts": crossing(text_key(F.col("text"))).scalar(),
            "isolation_drops": drops.scalar(), "invalid_rows": bad.scalar()
        }
    )
    whole = F.col("total_processed") + F.col("isolation_drops") + F.col("invalid_rows")
    out = out.withColumn("invalid_source_rate", F.coalesce(F.round(F.try_divide(F.col("invalid_rows"), whole), 4), F.lit(0.0)))
    ready = (F.col("cross_split_source_groups") == 0) & (F.col("cross_split_texts") == 0) & (F.col("invalid_rows") <= MOST_INVALID * whole)
    licensed = source.get("license_status") == "confirmed" and source.get("intended_usage") not in ("internal_evaluation_only", "external_evaluation")
    return out.withColumns({"ready_for_internal_evaluation": ready & (F.col("test_rows") > 0), "ready_for_training": ready & F.lit(licensed)})


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def prepared(raw: dict[str, DataFrame], dataset: str, source: dict) -> tuple[DataFrame, DataFrame]:
    """(isolated rows, invalid rows) of a dataset's raw rows by split; ``source`` names the processor."""
    make = {"chinese_lkst": marked_rows, "skillspan_bio": token_rows}.get(source.get("processor", ""))
    if make is None:
        raise ValueError(f"unknown processor {source.get('processor')}")
    every = reduce(DataFrame.unionByName, (make(df, dataset, split, source) for split, df in raw.items()))
    return isolate(every.filter("error is null").drop("error")), every.filter("error is not null").select("id", "split", "pos", "error")
