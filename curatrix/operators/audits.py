"""Audits of pools, samples and sources: distributions, coverages, risks, origins, privacy, leaks between splits, and gates.

Rows of adverts, résumés, pairs and samples have ``meta`` as a JSON object. Reports are one-row tables, distributions long
ones (name, value, n), so that a report of many counters is one pass and one shuffle. Limits are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions.text import strip, text_or_empty
from curatrix.functions.values import normalized_hash
from curatrix.operators import fields, tiers
from curatrix.operators.matching import rank_of_degree, required_degree, required_years
from curatrix.operators.privacy import findings, for_training
from curatrix.operators.resumes import USABLE_FOR, signals


def meta(key: str) -> Column:
    return text_or_empty(F.get_json_object("meta", f"$.{key}"))


def stated(key: str, otherwise: str) -> Column:
    return F.when(meta(key) == "", otherwise).otherwise(meta(key))


def share(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """A share, 0 of nothing."""
    out = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def distributions(rows: DataFrame, columns: dict[str, Column], top: int | dict[str, int] | None = None, blanks: bool = True) -> DataFrame:
    """(name, value, n) of the values of each column, the commonest first; lists count by item. ``top`` bounds the values of
    each name; without ``blanks`` empty values don't count."""
    typed = rows.select(*(c.alias(n) for n, c in columns.items()))
    lists = {n: F.col(n).cast("array<string>") if isinstance(typed.schema[n].dataType, T.ArrayType) else F.array(F.col(n).cast("string")) for n in columns}
    named = lambda name: lambda v: F.struct(F.lit(name).alias("name"), text_or_empty(v).alias("value"))
    each = typed.select(
        F.explode(F.concat(*(F.transform(F.coalesce(c, F.array().cast("array<string>")), named(n)) for n, c in lists.items()))).alias("x")
    ).select("x.*")
    counts = (each if blanks else each.filter("value <> ''")).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts
    most = F.lit(top) if isinstance(top, int) else fields.cascade([(F.col("name") == k, F.lit(v)) for k, v in top.items()], F.lit(1 << 30))
    return counts.withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "value"))).filter(F.col("rn") <= most).drop("rn")


def _mean_length(c: Column) -> Column:
    return F.coalesce(F.avg(F.when(text_or_empty(c) != "", F.length(c))), F.lit(0.0))


def advert_report(rows: DataFrame) -> DataFrame:
    """One row about raw adverts (source, job_title, salary, raw_text, meta)."""
    raw = text_or_empty(F.col("raw_text"))
    told = lambda *keys, label: reduce(lambda a, b: a | b, ((meta(k) != "") for k in keys)) | raw.contains(label)
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("total_rows"), F.count_if(meta("training_eligible") == "true").alias("training_eligible_rows"), F.count_if(meta("holdout_eligible") == "true").alias("holdout_eligible_rows"),
        F.count_if(
            (meta("source_revision") != "") & (meta("artifact_sha256") != "")
        ).alias("pinned_artifact_rows"), _mean_length(F.col("job_title")).alias("avg_title_length"), _mean_length(F.col("raw_text")).alias("avg_raw_text_length"),
        share(F.count_if(told("education", label="学历要求：")), n, None).alias("education_coverage"), share(
            F.count_if(told("experience", "work_year", label="经验要求：")), n, None
        ).alias("experience_coverage"),
        share(F.count_if((text_or_empty(F.col("salary")) != "") | raw.contains("薪资范围：")), n, None).alias("salary_coverage"),
    )


def advert_distributions(rows: DataFrame) -> DataFrame:
    columns = {
        "source": F.col("source"), "language": meta("language"), "sft_ready": (meta("sft_ready") == "true").cast("string"), "intended_usage": stated("intended_usage", "unspecified"),
        "content_rights": stated("content_rights_status", "unspecified"), "annotation_type": stated("annotation_type", "unspecified"), "split_role": stated("split_role", "unspecified"),
    }
    return distributions(rows, columns, {"source": 30})


def _scored(label: str = "label") -> Column:
    return text_or_empty(F.col(f"{label}.raw_score").cast("string")) != ""


def pair_report(rows: DataFrame) -> DataFrame:
    """One row about imported pairs (jd_text, resume_text, label, meta)."""
    lower = lambda k, d: F.lower(stated(k, d))
    usable = (
        lower("license_status", "unconfirmed") == "confirmed"
    ) & lower("intended_usage", "audit_only").isin(*USABLE_FOR) & ~lower("provenance_status", "undocumented").isin("undocumented", "unknown")
    judged = (text_or_empty(F.col("label.raw_label")) != "") | _scored()
    key = F.sha1(F.concat(strip(text_or_empty(F.col("jd_text"))), F.lit("\n---\n"), strip(text_or_empty(F.col("resume_text")))))
    marked = rows.withColumns({"_key": key, "_usable": usable & judged})
    sums = lambda c, n: (
        F.sum(F.when(text_or_empty(F.col(c)) != "", F.length(c))).alias(f"{n}_chars"), F.count_if(text_or_empty(F.col(c)) != "").alias(f"{n}_n")
    )
    # Sums by pair first, so that the distinct count is a count of rows.
    pairs = marked.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), *sums("jd_text", "jd"), *sums("resume_text", "resume"), F.count_if(_scored()).alias("s"),
        F.count_if("_usable").alias("u")
    )
    out = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), share(F.sum("jd_chars"), F.sum("jd_n"), None).alias("avg_jd_length"), share(F.sum("resume_chars"), F.sum("resume_n"), None).alias("avg_resume_length"),
        share(F.sum("s"), F.sum("n"), None).alias("score_coverage"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pair_rows"), F.coalesce(F.sum("u"), F.lit(0)).alias("training_eligible_rows"),
    )
    return out.withColumn("training_ready", F.col("training_eligible_rows") > 0)


def pair_distributions(rows: DataFrame) -> DataFrame:
    columns = {
        "source": meta("source_name"), "language": meta("language"), "source_type": F.col("source_type"), "raw_label": F.array_compact(
            F.array(F.nullif(F.col("label.raw_label"), F.lit("")))
        ),
        "license_status": F.lower(stated("license_status", "unconfirmed")), "intended_usage": F.lower(stated("intended_usage", "audit_only")), "provenance_status": F.lower(stated("provenance_status", "undocumented")),
    }
    return distributions(rows, columns, {"raw_label": 20})


#: Kinds of tagged entities that tell of a person.
SENSITIVE = ("CONT", "LOC", "NAME", "ORG", "RACE")


def sensitive_tags(tags: Column) -> Column:
    """Whether a tag is of a sensitive kind."""
    return F.coalesce(F.exists(tags, lambda t: F.regexp_replace(t, "^[^-]*-", "").isin(*SENSITIVE)), F.lit(False))


#: The fields of a résumé's label and their names in reports.
CORE = {"target_job": "目标岗位", "education": "教育背景", "skills": "核心技能", "internships": "实习经历", "projects": "项目经历"}


def _has(label: Column, name: str) -> Column:
    return strip(text_or_empty(label[name])) != "" if name == "目标岗位" else F.coalesce(F.size(label[name]) > 0, F.lit(False))


def resume_report(rows: DataFrame) -> DataFrame:
    """One row about imported résumés (task, text, label, ner_tags, meta)."""
    parsed, tagged = F.col("task") == "resume_parse", F.col("task") == "resume_ner"
    covered = (share(F.count_if(parsed & _has(F.col("label"), n)), F.count_if(parsed), None).alias(f"{k}_coverage") for k, n in CORE.items())
    out = rows.agg(
        F.count(F.lit(1)).alias("total_rows"), _mean_length(F.col("text")).alias("avg_text_length"), *covered,
        F.count_if(tagged & sensitive_tags(F.col("ner_tags"))).alias("rows_with_sensitive_entities")
    )
    return out.withColumn("resume_ner_training_ready", F.col("rows_with_sensitive_entities") == 0)


def resume_distributions(rows: DataFrame) -> DataFrame:
    tags = F.when(F.col("task") == "resume_ner", F.col("ner_tags"))
    return distributions(
        rows,
        {"task": F.col("task"), "source": meta("source_name"), "language": meta("language"), "source_type": F.col("source_type"), "ner_tag": tags}
    )


def answer(kinds: str) -> Column:
    """A sample's answer, null where it isn't JSON."""
    said = F.element_at("messages", -1)["content"]
    return F.when(F.try_parse_json(said).isNotNull(), F.from_json(said, kinds))


def asked() -> Column:
    return text_or_empty(F.get("messages", 1)["content"])


_ADVERT = "`岗位方向` string, `核心职责` array<string>, `必备技能` array<string>, `学历要求` string, `经验要求` string"


def sample_report(rows: DataFrame) -> DataFrame:
    """One row about advert samples (id, messages)."""
    marked = rows.select(F.when(F.size("messages") >= 3, answer(_ADVERT)).alias("a"))
    n, there = F.count(F.lit(1)), F.col("a").isNotNull()
    size = lambda k: F.coalesce(F.avg(F.when(there, F.greatest(F.coalesce(F.size(F.col("a")[k]), F.lit(0)), F.lit(0)))), F.lit(0.0))
    told = lambda k: share(F.count_if(text_or_empty(F.col("a")[k]) != ""), n, None)
    return marked.agg(
        n.alias("total_samples"), share(F.count_if(there), n, None).alias("json_valid_rate"), size("核心职责").alias("avg_responsibility_count"),
        size("必备技能").alias("avg_skill_count"), told("学历要求").alias("education_coverage"), told("经验要求").alias("experience_coverage")
    )


def sample_distributions(rows: DataFrame) -> DataFrame:
    source = F.split_part(F.regexp_replace("id", "_jd_parse", ""), F.lit("_"), F.lit(1))
    named = F.when(F.size("messages") >= 3, answer(_ADVERT))
    return distributions(rows, {"source": source, "direction": F.when(named.isNotNull(), F.array(text_or_empty(named["岗位方向"])))}, {"source": 20})


def advert_pool_profile(rows: DataFrame) -> DataFrame:
    return distributions(
        rows, {"sources": F.col("source"), "titles": F.col("job_title"), "languages": meta("language"), "companies": F.col("company")},
        {"sources": 10, "titles": 15, "languages": 10, "companies": 15}, blanks=False
    )


def resume_pool_profile(rows: DataFrame) -> DataFrame:
    return distributions(
        rows, {"source_types": F.col("source_type"), "target_jobs": F.col("label")["目标岗位"], "skills": F.col("label")["核心技能"]},
        {"source_types": 10, "target_jobs": 10, "skills": 20}, blanks=False
    )


def pair_pool_profile(rows: DataFrame) -> DataFrame:
    present = {"with_raw_label": text_or_empty(F.col("label.raw_label")) != "", "with_raw_score": _scored()}
    columns = {"source_types": F.col("source_type"), "match_levels": F.col("label")["匹配等级"], **{k: F.when(ok, "yes") for k, ok in present.items()}}
    return distributions(rows, columns, 10, blanks=False)


def rejected_technical(rows: DataFrame) -> DataFrame:
    """(name, value, n) of trusted rows with technical titles that the strict tier rejects; rows have ``reason``."""
    kept = rows.filter(F.col("source").isin(*tiers.TRUSTED_SOURCES) & tiers.like_tech(F.col("job_title")) & (F.col("reason") != "accepted"))
    direction = F.when(tiers.row_direction() == "", "<empty>").otherwise(tiers.row_direction())
    return distributions(
        kept, {"reasons": F.col("reason"), "sources": F.col("source"), "titles": F.col("job_title"), "directions": direction},
        {"reasons": 20, "sources": 20, "titles": 30, "directions": 20}
    )


def with_risks(samples: DataFrame) -> DataFrame:
    """Samples with their source, risk reasons and score."""
    source = tiers.sample_source(meta("source"), F.col("id"))
    out = samples.withColumn("sample_source", source)
    out = out.withColumn("risk_reasons", tiers.risk_reasons(F.element_at("messages", -1)["content"], asked(), meta("quality_tier"), F.col("sample_source")))
    return out.withColumn("risk_score", tiers.risk_score(F.col("risk_reasons")))


def risk_report(samples: DataFrame, threshold: int = tiers.HIGH_RISK) -> DataFrame:
    """One row about samples with risks."""
    high, n = F.col("risk_score") >= threshold, F.count(F.lit(1))
    return samples.agg(
        n.alias("total"), F.count_if(F.size("risk_reasons") > 0).alias("risky"), F.count_if(high).alias("high_risk"),
        share(F.count_if(F.size("risk_reasons") > 0), n).alias("risk_rate"), share(F.count_if(high), n).alias("high_risk_rate")
    )


def risk_distributions(samples: DataFrame) -> DataFrame:
    return distributions(samples, {"reason": F.col("risk_reasons"), "score": F.col("risk_score")})


def risk_samples(samples: DataFrame, n: int = 100) -> DataFrame:
    """The first risky samples by id."""
    return samples.filter(F.size("risk_reasons") > 0).orderBy("id").limit(n)


def quality_report(rows: DataFrame, max_weak_rate: float = 0.4) -> DataFrame:
    """One row about chosen rows (tier, risk, quality, weak, labels)."""
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("total"), F.coalesce(F.round(F.avg("quality"), 2), F.lit(0.0)).alias("quality_score_avg"),
        F.count_if("weak").alias("weak_external_rows"), share(F.count_if("weak"), n).alias("weak_external_rate"),
        F.lit(max_weak_rate).alias("max_weak_external_ratio")
    )


def quality_distributions(rows: DataFrame) -> DataFrame:
    empty = lambda c: F.when(text_or_empty(c) == "", "yes")
    columns = {
        "tier": F.col("tier"), "source": F.col("source"), "direction": F.col("labels.direction"), "risk": F.col("risk"),
        "bucket": F.floor(F.col("quality") / 10) * 10, "empty_education": F.array_compact(F.array(empty(F.col("labels.education")))),
        "empty_experience": F.array_compact(F.array(empty(F.col("labels.experience")))), "reason": F.col("risk_reasons")
    }
    return distributions(rows, columns, {"source": 20})


def pair_origins(rows: DataFrame, most_educational: float = 0.4) -> DataFrame:
    """One row about where training pairs (id, source_type, meta) come from."""
    synthetic = text_or_empty(F.col("source_type")).startswith("synthetic") | meta("generator").startswith("synthetic")
    reviewed = ~synthetic & (meta("annotation_status") == "human_verified")
    observed = ~synthetic & ~reviewed & (meta("pair_type") == "real_observed_pair")
    n = F.count(F.lit(1))
    one = rows.agg(
        n.alias("total_rows"), F.count_if(synthetic).alias("synthetic_rows"), F.count_if(reviewed).alias("human_reviewed_pairs"), F.count_if(observed).alias("real_observed_pairs"),
        F.count_if(~synthetic & ~reviewed & ~observed).alias("unknown_pairs"), F.count_if(
            F.col("id").contains("synthetic_match_hf_job_educational_")
        ).alias("educational_source_rows"),
    )
    origin = F.when(F.col("total_rows") == 0, "empty").when(
        F.col("synthetic_rows") == F.col("total_rows"), "synthetic_only"
    ).when(F.col("synthetic_rows") > 0, "mixed").otherwise("non_synthetic_only")
    rate = lambda k: share(F.col(k), F.col("total_rows"))
    return one.withColumns({
        "synthetic_rate": rate("synthetic_rows"), "human_reviewed_pair_ratio": rate("human_reviewed_pairs"), "real_pair_ratio": rate("real_observed_pairs"), "educational_source_rate": rate("educational_source_rows"),
        "source_concentration_ready": (F.col("total_rows") > 0) & (
            F.col("educational_source_rows") <= most_educational * F.col("total_rows")
        ), "training_origin": origin, "supports_real_pair_quality_claim": F.col("human_reviewed_pairs") > 0,
    })


def privacy_report(rows: DataFrame, text: str, *by: str, most: float = 0.0) -> DataFrame:
    """(by..., row_count, rows_with_findings, rate, ready) of private findings in a text."""
    marked = rows.withColumn("_n", F.size(findings(F.col(text))))
    out = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("_n") > 0).alias("rows_with_findings"))
    return out.withColumn("rate", share(F.col("rows_with_findings"), F.col("row_count"))).withColumn(
        "ready", (F.col("row_count") > 0) & (F.col("rows_with_findings") <= most * F.col("row_count"))
    )


def privacy_kinds(rows: DataFrame, text: str) -> DataFrame:
    """(kind, n) of private findings."""
    return rows.select(F.explode(findings(F.col(text))).alias("f")).groupBy(F.col("f.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def sample_text(messages: str = "messages") -> Column:
    """All that is said in a sample."""
    return F.array_join(F.transform(messages, lambda m: text_or_empty(m["content"])), "\n")


def degree_consistency(rows: DataFrame) -> DataFrame:
    """Training pairs (id, jd_text, resume_text, label) whose degree flag differs from what the texts say, with both."""
    wanted = fields.degree(F.col("jd_text"))
    expected = (required_degree(wanted) == 0) | (rank_of_degree(text_or_empty(F.col("resume_text"))) >= required_degree(wanted))
    out = rows.select("id", wanted.alias("requirement"), F.coalesce(F.col("label")["学历匹配"], F.lit(False)).alias("labelled"), expected.alias("expected"))
    return out.filter("labelled <> expected")


def requirement_report(rows: DataFrame, kind: str) -> DataFrame:
    """(split, required, matched, unmatched, rate) of pairs whose advert asks for a degree or for years."""
    if kind == "degree":
        level, flag = required_degree(fields.degree(F.col("jd_text"))), F.col("label")["学历匹配"]
    else:
        level, flag = required_years(fields.experience(F.col("jd_text"))), F.col("label")["经验匹配"]
    marked = rows.select(stated("entity_split", "missing").alias("split"), level.alias("level"), F.coalesce(flag, F.lit(False)).alias("ok")).filter("level > 0")
    out = marked.groupBy("split").agg(F.count(F.lit(1)).alias("required"), F.count_if("ok").alias("matched"), F.count_if(~F.col("ok")).alias("unmatched"))
    return out.withColumn("rate", share(F.col("matched"), F.col("required")))


def requirement_levels(rows: DataFrame, kind: str) -> DataFrame:
    """(level, n) of what adverts ask for."""
    named = {1: "中专", 2: "大专", 3: "本科", 4: "硕士/研究生", 5: "博士"}
    if kind == "degree":
        rank = required_degree(fields.degree(F.col("jd_text")))
        level = fields.cascade([(F.col("r") == k, F.lit(v)) for k, v in named.items()], F.lit(""))
    else:
        rank, level = required_years(fields.experience(F.col("jd_text"))), F.concat(F.col("r").cast("string"), F.lit("年"))
    return rows.select(rank.alias("r")).filter("r > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def requirements_ready(report: DataFrame) -> DataFrame:
    """Whether every split has pairs that match and pairs that don't."""
    return report.agg(F.coalesce(F.bool_and((F.col("matched") > 0) & (F.col("unmatched") > 0)), F.lit(False)).alias("ready"))


#: What a task's samples must have, and how often fields may be empty.
REQUIRED = {
    "jd": {"岗位方向": 0.0, "核心职责": 0.08, "必备技能": 0.30, "学历要求": 0.35, "经验要求": 0.56},
    "resume": {"目标岗位": 0.05, "教育背景": 0.10, "核心技能": 0.10, "实习经历": 0.50, "项目经历": 0.20, "优势标签": 0.40},
    "match": {"匹配结论": 0.0, "匹配优势": 0.0, "主要短板": 0.0, "简历优化建议": 0.0, "推荐投递岗位方向": 0.0},
    "multitask": {},
}
SIZES = {"jd": (4240, 530, 530, 8000), "resume": (10000, 1000, 1000, 3000), "match": (3000, 400, 400, 4500), "multitask": (9540, 1180, 0, 10720)}
LEAST_GROUPS = {"jd": 0.95, "resume": 0.8, "match": 0.8}
PLACEHOLDERS = ("当前 JD 对应方向", "同方向相近岗位", "技能相近岗位", "技能相近或低门槛过渡岗位")
SPLITS = ("train", "valid", "test")


def _rank(split: Column) -> Column:
    return fields.cascade([(split == s, F.lit(i)) for i, s in enumerate(SPLITS)], F.lit(len(SPLITS)))


def crossing_rows(rows: DataFrame, key: str) -> DataFrame:
    """How many rows lie in another split than the first with their key."""
    marked = rows.filter(f"{key} is not null").groupBy(key, _rank(F.col("split")).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    first = marked.groupBy(key).agg(F.min(F.struct("r", "n")).alias("f"), F.sum("n").alias("all"))
    return first.agg(F.coalesce(F.sum(F.col("all") - F.col("f.n")), F.lit(0)).alias("n"))


def crossing_groups(rows: DataFrame, key: str) -> DataFrame:
    """How many keys lie in more than one split."""
    return rows.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n"))


def sample_audit(rows: DataFrame, task: str) -> DataFrame:
    """One row about a task's samples (split, id, task_type, linked_source_groups, messages)."""
    said = F.element_at("messages", -1)["content"]
    good = F.coalesce(F.try_parse_json(said).isNotNull() & (F.size("messages") > 1), F.lit(False))
    linked = F.col("linked_source_groups") if "linked_source_groups" in rows.columns else F.lit(None).cast("array<string>")
    marked = rows.select(
        "split", F.col("id").cast("string").alias("id"), "task_type", good.alias("good"), asked().alias("u"), said.alias("a"), linked.alias("linked")
    )
    v = F.try_parse_json("a")
    empty = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")).isin("", "[]", "{}")
    roles = F.from_json(F.get_json_object("a", "$.推荐投递岗位方向"), "array<string>")
    is_match = F.col("good") & (F.col("task_type") == "match")
    n = F.count(F.lit(1))
    one = marked.agg(
        n.alias("total"), F.count_if(~F.col("good")).alias("invalid_json"), (
            F.count_if("good") - F.countDistinct(F.when(F.col("good"), F.col("id")))
        ).alias("duplicate_ids"), *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS),
        F.count_if(
            is_match & F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, PLACEHOLDERS))), F.lit(False))
        ).alias("placeholder_rows"), F.count_if(is_match & ~F.col("u").contains('"命中项目"')).alias("rows_without_project_field"),
        *(share(F.count_if(F.col("good") & empty(k)), n).alias(f"empty_{k}") for k in REQUIRED[task]),
    )
    kept = marked.filter("good").select(
        "split", F.sha1(F.concat("u", F.lit("\n---\n"), "a")).alias("content"), normalized_hash(F.col("u")).alias("input"), "linked"
    )
    groups = kept.select("split", F.explode("linked").alias("g"))
    one = one.withColumns(
        {
            "cross_split_duplicates": crossing_rows(kept, "content").scalar(), "cross_split_inputs": crossing_rows(kept, "input").scalar(),
            "cross_split_linked_groups": crossing_groups(groups, "g").scalar()
        }
    )
    fine = reduce(lambda a, k: a & (F.col(f"empty_{k}") <= REQUIRED[task][k]), REQUIRED[task], F.lit(True))
    zero = ("invalid_json", "cross_split_duplicates", "cross_split_inputs", "cross_split_linked_groups", "placeholder_rows", "rows_without_project_field")
    return one.withColumns({"field_quality_ok": fine, "format_ready": reduce(lambda a, k: a & (F.col(k) == 0), zero, F.lit(True))})


def task_gate(audit: DataFrame, pool: DataFrame, task: str) -> DataFrame:
    """:func:`sample_audit` with the size of the pool and whether sizes, format and fields suffice."""
    train, valid, test, least = SIZES[task]
    out = audit.withColumn("n_pool", pool.agg(F.count(F.lit(1)).alias("n")).scalar())
    out = out.withColumn("count_ready", (F.col("n_train") >= train) & (F.col("n_valid") >= valid) & (F.col("n_test") >= test) & (F.col("n_pool") >= least))
    return out.withColumn("ready_for_sft", F.col("count_ready") & F.col("format_ready") & F.col("field_quality_ok"))


def source_group() -> Column:
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("source_group", "source_id", "id")))


def task_mix(rows: DataFrame) -> DataFrame:
    """(split, task, rows, unique_source_groups, source_group_ratio, enough) of multi-task samples (split, source_group,
    source_id, id, task_type, meta)."""
    marked = rows.select(
        "split", F.when(meta("dataset_task") != "", meta("dataset_task")).otherwise(F.col("task_type")).alias("task"), source_group().alias("g")
    )
    groups = marked.groupBy("split", "task", "g").agg(F.count(F.lit(1)).alias("n"))
    out = groups.groupBy("split", "task").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_source_groups")
    ).withColumn("source_group_ratio", share(F.col("unique_source_groups"), F.col("rows")))
    return out.withColumn(
        "enough", F.col("source_group_ratio") >= fields.cascade([(F.col("task") == k, F.lit(v)) for k, v in LEAST_GROUPS.items()], F.lit(0.0))
    )


def multitask_gate(rows: DataFrame) -> DataFrame:
    """One row: :func:`sample_audit` of multi-task samples with the mix of tasks, source groups in two splits and readiness."""
    audit, mix = sample_audit(rows, "multitask"), task_mix(rows)
    marked = rows.select(
        "split",
        F.struct(F.when(meta("dataset_task") != "", meta("dataset_task")).otherwise(F.col("task_type")).alias("t"), source_group().alias("g")).alias("g")
    )
    wanted = mix.filter(F.col("task").isin(*LEAST_GROUPS) & F.col("split").isin("train", "valid"))
    whole = wanted.agg((F.count(F.lit(1)) == 2 * len(LEAST_GROUPS)).alias("mix"), F.coalesce(F.bool_and("enough"), F.lit(False)).alias("diverse"))
    out = audit.withColumns(
        {
            "cross_split_source_groups": crossing_groups(marked, "g").scalar(), "has_required_mix": whole.select("mix").scalar(),
            "source_diversity_ready": whole.select(F.col("mix") & F.col("diverse")).scalar()
        }
    )
    train, valid, *_ = SIZES["multitask"]
    out = out.withColumn("count_ready", (F.col("n_train") >= train) & (F.col("n_valid") >= valid)).withColumn(
        "format_ready", F.col("format_ready") & (F.col("duplicate_ids") == 0) & (F.col("cross_split_source_groups") == 0)
    )
    return out.withColumn("ready_for_sft", F.col("count_ready") & F.col("format_ready") & F.col("has_required_mix") & F.col("source_diversity_ready"))


def roll_up(gates: dict[str, DataFrame], further: dict[str, dict[str, bool]] | None = None) -> DataFrame:
    """(task, ready_for_sft, blockers): a task is ready where its gate is and all further conditions hold."""
    parts = []
    for task, gate in gates.items():
        extra = (further or {}).get(task, {})
        flags = [c for c in ("count_ready", "format_ready", "field_quality_ok", "has_required_mix", "source_diversity_ready") if c in gate.columns]
        blockers = F.array_compact(
            F.array(*(F.when(~F.col(c), F.lit(c)) for c in flags), *(F.lit(k if not ok else None).cast("string") for k, ok in extra.items()))
        )
        parts.append(
            gate.select(F.lit(task).alias("task"), (F.col("ready_for_sft") & F.lit(all(extra.values()))).alias("ready_for_sft"), blockers.alias("blockers"))
        )
    return reduce(DataFrame.unionByName, parts)


def require_ready(report: DataFrame, tasks: list[str]) -> None:
    """Raise where one of the tasks of :func:`roll_up` is not ready or not there."""
    found = {r["task"]: r for r in report.filter(F.col("task").isin(*tasks)).collect()}
    bad = {t: (list(found[t]["blockers"]) if t in found else ["missing"]) for t in tasks if t not in found or not found[t]["ready_for_sft"]}
    if bad:
        raise RuntimeError(f"training is not ready: {bad}")


def held_out(samples: DataFrame, holdout: DataFrame) -> DataFrame:
    """Samples whose source is held out; ids are compared without the ending of samples."""
    key = lambda df: F.regexp_replace(
        F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("source_id", "id") if c in df.columns)), "_jd_parse$", ""
    )
    return samples.join(holdout.select(key(holdout).alias("_held")).distinct(), key(samples) == F.col("_held"), "left_semi")


def resume_sample_report(rows: DataFrame) -> DataFrame:
    """One row about résumé samples (split, id, source_group): how far sources are multiplied."""
    group = F.coalesce(F.nullif(F.col("source_group"), F.lit("")), F.col("id"))
    variant = F.when(F.col("id").startswith(F.concat("g", F.lit("_"))), F.substring(F.col("id"), F.length("g") + 2, F.length("id"))).otherwise("unknown")
    marked = rows.select(group.alias("g"), "id", "split").withColumn("variant", variant)
    groups = marked.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    made = F.col("g").contains("bootstrap")
    one = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_source_groups"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_source_group_size"),
        F.coalesce(F.sum(F.when(made, F.col("n"))), F.lit(0)).alias("bootstrap_samples"), F.count_if(made).alias("bootstrap_source_groups")
    )
    most = marked.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    out = one.withColumns({
        "expansion_ratio": share(F.col("total"), F.col("unique_source_groups")), "bootstrap_rate": share(F.col("bootstrap_samples"), F.col("total")),
        "bootstrap_source_group_rate": share(
            F.col("bootstrap_source_groups"), F.col("unique_source_groups")
        ), "max_variant_rate": share(most.scalar(), F.col("total")),
    })
    return out.withColumn(
        "profile_ready",
        (F.col("unique_source_groups") >= 3000) & (F.col("expansion_ratio") <= 20) & (F.col("max_source_group_size") <= 7) & (F.col("max_variant_rate") <= 0.25) & (F.col("bootstrap_source_group_rate") <= 0.8)
    )


def resume_groups(rows: DataFrame) -> DataFrame:
    """(split, category, groups): distinct source groups by where they come from."""
    g = F.coalesce(F.nullif(F.col("source_group"), F.lit("")), F.col("id"))
    category = F.when(g.startswith("resume_bootstrap_"), "bootstrap_from_jd").when(
        g.startswith("resume_eval_"), "repository_curated_seed"
    ).otherwise(F.split_part(g, F.lit("_"), F.lit(1)))
    return rows.select("split", category.alias("category"), g.alias("g")).distinct().groupBy("split", "category").agg(F.count(F.lit(1)).alias("groups"))


DECISIONS = ("training_allowed", "audit_only", "evaluation_only", "rejected")
UNKNOWN_ORIGIN = ("", "undocumented", "unknown", "source_collection_and_original_producer_undocumented")


def source_admission(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row a source of ``manifest`` (name, schema, license_status, intended_usage, provenance_status, collection_method,
    admission_decision, min_unique_content_groups, max_duplicate_template_ratio): what its imported rows (task, text, label,
    ner_tags, meta.source_name) hold, which gates they pass, and the decision."""
    tagged = (F.col("task") == "resume_ner") & sensitive_tags(F.col("ner_tags"))
    marked = rows.select(
        meta("source_name").alias("name"), (F.size(findings(F.col("text"))) > 0).alias("private"), tagged.alias("tagged"),
        strip(for_training(F.col("text"))).alias("clean"), (F.col("task") == "resume_parse").alias("parsed"),
        F.coalesce(signals(F.col("label")) >= 3, F.lit(False)).alias("usable")
    )
    marked = marked.withColumn("left", F.coalesce(F.size(findings(F.col("clean"))) > 0, F.lit(False)))
    fit = ~F.col("tagged") & (F.col("clean") != "") & ~F.col("left")
    marked = marked.withColumns({"fit": fit, "group": normalized_hash(F.col("clean")), "exact": F.sha2("clean", 256)})
    sums = marked.groupBy("name").agg(
        F.count(F.lit(1)).alias("imported_rows"), F.count_if(F.col("private") | F.col("tagged")).alias("rows_with_findings"), F.count_if(~F.col("tagged") & F.col("left")).alias("residual_rows"), F.count_if("fit").alias("after_privacy"),
        F.countDistinct(F.when(F.col("fit"), F.col("exact"))).alias("exact_texts"), F.countDistinct(F.when(F.col("fit"), F.col("group"))).alias("unique_content_groups"), F.count_if("parsed").alias("parsed_rows"), F.count_if(F.col("parsed") & F.col("usable")).alias("usable_rows"),
    )
    numbers = [c for c in sums.columns if c != "name"]
    out = manifest.join(sums, "name", "left").na.fill(0, numbers)
    out = out.withColumn(
        "duplicate_template_ratio", share(F.col("after_privacy") - F.col("unique_content_groups"), F.col("after_privacy"))
    ).withColumn("usable_rate", share(F.col("usable_rows"), F.col("parsed_rows")))
    said = lambda c, d="": F.lower(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)))
    gates = {
        "license_ready": said("license_status") == "confirmed", "allowed_usage_ready": said("intended_usage").isin(*USABLE_FOR), "provenance_ready": ~said("provenance_status", "undocumented").isin(*UNKNOWN_ORIGIN),
        "privacy_ready": (F.col("residual_rows") == 0) & (F.col("after_privacy") > 0), "schema_ready": (F.col("schema") == "resume_parse_rows") & (F.col("usable_rate") >= 0.9),
        "content_diversity_ready": (F.col("unique_content_groups") >= F.coalesce("min_unique_content_groups", F.lit(20))) & (
            F.col("duplicate_template_ratio") <= F.coalesce("max_duplicate_template_ratio", F.lit(0.8))
        ),
        "independent_real_content_ready": ~said("collection_method").contains("template"),
    }
    out = out.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in gates.items()})
    every = reduce(lambda a, k: a & F.col(k), gates, F.lit(True))
    declared = F.when(F.col("admission_decision").isin(*DECISIONS), F.col("admission_decision")).otherwise("rejected")
    return out.withColumn("final_decision", F.when(declared != "training_allowed", declared).when(every, "training_allowed").otherwise("rejected"))


def manifest_status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``manifest`` (name, path, license_status, intended_usage, provenance_status) with whether its file is among ``files``
    (path) and whether its rows may train."""
    there = files.select("path", F.lit(True).alias("exists")).distinct()
    said = lambda c: F.lower(text_or_empty(F.col(c)))
    allowed = (said("license_status") == "confirmed") & said("intended_usage").isin(*USABLE_FOR) & ~said("provenance_status").isin("", "undocumented", "unknown")
    return manifest.join(there, "path", "left").na.fill(False, ["exists"]).withColumn("training_eligible", allowed)


#: What a title alone says of its direction.
TITLE_SIGNS = {
    "前端开发": "前端|web前端|frontend", "后端开发": "后端|后台开发|服务端|backend|java开发|golang开发|python开发", "测试开发": r"测试|\bqa\b", "运维开发": r"运维|devops|\bsre\b", "嵌入式开发": "嵌入式|固件|bsp|驱动开发",
    "安全工程": "安全工程|网络安全|信息安全|渗透测试", "数据开发": "数据开发|大数据开发|数仓|etl", "客户端开发": "客户端|android|ios", "算法工程": "算法|机器学习|深度学习|自然语言处理|计算机视觉",
}


def title_of(prompt: Column) -> Column:
    return strip(F.regexp_extract(text_or_empty(prompt), r"(?U)岗位名称[：:]\s*([^\n]+)", 1))


def expected_direction(title: Column) -> Column:
    """The only direction that a title shows, empty for none or several."""
    hits = F.array_compact(F.array(*(F.when(fields.has(title, p), F.lit(d)) for d, p in TITLE_SIGNS.items())))
    return F.when(F.size(hits) == 1, F.get(hits, 0)).otherwise("")


def direction_conflicts(samples: DataFrame) -> DataFrame:
    """Samples whose title shows one direction, with it, their own and whether they differ."""
    own = answer(_ADVERT)
    out = samples.select(
        "id", title_of(asked()).alias("title"), F.when(own.isNull(), "<invalid>").otherwise(text_or_empty(own["岗位方向"])).alias("actual"),
        stated("quality_tier", "unknown").alias("quality_tier"), stated("source", "unknown").alias("source")
    )
    out = out.withColumn("expected", expected_direction(F.col("title"))).filter("expected <> ''")
    return out.withColumn("conflict", F.col("expected") != F.col("actual"))


def conflict_report(conflicts: DataFrame) -> DataFrame:
    return conflicts.agg(
        F.count(F.lit(1)).alias("signaled_rows"), F.count_if("conflict").alias("conflict_rows"),
        share(F.count_if("conflict"), F.count(F.lit(1))).alias("conflict_rate")
    )


def conflict_groups(conflicts: DataFrame) -> DataFrame:
    return conflicts.filter("conflict").groupBy("expected", "actual", "quality_tier", "source").agg(F.count(F.lit(1)).alias("count"))


def experience_gaps(samples: DataFrame) -> DataFrame:
    """Samples without years, with those that their prompt tells."""
    own = answer(_ADVERT)
    out = samples.select(
        "id", title_of(asked()).alias("title"), fields.experience(asked()).alias("recoverable"),
        stated("quality_tier", "unknown").alias("quality_tier"), own.isNotNull().alias("good"), strip(text_or_empty(own["经验要求"])).alias("years")
    )
    return out.filter("good and years = ''").drop("good", "years")


def gap_report(gaps: DataFrame) -> DataFrame:
    found = F.col("recoverable") != ""
    return gaps.agg(
        F.count(F.lit(1)).alias("empty_rows"), F.count_if(found).alias("recoverable_rows"),
        share(F.count_if(found), F.count(F.lit(1))).alias("recoverable_rate")
    )


def samples_profile(rows: DataFrame) -> DataFrame:
    """One row about samples (id, source_group, source_id, meta): rows and distinct source groups."""
    groups = rows.select(source_group().alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("g").alias("unique_source_groups")
    ).withColumn("source_group_ratio", share(F.col("unique_source_groups"), F.col("rows")))


def resume_file_checks(rows: DataFrame, required: tuple[str, ...] = ("education", "skills", "internships", "projects"), least_chars: int = 800) -> DataFrame:
    """``rows`` of read résumés (parse_ok, needs_ocr, clean_text, sections) with the names of the checks that fail."""
    missing = F.array_compact(F.array(*(F.when(text_or_empty(F.col(f"sections.{s}")) == "", F.lit(s)) for s in required)))
    checks = {
        "parse_ok": F.coalesce("parse_ok", F.lit(False)), "does_not_need_ocr": ~F.coalesce("needs_ocr", F.lit(False)),
        "min_text_chars": F.length(text_or_empty(F.col("clean_text"))) >= least_chars, "required_sections": F.size(missing) == 0
    }
    return rows.withColumn("missing_sections", missing).withColumn(
        "failed_checks", F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in checks.items())))
    )
