"""Evaluation of predicted answers: set scores by field, layers and groups, error types, grounding, readiness and regressions,
review queues and audits of gold pairs.

Answers are JSON texts. Scores are macro means over the rows with a usable answer; sets are compared trimmed and in lower
case. Everything is one aggregation by group; lists of metrics are long tables, so reports are joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import compact_hash, strip, text_or_empty
from curatrix.functions.values import normalized_hash
from curatrix.operators import matching
from curatrix.operators.fields import cascade
from curatrix.operators.pairing import contradictions, squeezed, ungrounded


@dataclass(frozen=True)
class Spec:
    """The fields of a task's answer."""

    lists: tuple[str, ...]
    texts: tuple[str, ...]
    flags: tuple[str, ...] = ()


#: The fields that are scored.
SPECS = {
    "jd_parse": Spec(("核心职责", "必备技能", "加分项"), ("岗位方向", "经验要求", "学历要求")),
    "resume_parse": Spec(("教育背景", "核心技能", "实习经历", "项目经历", "优势标签"), ("目标岗位",)),
    "match": Spec(("命中技能", "缺失技能"), ("匹配等级",), ("岗位方向匹配", "学历匹配", "经验匹配")),
}
#: A score under this is a mismatch.
ALIKE = 0.999


def items(c: Column) -> Column:
    """The set of trimmed lower-case items."""
    return F.array_distinct(
        F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(text_or_empty(x)))), lambda x: x != "")
    )


def set_scores(found: Column, gold: Column) -> Column:
    """(precision, recall, f1) of sets: 1 where both are empty, 0 where only the found one is."""
    def of(s: Column) -> Column:
        hits, p, g = F.size(F.array_intersect(s["p"], s["g"])), F.size(s["p"]), F.size(s["g"])
        both = (p == 0) & (g == 0)
        share = lambda n: F.when(both, 1.0).when((p == 0) | (n == 0), 0.0).otherwise(hits / n)
        return F.struct(share(p).alias("precision"), share(g).alias("recall"), F.when(both, 1.0).when(hits == 0, 0.0).otherwise(2 * hits / (p + g)).alias("f1"))

    return F.get(F.transform(F.array(F.struct(items(found).alias("p"), items(gold).alias("g"))), of), 0)


def exact(found: Column, gold: Column) -> Column:
    """1 where texts are equal but for blanks and case."""
    return (F.lower(squeezed(found)) == F.lower(squeezed(gold))).cast("double")


def _parsed(c: Column, spec: Spec) -> Column:
    kinds = {**dict.fromkeys(spec.lists, "array<string>"), **dict.fromkeys(spec.texts, "string"), **dict.fromkeys(spec.flags, "boolean")}
    return F.from_json(text_or_empty(c), ", ".join(f"`{k}` {t}" for k, t in kinds.items()))


def scored(rows: DataFrame, spec: Spec, found: str = "parsed", gold: str = "label", usable: Column | None = None) -> DataFrame:
    """``rows`` with ``usable``, ``scores`` (a map from fields to precision, recall, f1 and exact_match) and ``mismatched``,
    the fields that differ."""
    p, g, none = F.col("_p"), F.col("_g"), F.lit(None).cast("double")
    ok = F.coalesce(F.col("ok") if usable is None else usable, F.lit(False))
    lists = {f: set_scores(p[f], g[f]) for f in spec.lists}
    others = {f: exact(p[f], g[f]) for f in spec.texts} | {
        f: (F.coalesce(p[f], F.lit(False)) == F.coalesce(g[f], F.lit(False))).cast("double") for f in spec.flags
    }
    cells = [
        (f, F.struct(s["precision"].alias("precision"), s["recall"].alias("recall"), s["f1"].alias("f1"), none.alias("exact_match"))) for f,
        s in lists.items()
    ]
    cells += [(f, F.struct(none.alias("precision"), none.alias("recall"), none.alias("f1"), s.alias("exact_match"))) for f, s in others.items()]
    scores = F.create_map(*(x for f, c in cells for x in (F.lit(f), c)))
    out = rows.withColumns(
        {"_p": _parsed(F.col(found), spec), "_g": _parsed(F.col(gold), spec), "usable": ok}
    ).withColumn("scores", F.when(F.col("usable"), scores))
    differ = F.map_keys(F.map_filter("scores", lambda _, s: F.coalesce(s["f1"], s["exact_match"]) < ALIKE))
    return out.withColumn("mismatched", F.coalesce(differ, F.array().cast("array<string>"))).drop("_p", "_g")


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., field, precision, recall, f1, exact_match): means over usable rows of :func:`scored`."""
    each = rows.select(*by, F.explode("scores").alias("field", "s"))
    return each.groupBy(*by, "field").agg(*(F.avg(f"s.{k}").alias(k) for k in ("precision", "recall", "f1", "exact_match")))


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., num_samples, valid_rate, num_mismatch_samples); unusable rows aren't mismatches here."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_samples"), F.coalesce(F.avg(F.col("usable").cast("double")), F.lit(0.0)).alias("valid_rate"),
        F.count_if(F.size("mismatched") > 0).alias("num_mismatch_samples")
    )


def evaluated(rows: DataFrame, *by: str) -> DataFrame:
    """Metrics of predictions (task, ok, parsed, label) of one task."""
    tasks = [r["task"] for r in rows.select("task").distinct().limit(3).collect()]
    if len(tasks) != 1 or tasks[0] not in ("jd_parse", "resume_parse"):
        raise ValueError(f"rows of one known task are needed, not {sorted(map(str, tasks))}")
    return metrics(scored(rows, SPECS[tasks[0]]), *by)


def mismatches(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first rows by id whose fields differ."""
    return rows.filter(F.size("mismatched") > 0).select("id", "mismatched").orderBy("id").limit(n)


#: Layers of predicted matches: where the result stands and what tells that it is there.
LAYERS = {
    "raw_model_derived": ("raw_model.rule_result", "raw_model.structured_result_available"),
    "normalized": ("normalized.rule_result", "normalized.structured_result_available"),
    "product_final": ("rule_result", "parsed_ok"),
}


def layers(rows: DataFrame) -> DataFrame:
    """Predicted matches (id, label, jd_ok, resume_ok, rule_result, raw_model, normalized; the last two structs of rule_result
    and structured_result_available) once a layer, scored."""
    rows = rows.withColumn("parsed_ok", F.col("jd_ok") & F.col("resume_ok"))
    parts = [
        scored(rows.withColumn("_found", F.col(path)), SPECS["match"], "_found", "label", F.col(there)).withColumn("layer", F.lit(name)) for name,
        (path, there) in LAYERS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def error_types(gold: Column, found: Column, tags: Column, format_ok: Column, contradicted: Column) -> Column:
    """Codes of what is wrong with a predicted match; ``gold`` and ``found`` are parsed answers of the match task."""
    none = F.array().cast("array<string>")
    of = lambda c, k: F.coalesce(c[k], none)
    beyond = lambda a, b: F.size(F.array_except(a, b)) > 0
    hit, missed = (of(gold, "命中技能"), of(found, "命中技能")), (of(gold, "缺失技能"), of(found, "缺失技能"))
    skills = beyond(*hit) | beyond(*hit[::-1]) | beyond(*missed) | beyond(*missed[::-1])
    flag = lambda k: F.coalesce(gold[k], F.lit(False)) != F.coalesce(found[k], F.lit(False))
    tagged = lambda t: F.array_contains(F.coalesce(tags, none), t)
    rules = (
        (~F.coalesce(format_ok, F.lit(False)), "输出格式错误"), (beyond(*hit), "技能漏召回"), (beyond(*hit[::-1]), "技能误识别"), (skills & tagged("技能同义词"), "同义表达错误"), (skills & tagged("可迁移技能"), "可迁移技能错误"),
        (flag("岗位方向匹配"), "岗位方向错误"), (
            ~found["匹配等级"].eqNullSafe(gold["匹配等级"]), "匹配等级错误"
        ), (flag("学历匹配"), "学历判断错误"), (flag("经验匹配"), "经验判断错误"), (contradicted, "模型解释与结构矛盾"),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in rules)))


def explained(rows: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """``rows`` (rule_result, analysis as JSON) with ``contradictions``, ``ungrounded`` and whether each is empty."""
    r = _parsed(F.col("rule_result"), SPECS["match"])
    a = F.from_json(text_or_empty(F.col("analysis")), "`匹配结论` string, `匹配优势` array<string>, `主要短板` array<string>, `简历优化建议` array<string>")
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n")
    flags = [F.coalesce(F.col("_r")[k], F.lit(False)) for k in ("岗位方向匹配", "学历匹配", "经验匹配")]
    none = F.array().cast("array<string>")
    hit, missed = (F.coalesce(F.col("_r")[k], none) for k in ("命中技能", "缺失技能"))
    good, bad, advice = (joined(F.col("_a")[k]) for k in ("匹配优势", "主要短板", "简历优化建议"))
    out = rows.withColumns({"_r": r, "_a": a})
    out = out.withColumn("contradictions", contradictions(*flags, missed, F.col("_r")["匹配等级"], good, bad, text_or_empty(F.col("_a")["匹配结论"])))
    out = out.withColumn("ungrounded", ungrounded(vocabulary, hit, missed, flags[1], flags[2], good, bad, advice))
    return out.withColumns({"structural_consistent": F.size("contradictions") == 0, "evidence_grounded": F.size("ungrounded") == 0}).drop("_r", "_a")


def error_ranking(rows: DataFrame, errors: str = "errors") -> DataFrame:
    """(error_type, count), the commonest first."""
    return rows.select(F.explode(errors).alias("error_type")).groupBy("error_type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "error_type")


#: What a release needs: (report, field or rate, key, least).
CHECKS = {
    "jd_json_valid_rate": ("jd", "", "valid_rate", 0.98), "jd_core_responsibility_f1": ("jd", "核心职责", "f1", 0.98), "jd_required_skill_f1": ("jd", "必备技能", "f1", 0.98), "jd_bonus_f1": ("jd", "加分项", "f1", 0.98),
    "jd_direction_exact_match": ("jd", "岗位方向", "exact_match", 0.95), "jd_experience_exact_match": ("jd", "经验要求", "exact_match", 0.98), "jd_education_exact_match": ("jd", "学历要求", "exact_match", 0.98),
    "resume_json_valid_rate": ("resume", "", "valid_rate", 0.99), "resume_education_f1": ("resume", "教育背景", "f1", 0.98), "resume_skill_f1": ("resume", "核心技能", "f1", 0.98), "resume_internship_f1": ("resume", "实习经历", "f1", 0.98),
    "resume_project_f1": ("resume", "项目经历", "f1", 0.98), "resume_strength_f1": ("resume", "优势标签", "f1", 0.98), "resume_direction_exact_match": ("resume", "目标岗位", "exact_match", 0.98),
    "match_parse_success_rate": ("match", "", "valid_rate", 0.99), "match_analysis_json_valid_rate": ("match", "", "analysis_valid_rate", 0.99), "match_hit_skill_f1": ("match", "命中技能", "f1", 0.85),
    "match_missing_skill_f1": ("match", "缺失技能", "f1", 0.89), "match_level_exact_match": ("match", "匹配等级", "exact_match", 0.78), "match_direction_exact_match": ("match", "岗位方向匹配", "exact_match", 0.90),
    "match_education_exact_match": ("match", "学历匹配", "exact_match", 0.98), "match_experience_exact_match": ("match", "经验匹配", "exact_match", 0.98),
}
#: How far a measure may fall.
MOST_REGRESSION = 0.005


def long_metrics(report: str, by_field: DataFrame, whole: DataFrame) -> DataFrame:
    """(report, field, key, value) of :func:`metrics` and :func:`rates`."""
    keys = ("precision", "recall", "f1", "exact_match")
    each = by_field.select(
        F.lit(report).alias("report"), "field",
        F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys)))
    )
    names = [c for c in whole.columns if c.endswith("rate")]
    rest = whole.select(
        F.lit(report).alias("report"), F.lit("").alias("field"),
        F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in names)))
    )
    return each.unionByName(rest).filter("value is not null")


def readiness(spark: SparkSession, measured: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """(name, actual, threshold, passed) of every check on a long table of metrics; what isn't measured counts as 0."""
    checks = [(n, r, f, k, float((limits or {}).get(n, least))) for n, (r, f, k, least) in CHECKS.items()]
    wanted = spark.createDataFrame(checks, "name string, report string, field string, key string, threshold double")
    joined = F.broadcast(wanted).join(measured, ["report", "field", "key"], "left").select("name", F.coalesce("value", F.lit(0.0)).alias("actual"), "threshold")
    return joined.withColumn("passed", F.col("actual") >= F.col("threshold"))


def regressions(candidate: DataFrame, baseline: DataFrame, most: float = MOST_REGRESSION) -> DataFrame:
    """(name, candidate, baseline, delta, passed) of two readiness tables."""
    both = candidate.select("name", F.col("actual").alias("candidate")).join(
        baseline.select("name", F.col("actual").alias("baseline")), "name", "left"
    ).na.fill(0.0, ["baseline"])
    return both.withColumn("delta", F.col("candidate") - F.col("baseline")).withColumn("passed", F.col("delta") + 1e-12 >= -most)


def deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """(key, base, other, delta) of two one-row reports."""
    long = lambda df, name: df.select(
        F.inline(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias(name)) for c in df.columns)))
    )
    return long(base, "base").join(long(other, "other"), "key").withColumn("delta", F.col("other") - F.col("base"))


def review_queue(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold pairs (id, jd_text, resume_text, label as JSON) with reasons to review them, the most urgent first.

    ``predictions`` have (id, rule_result as JSON, pos); of those with one id the last counts.
    """
    last = predictions.groupBy("id").agg(F.max_by("rule_result", "pos").alias("rule_result"), F.lit(1).alias("_there"))
    both = gold.join(last, "id", "left").withColumns({"_g": _parsed(F.col("label"), SPECS["match"]), "_p": _parsed(F.col("rule_result"), SPECS["match"])})
    g, p, none = F.col("_g"), F.col("_p"), F.array().cast("array<string>")
    wants, has = matching.required_years(F.col("jd_text")), matching.years(F.col("resume_text"))
    degree, own = matching.rank_of_degree(text_or_empty(F.col("jd_text"))), matching.rank_of_degree(text_or_empty(F.col("resume_text")))
    flag = lambda c, k: F.coalesce(c[k], F.lit(False))
    of = lambda c, k: F.coalesce(c[k], none)
    found = text_or_empty(F.col("rule_result")) != ""
    both = both.withColumns({
        "label_missing_but_evidenced": F.array_sort(F.array_intersect(of(g, "缺失技能"), of(p, "命中技能"))),
        "label_omitted_evidence": F.array_sort(F.array_except(F.array_except(of(p, "命中技能"), of(g, "命中技能")), of(g, "缺失技能"))),
        "product_missed_gold": F.array_sort(F.array_intersect(of(g, "命中技能"), of(p, "缺失技能"))),
        "jd_required_years": wants, "resume_explicit_years": has, "jd_education_rank": degree, "resume_education_rank": own,
    })
    any_of = lambda c: F.size(c) > 0
    rules = (
        ((F.col("jd_required_years") > 0) & (flag(g, "经验匹配") != (F.col("resume_explicit_years") >= F.col("jd_required_years"))), "经验标签与原文明示年限矛盾", 4),
        ((F.col("jd_education_rank") > 0) & (flag(g, "学历匹配") != (F.col("resume_education_rank") >= F.col("jd_education_rank"))), "学历标签与原文明示学历矛盾", 4),
        (
            any_of("label_missing_but_evidenced"), "标签判缺失但评分器找到双侧技能证据", 4
        ), (any_of("label_omitted_evidence"), "标签未覆盖评分器找到的技能证据", 3), (any_of("product_missed_gold"), "评分器漏掉标签声明命中的技能", 3),
        (
            found & (flag(p, "岗位方向匹配") != flag(g, "岗位方向匹配")), "岗位方向标签与产品结果不一致", 2
        ), (found & ~p["匹配等级"].eqNullSafe(g["匹配等级"]), "匹配等级标签与产品结果不一致", 1), (F.col("_there").isNull(), "缺少对应预测结果", 2),
    )
    reasons = F.array_compact(F.array(*(F.when(ok, F.lit(t)) for ok, t, _ in rules)))
    score = sum((F.when(ok, n).otherwise(0) for ok, _, n in rules), F.lit(0))
    return both.withColumns({"review_reasons": reasons, "priority_score": score}).drop("_g", "_p", "_there").orderBy(F.desc("priority_score"), "id")


#: Tags, levels and annotation fields of gold pairs.
TAGS = ("技能同义词", "可迁移技能", "相近岗位方向", "年限不足但项目强", "学历不完全满足", "技能仅在项目中", "AI算法后端交叉", "OCR噪声", "单项硬门槛不满足")
LEVELS = ("高匹配", "较匹配", "基本匹配", "低匹配")
ANNOTATION = ("annotator_id", "reviewed_at", "rationale")
VERIFIED = "human_verified"


def label_errors(label: Column) -> Column:
    """Codes of what is wrong with a label, a JSON text."""
    v = F.try_parse_json(text_or_empty(label))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    g = _parsed(label, SPECS["match"])
    both = F.arrays_overlap(g["命中技能"], g["缺失技能"])
    rules = [(~F.coalesce(g["匹配等级"].isin(*LEVELS), F.lit(False)), "invalid_match_level")]
    rules += [(F.coalesce(kind(k) != "BOOLEAN", F.lit(True)), f"invalid_bool:{k}") for k in SPECS["match"].flags]
    rules += [(~F.coalesce(kind(k).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)), f"invalid_list:{k}") for k in SPECS["match"].lists]
    rules += [(F.coalesce(both, F.lit(False)), "skill_in_both_matched_and_missing")]
    found = F.array_compact(F.array(*(F.when(ok, F.lit(code)) for ok, code in rules)))
    return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), found).otherwise(F.array(F.lit("label_not_object")))


def gold_rows(gold: DataFrame, training: DataFrame, adverts: DataFrame | None = None, resumes: DataFrame | None = None) -> DataFrame:
    """``gold`` (id, source_group, jd_text, resume_text, label as JSON, meta as JSON) with ``errors`` and whether its pair, its
    advert and its résumé occur in the training pairs, and the latter two in the training texts of the single tasks."""
    text = lambda n: strip(text_or_empty(F.col(n)))
    meta = lambda k: strip(text_or_empty(F.get_json_object("meta", f"$.{k}")))
    tags = F.coalesce(F.from_json(F.get_json_object("meta", "$.difficulty_tags"), "array<string>"), F.array().cast("array<string>"))
    status = F.when(meta("annotation_status") == "", "missing").otherwise(meta("annotation_status"))
    verified = status == VERIFIED
    rules = [
        (text_or_empty(F.col("id")) == "", "missing_id"), (text_or_empty(F.col("source_group")) == "", "missing_source_group"),
        (text("jd_text") == "", "missing_jd_text"), (text("resume_text") == "", "missing_resume_text"), (~verified, "not_human_verified")
    ]
    rules += [(verified & (meta(k) == ""), f"missing_annotation_field:{k}") for k in ANNOTATION]
    rules += [(F.size(tags) == 0, "missing_difficulty_tags"), (F.exists(tags, lambda t: ~t.isin(*TAGS)), "unknown_difficulty_tag")]
    errors = F.concat(label_errors(F.col("label")), F.array_compact(F.array(*(F.when(ok, F.lit(code)) for ok, code in rules))))
    pair = lambda: normalized_hash(F.concat(text_or_empty(F.col("jd_text")), F.lit("\n---\n"), text_or_empty(F.col("resume_text"))))
    keys = {"pair_hash": pair(), "jd_hash": normalized_hash(F.col("jd_text")), "resume_hash": normalized_hash(F.col("resume_text"))}
    out = gold.withColumns({"errors": errors, "status": status, "tags": tags, **keys})
    trained = training.select(*(c.alias(k) for k, c in keys.items()))
    one = lambda df, c: None if df is None else df.select(normalized_hash(F.col(c)).alias("k"))
    known = {
        "pair_hash": ("in_training", trained.select(F.col("pair_hash").alias("k"))),
        "jd_hash": ("jd_in_training", trained.select(F.col("jd_hash").alias("k"))),
        "resume_hash": ("resume_in_training", trained.select(F.col("resume_hash").alias("k")))
    }
    tasks = [("jd_hash", "jd_in_task", one(adverts, "raw_text")), ("resume_hash", "resume_in_task", one(resumes, "text"))]
    for key, name, seen in [(k, n, s) for k, (n, s) in known.items()] + tasks:
        if seen is None:
            out = out.withColumn(name, F.lit(False))
            continue
        marks = seen.distinct().select(F.col("k").alias(key), F.lit(True).alias(name))
        out = out.join(marks, key, "left").na.fill(False, [name])
    return out


def gold_report(rows: DataFrame, least: int = 20) -> DataFrame:
    """One row about :func:`gold_rows`, with ``gold_ready``."""
    flags = ("in_training", "jd_in_training", "resume_in_training", "jd_in_task", "resume_in_task")
    surplus = lambda c, named=True: F.count_if(F.col(c) != "" if named else F.lit(True)) - F.countDistinct(
        F.when(F.col(c) != "", F.col(c)) if named else F.col(c)
    )
    one = rows.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("status") == VERIFIED).alias("human_verified_rows"), F.count_if(F.size("errors") > 0).alias("invalid_rows"), surplus("id").alias("repeated_ids"),
        surplus("source_group").alias("repeated_source_groups"), surplus("pair_hash", False).alias("duplicate_pair_count"), *(F.count_if(f).alias(f"{f}_count") for f in flags),
        F.size(
            F.array_intersect(F.array_distinct(F.flatten(F.collect_set(F.filter("tags", lambda t: t.isin(*TAGS))))), F.array(*map(F.lit, TAGS)))
        ).alias("tags_seen"),
    )
    clean = ["invalid_rows", "repeated_ids", "repeated_source_groups", "duplicate_pair_count", *(f"{f}_count" for f in flags)]
    ok = (F.col("total_rows") >= least) & (F.col("human_verified_rows") == F.col("total_rows")) & (F.col("tags_seen") == len(TAGS))
    return one.withColumn("gold_ready", reduce(lambda a, c: a & (F.col(c) == 0), clean, ok))


#: What a set of candidates must hold: its size, the beginning of its ids, and tags of each group.
CANDIDATES, CANDIDATE_IDS, UNREVIEWED = (15, 20), "semantic_boundary_v2_", "needs_human_review"
TAG_GROUPS = {
    "ocr": ("OCR词内断开", "OCR误报控制"), "requirement_boundary": ("职责与要求边界", "职责要求重复", "加分项非硬门槛"), "direction": ("跨岗位方向",),
    "project": ("项目证据",),
}


def candidate_report(rows: DataFrame, others: DataFrame) -> DataFrame:
    """One row about candidate pairs (id, jd_text, resume_text, meta as JSON): its size, overlap with other pairs and problems."""
    key = compact_hash(F.col("jd_text"), F.col("resume_text"))
    meta = lambda k: F.get_json_object("meta", f"$.{k}")
    known = others.select(key.alias("k"), F.lit(True).alias("seen")).distinct()
    marked = rows.select(
        text_or_empty(F.col("id")).alias("id"), key.alias("k"), meta("annotation_status").alias("status"), meta("training_eligible").alias("eligible"),
        F.coalesce(F.from_json(meta("difficulty_tags"), "array<string>"), F.array().cast("array<string>")).alias("tags"),
    ).join(known, "k", "left")
    n = F.count(F.lit(1))
    tags = F.flatten(F.collect_set("tags"))
    lacking = F.array_compact(F.array(*(F.when(~F.arrays_overlap(F.col("tags"), F.array(*map(F.lit, ts))), F.lit(g)) for g, ts in TAG_GROUPS.items())))
    one = marked.agg(
        n.alias("row_count"), F.countDistinct("id").alias("ids"), F.count_if(~F.col("id").startswith(CANDIDATE_IDS)).alias("other_ids"),
        F.count_if(F.coalesce(F.col("status") != UNREVIEWED, F.lit(True))).alias("reviewed"), F.count_if(F.coalesce(F.col("eligible") != "false", F.lit(True))).alias("eligible"),
        F.countDistinct("k").alias("pairs"), F.countDistinct(F.when(F.col("seen"), F.col("k"))).alias("comparison_pair_overlap"), tags.alias("tags"),
    )
    rules = (
        (~F.col("row_count").between(*CANDIDATES), F.lit("candidate_count_must_be_15_to_20")),
        ((F.col("ids") < F.col("row_count")) | (F.col("other_ids") > 0), F.lit("ids_must_be_unique_v2_ids")),
        ((F.col("reviewed") > 0) | (F.col("row_count") == 0), F.lit("all_rows_must_need_human_review")),
        (F.col("eligible") > 0, F.lit("all_rows_must_be_training_ineligible")), (F.col("pairs") < F.col("row_count"), F.lit("duplicate_candidate_pairs")),
        (F.col("comparison_pair_overlap") > 0, F.lit("candidate_pair_overlaps_comparison_set")),
        (F.size(lacking) > 0, F.concat(F.lit("missing_difficulty_groups:"), F.array_join(lacking, ","))),
    )
    problems = F.array_compact(F.array(*(F.when(ok, text) for ok, text in rules)))
    return one.select("row_count", "comparison_pair_overlap", problems.alias("problems"), (F.size(problems) == 0).alias("audit_ok"))


def with_review_fields(rows: DataFrame, origin: str) -> DataFrame:
    """Rows of a candidate set, marked as not yet reviewed."""
    more = {"annotation_status": F.lit("pending_human_review"), "candidate_origin": F.lit(origin), "training_eligible": F.lit("false")}
    own = F.coalesce(F.from_json("meta", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.withColumn(
        "meta",
        F.to_json(F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*more)), F.create_map(*(x for k, c in more.items() for x in (F.lit(k), c)))))
    )


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of listed ids (id, pos), in their order; raises if one is missing."""
    out = ids.join(rows, "id", "left_semi")
    missing = ids.join(rows, "id", "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"no rows with ids {[r['id'] for r in missing]}")
    return out.join(rows, "id").orderBy("pos").drop("pos")


def level_of(score: Column) -> Column:
    return cascade([(score >= limit, F.lit(name)) for limit, name in matching.Policy().bands], F.lit(matching.Policy().lowest))
