"""Preference pairs: answers made worse in one way, explanations of match labels, and pairs of gold and predicted answers.

Answers are JSON texts of a task's fields; made answers have their keys in order. Null fields are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import strip, text_or_empty
from curatrix.operators.adverts import messages, prompt
from curatrix.operators.fields import cascade

#: The fields of the tasks' answers; lists, then texts.
FIELDS = {
    "jd_parse": (("核心职责", "必备技能", "加分项"), ("岗位方向", "经验要求", "学历要求")),
    "resume_parse": (("教育背景", "核心技能", "实习经历", "项目经历", "优势标签"), ("目标岗位",)),
    "match": (("匹配优势", "主要短板", "简历优化建议", "推荐投递岗位方向"), ("匹配结论",)),
}
#: A field no answer has, with its value, and directions taken for each other.
EXTRA_FIELD, EXTRA_VALUE = "岗位摘要", "候选输出中不应额外生成未约定字段"
MISTAKEN = {
    "前端开发": "后端开发", "后端开发": "前端开发", "算法工程": "AI应用开发", "AI应用开发": "算法工程", "测试开发": "后端开发", "AI Infra": "运维开发",
    "运维开发": "网络与基础设施", "网络与基础设施": "运维开发", "硬件研发": "嵌入式开发", "嵌入式开发": "硬件研发",
}
MISTAKEN_OTHERWISE = "后端开发"

Answer = dict[str, Column]


def fields_of(answer: Column, task: str) -> Answer:
    """The fields of a task's answer; null where the answer lacks one."""
    lists, texts = FIELDS[task]
    kinds = {**dict.fromkeys(lists, "array<string>"), **dict.fromkeys(texts, "string")}
    parsed = F.from_json(answer, ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
    return {k: parsed[k] for k in kinds}


def as_json(answer: Answer) -> Column:
    return F.to_json(F.struct(*(answer[k].alias(k) for k in sorted(answer))))


def _filled(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _without_last(name: str) -> Callable[[Answer], tuple[Column, Answer]]:
    return lambda a: (_filled(a[name]), a | {name: F.slice(a[name], F.lit(1), F.greatest(F.size(a[name]) - 1, F.lit(0)))})


def _first_into(source: str, target: str) -> Callable[[Answer], tuple[Column, Answer]]:
    return lambda a: (_filled(a[source]), a | {target: F.concat(F.coalesce(a[target], F.array().cast("array<string>")), F.slice(a[source], 1, 1))})


def _extra(a: Answer) -> tuple[Column, Answer]:
    return F.lit(True), a | {EXTRA_FIELD: F.lit(EXTRA_VALUE)}


def _other_direction(a: Answer) -> tuple[Column, Answer]:
    d = a["岗位方向"]
    return text_or_empty(d) != "", a | {"岗位方向": cascade([(d == k, F.lit(v)) for k, v in MISTAKEN.items()], F.lit(MISTAKEN_OTHERWISE))}


def _degree_as_years(a: Answer) -> tuple[Column, Answer]:
    both = F.concat(text_or_empty(a["经验要求"]), F.lit("；"), text_or_empty(a["学历要求"]))
    return text_or_empty(a["学历要求"]) != "", a | {"经验要求": F.regexp_replace(both, "^；+|；+$", "")}


def _swapped(a: Answer) -> tuple[Column, Answer]:
    return _filled(a["匹配优势"]) & _filled(a["主要短板"]), a | {"匹配优势": a["主要短板"], "主要短板": a["匹配优势"]}


#: Ways to make a task's answer worse, by name: (whether it applies, the worse answer).
WORSE = {
    "jd_parse": {
        "unexpected_field": _extra, "direction_mismatch": _other_direction, "responsibility_drop": _without_last("核心职责"),
        "responsibility_skill_leak": _first_into("核心职责", "必备技能"), "education_experience_mix": _degree_as_years,
    },
    "resume_parse": {
        "unexpected_field": _extra, "resume_strength_drop": _without_last("优势标签"), "resume_project_drop": _without_last("项目经历"),
        "resume_education_skill_leak": _first_into("教育背景", "核心技能"),
    },
    "match": {
        "unexpected_field": _extra, "match_gap_drop": _without_last("主要短板"), "match_strength_gap_swap": _swapped, "match_suggestion_drop": _without_last("简历优化建议"),
    },
}


def worse(answer: Column, task: str) -> Column:
    """All ways to make an answer worse as structs (strategy, json), null json where one doesn't apply."""
    own = fields_of(answer, task)
    made = ((name, *f(own)) for name, f in WORSE[task].items())
    return F.array(*(F.struct(F.lit(name).alias("strategy"), F.when(ok, as_json(a)).alias("json")) for name, ok, a in made))


def task_of(task: Column, answer: Column) -> Column:
    """The task of an answer, by its fields where it isn't told."""
    has = lambda key: F.get_json_object(answer, f"$.{key}").isNotNull()
    return F.when((task == "resume_parse") | has("目标岗位"), "resume_parse").when((task == "match") | has("匹配结论"), "match").otherwise("jd_parse")


def stable_index(ident: Column, n: int) -> Column:
    """A number below ``n`` from the digest of an id."""
    return F.conv(F.substring(F.sha1(ident), 1, 8), 16, 10).cast("long") % n


def bootstrap_preferences(rows: DataFrame) -> DataFrame:
    """(id, source_id, task_type, prompt, chosen, rejected, meta) of samples (id, task_type, messages): the answer against
    the first way to make it worse, counted from a number that the id gives, that applies and changes it."""
    answer = F.element_at("messages", -1)["content"]
    out = rows.withColumn("_task", task_of(F.coalesce("task_type", F.lit("jd_parse")), answer))

    def picked(task: str) -> Column:
        n, own = len(WORSE[task]), as_json(fields_of(answer, task))
        start = stable_index(F.col("id"), n).cast("int")
        turned = lambda ways: F.concat(F.slice(ways, start + 1, F.lit(n)), F.slice(ways, F.lit(1), start))
        return F.get(F.filter(turned(worse(answer, task)), lambda w: w["json"].isNotNull() & (w["json"] != own)), 0)

    def of_task(f) -> Column:
        return F.when(F.col("_task") == "resume_parse", f("resume_parse")).when(F.col("_task") == "match", f("match")).otherwise(f("jd_parse"))

    out = out.withColumns({"_worse": of_task(picked), "_chosen": of_task(lambda t: as_json(fields_of(answer, t)))}).filter("_worse is not null")
    said = lambda c: F.array(F.struct(F.lit("assistant").alias("role"), c.alias("content")))
    meta = F.struct(F.lit("synthetic_structured_hard_negative").alias("provenance"), F.col("_worse.strategy").alias("rejection_strategy"))
    return out.select(
        F.concat_ws("_", "id", "_worse.strategy").alias("id"), F.col("id").alias("source_id"), F.coalesce("task_type", F.lit("jd_parse")).alias("task_type"),
        F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"), said(F.col("_chosen")).alias("chosen"), said(F.col("_worse.json")).alias("rejected"), meta.alias("meta"),
    )


#: What explanations say.
CONCLUSIONS = {"高匹配": "候选人与岗位整体高度匹配，关键技能和基础要求基本覆盖。", "较匹配": "候选人与岗位整体较匹配，具备主要能力，但仍存在少量补齐空间。"}
POOR = "候选人与岗位匹配度有限，核心能力或基础条件存在明显缺口。"
GOOD_POINTS = ("求职方向与岗位方向一致", "学历背景满足岗位要求", "经验背景满足岗位要求")
BAD_POINTS = ("目标岗位方向与 JD 方向不一致", "学历条件与 JD 要求存在差距", "经验条件与 JD 要求存在差距")
HAS_SKILLS, HAS_PROJECTS, NO_POINTS = "已覆盖关键技能：", "项目经历提供直接岗位证据：", "已有简历信息可作为初步评估基础"
LACKS_SKILLS, NO_GAPS = "缺失关键技能：", "暂无明显硬性短板，后续可继续补充更量化的项目成果"
ADD_SKILLS, ADD_WORK, ADD_TARGET, GO_ON = "在简历中补充或强化以下技能证据：", "增加与岗位相关的项目、实习或工作经历描述", "明确简历目标岗位，并突出与目标方向一致的项目与技能", "保持当前简历结构，继续强化核心项目成果与量化结果"
NO_ROLE = "请补充明确的目标岗位"
MOST_SKILLS, MOST_PROJECTS = 6, 2
#: A label's fields.
LABEL = "`匹配等级` string, `岗位方向匹配` boolean, `学历匹配` boolean, `经验匹配` boolean, `命中技能` array<string>, `缺失技能` array<string>, `命中项目` array<string>"


def explanation(label: Column, advert_direction: Column, resume_direction: Column) -> Answer:
    """The explanation of a label, a struct of :data:`LABEL`."""
    none = F.array().cast("array<string>")
    flags = [F.coalesce(label[k], F.lit(False)) for k in ("岗位方向匹配", "学历匹配", "经验匹配")]
    matched, missing, projects = (F.coalesce(label[k], none) for k in ("命中技能", "缺失技能", "命中项目"))
    told = lambda text, items, n, by: F.when(F.size(items) > 0, F.concat(F.lit(text), F.array_join(F.slice(items, 1, n), by)))
    some = lambda parts, otherwise: F.get(
        F.transform(F.array(F.array_compact(F.array(*parts))), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(otherwise)))), 0
    )
    good = [F.when(ok, F.lit(t)) for ok, t in zip(flags, GOOD_POINTS, strict=True)] + [
        told(HAS_SKILLS, matched, MOST_SKILLS, "、"), told(HAS_PROJECTS, projects, MOST_PROJECTS, "；")
    ]
    bad = [F.when(~ok, F.lit(t)) for ok, t in zip(flags, BAD_POINTS, strict=True)] + [told(LACKS_SKILLS, missing, MOST_SKILLS, "、")]
    advice = [told(ADD_SKILLS, missing, MOST_SKILLS, "、"), F.when(~flags[2], F.lit(ADD_WORK)), F.when(~flags[0], F.lit(ADD_TARGET))]
    wanted, aimed = text_or_empty(advert_direction), text_or_empty(resume_direction)
    role = cascade([(flags[0] & (wanted != ""), wanted), (aimed != "", aimed), (wanted != "", wanted)], F.lit(NO_ROLE))
    return {
        "匹配结论": cascade([(label["匹配等级"] == k, F.lit(v)) for k, v in CONCLUSIONS.items()], F.lit(POOR)),
        "匹配优势": some(good, NO_POINTS), "主要短板": some(bad, NO_GAPS), "简历优化建议": some(advice, GO_ON), "推荐投递岗位方向": F.array(role),
    }


def match_samples(rows: DataFrame, normalized_hash: Callable[[Column], Column]) -> DataFrame:
    """Chat samples of pairs (id, jd_text, resume_text, label, meta as JSON); variants share their source's group and pairs
    the groups of their texts."""
    meta = lambda k: text_or_empty(F.get_json_object("meta", f"$.{k}"))
    answer = as_json_in_order(explanation(F.col("label"), meta("jd_direction"), meta("resume_direction")))
    group = F.when(F.col("id").endswith("_ocr"), F.regexp_replace("id", "_ocr$", "")).when(
        F.col("id").rlike("^synthetic_match_.*_[0-9]+$"), F.regexp_replace("id", "_[0-9]+$", "")
    ).otherwise(F.col("id"))
    if "source_group" in rows.columns:
        group = F.when(text_or_empty(F.col("source_group")) != "", F.col("source_group")).otherwise(group)
    entity = lambda k, c: F.when(meta(k) != "", meta(k)).otherwise(normalized_hash(F.col(c)))
    asked = prompt(F.lit("match"), F.col("jd_text"), F.col("resume_text"), F.to_json("label"))
    linked = F.array(
        F.concat(F.lit("match_jd:"), entity("jd_entity_hash", "jd_text")),
        F.concat(F.lit("match_resume:"), entity("resume_entity_hash", "resume_text"))
    )
    return rows.select(
        "id", F.lit("match").alias("task_type"), group.alias("source_group"), linked.alias("linked_source_groups"),
        F.to_json(F.struct(meta("entity_split").alias("entity_split"))).alias("meta"), messages(asked, answer).alias("messages")
    )


def as_json_in_order(answer: Answer) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in answer.items())))


def mismatch_preferences(rows: DataFrame) -> DataFrame:
    """Preferences of predictions (id, task, text, resume_text, label, parsed, prediction; answers as JSON) that differ from
    their gold answer; for matches the answers are explanations, the predicted one from ``rule_result`` where ``analysis``
    is empty."""
    canonical = lambda c, t: F.when(text_or_empty(c) != "", as_json(fields_of(c, t)))
    said = lambda c: F.array(F.struct(F.lit("assistant").alias("role"), c.alias("content")))
    own = lambda n: text_or_empty(F.col(n)) if n in rows.columns else F.lit("")
    is_match = F.col("task") == "match"
    of_label = lambda c: as_json(explanation(F.from_json(c, LABEL), F.lit(""), F.lit("")))
    chosen = F.when(is_match, of_label(own("label"))).when(
        F.col("task") == "resume_parse", canonical(own("label"), "resume_parse")
    ).otherwise(canonical(own("label"), "jd_parse"))
    plain = F.when(F.col("task") == "resume_parse", canonical(own("parsed"), "resume_parse")).otherwise(canonical(own("parsed"), "jd_parse"))
    rejected = F.when(
        is_match, F.coalesce(canonical(own("analysis"), "match"), F.when(own("rule_result") != "", of_label(own("rule_result"))))
    ).otherwise(F.coalesce(plain, F.nullif(strip(own("prediction")), F.lit(""))))
    out = rows.withColumns({"_chosen": chosen, "_rejected": rejected}).filter("_chosen is not null and _rejected is not null and _chosen <> _rejected")
    asked = prompt(F.col("task"), own("text"), own("resume_text"), own("label"))
    meta = F.struct(
        F.when(is_match, "match_eval_prediction_mismatch").otherwise("eval_prediction_mismatch").alias("provenance"),
        F.when(is_match, "match_analysis_mismatch").otherwise("prediction_mismatch").alias("rejection_strategy")
    )
    return out.select(
        "id", F.col("task").alias("task_type"), F.slice(messages(asked, F.lit("")), 1, 2).alias("prompt"), said(F.col("_chosen")).alias("chosen"),
        said(F.col("_rejected")).alias("rejected"), meta.alias("meta")
    )


def audit(rows: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row about preferences (split, id, source_id, prompt, chosen, rejected, meta) and held-out ids: counts of splits,
    rows that are invalid, ids that repeat, pairs that are equal, prompts in both splits, held-out sources, and origin."""
    content = lambda c: F.when(F.size(c) == 1, strip(text_or_empty(F.get(c, 0)["content"]))).otherwise("")
    marked = rows.select(
        "split", "id", F.coalesce("source_id", "id").alias("source_id"), F.sha1(F.to_json("prompt")).alias("p"), content(F.col("chosen")).alias("c"),
        content(F.col("rejected")).alias("r"), F.size("prompt").alias("n"), "meta"
    )
    good = (F.col("n") > 0) & F.try_parse_json("c").isNotNull() & F.try_parse_json("r").isNotNull() & (F.col("c") != "") & (F.col("r") != "")
    marked = marked.withColumn("good", F.coalesce(good & F.col("id").isNotNull(), F.lit(False)))
    held = marked.join(holdout.select(F.col("id").alias("source_id"), F.lit(1).alias("held")).distinct(), "source_id", "left")
    one = held.agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "valid").alias("valid"), F.count_if(~F.col("good")).alias("invalid_rows"),
        (
            F.count_if("good") - F.countDistinct(F.when(F.col("good"), F.col("id")))
        ).alias("duplicate_ids"), F.count_if(F.col("good") & (F.col("c") == F.col("r"))).alias("chosen_equals_rejected"),
        F.count_if(F.col("good") & (F.col("held") == 1)).alias("holdout_overlap"), F.countDistinct(F.when(F.col("good"), F.col("p"))).alias("unique_prompts"),
        F.count_if(F.col("good") & F.col("meta.provenance").contains("synthetic")).alias("synthetic_rows"), F.count_if("good").alias("good_rows"),
    )
    # Rows after the first split of their prompt count, as many as lie in another split.
    first = marked.filter("good").groupBy("p").agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "valid").alias("v"))
    crossing = first.agg(F.coalesce(F.sum(F.when((F.col("t") > 0), F.col("v")).otherwise(0)), F.lit(0)).cast("long").alias("x"))
    out = one.withColumn("cross_split_prompt_hashes", crossing.scalar())
    share = F.coalesce(F.round(F.try_divide(F.col("synthetic_rows"), F.col("good_rows")), 4), F.lit(0.0))
    origin = F.when(
        (F.col("good_rows") > 0) & (F.col("synthetic_rows") == F.col("good_rows")), "synthetic_only"
    ).when(F.col("synthetic_rows") > 0, "mixed").otherwise("non_synthetic_or_unknown")
    ready = (F.col("invalid_rows") == 0) & (F.col("duplicate_ids") == 0) & (F.col("chosen_equals_rejected") == 0) & (F.col("cross_split_prompt_hashes") == 0) & (F.col("holdout_overlap") == 0)
    out = out.withColumns({"synthetic_preference_rate": share, "preference_origin": origin, "format_ready": ready})
    reach = lambda t, v: F.col("format_ready") & (F.col("train") >= t) & (F.col("valid") >= v)
    return out.withColumns({"ready_for_dpo_smoke": reach(50, 10), "ready_for_dpo": reach(1000, 100)})
