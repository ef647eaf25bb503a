"""Parsed answers of models normalised: values in their fields, lists without repeats, canonical skills, directions and tags.

An answer is a JSON text whose values may be texts, lists or objects; its kinds are read as variants, so no shape fails. Results
are structs of the task's fields. Vocabularies and aliases are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.json_text import repaired
from curatrix.functions.text import lines, strip, text_or_empty
from curatrix.operators import fields
from curatrix.operators.pairing import canonical_skills, skill_evidence, squeezed

#: How lines begin that belong to another field, headings that end duties, and names of directions.
AS_DEMAND, AS_BONUS, AS_YEARS, AS_DEGREE = "任职要求|岗位要求|职位要求|任职资格", "加分项|优先考虑|优先", "经验要求|工作经验", "学历要求|学历"
AFTER_DUTIES = r"\n(?:任职要求|岗位要求|职位要求|任职资格|经验要求|工作经验|学历要求|学历)[：:]"
NUMBERED = r"^[0-9]+\.|^[一二三四五六七八九十]+[、.]"
RENAMED = {"ai开发": "AI应用开发", "ai应用": "AI应用开发", "ai应用开发": "AI应用开发", "大模型开发": "大模型应用开发", "大模型应用": "大模型应用开发", "大模型应用开发": "大模型应用开发"}
DIRECTIONS = (
    "AI应用开发", "大模型应用开发", "后端开发", "算法工程", "数据开发", "前端开发", "客户端开发", "嵌入式开发", "硬件研发", "网络与基础设施", "AI Infra", "高性能计算", "汽车软件/智驾研发", "运维开发", "安全工程",
    "测试开发", "产品经理"
)
#: What stands around a tag.
TAG_PARTS, TAG_START, TAG_END = "[、,，]|和|与", "^(?:熟悉|具备|擅长|关注|有|能独立完成)", "(?:能力强|能力|覆盖全面|[。！？.!?])+$"
ENDED = "[。！？.!?]$"
_NONE = "array<string>"


def none() -> Column:
    return F.array().cast(_NONE)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def at(answer: Column, key: str) -> Column:
    """A value of an answer, a JSON text, as a variant."""
    return F.try_variant_get(F.try_parse_json(answer), f"$.{key}", "variant")


def _one(raw: Column, kind: Column) -> Column:
    """The texts of one value, given as JSON and its kind: those of an object in one line and in its order, those of a list
    each, any other as it is."""
    values = F.filter(F.transform(F.map_values(F.from_json(raw, "map<string,string>")), squeezed), lambda x: x != "")
    inside = F.transform(F.from_json(raw, _NONE), squeezed)
    return F.when(
        kind.startswith("OBJECT"), F.array(F.array_join(values, "，"))
    ).when(kind.startswith("ARRAY"), inside).when(kind == "VOID", none()).otherwise(F.array(squeezed(raw)))


def texts(answer: Column, key: str) -> Column:
    """All texts of a field, lists within its list too, none empty."""
    v, raw = at(answer, key), F.get_json_object(answer, f"$.{key}")
    kinds = F.transform(F.try_variant_get(v, "$", "array<variant>"), _kind)
    listed = F.flatten(F.zip_with(F.from_json(raw, _NONE), kinds, lambda x, k: F.coalesce(_one(x, k), none())))
    every = F.when(_kind(v).startswith("ARRAY"), listed).otherwise(_one(raw, _kind(v)))
    return F.filter(F.coalesce(every, none()), lambda x: text_or_empty(x) != "")


def rows_of(answer: Column, key: str, other: str | None = None) -> Column:
    """The items of a list, or the lines of a text; those of the other field where there are none."""
    v = at(answer, key)
    split = F.transform(lines(F.try_variant_get(v, "$", "string")), squeezed)
    found = F.when(_kind(v).startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", _NONE), squeezed)).when(_kind(v) == "STRING", split)
    out = F.filter(F.coalesce(found, none()), lambda x: x != "")
    return out if other is None else F.when(F.size(out) > 0, out).otherwise(rows_of(answer, other))


def text(answer: Column, key: str) -> Column:
    return squeezed(F.try_variant_get(F.try_parse_json(answer), f"$.{key}", "string"))


def duties_of(context: Column) -> Column:
    """The numbered lines below the heading of duties."""
    below = F.regexp_replace(F.regexp_replace(text_or_empty(context), "(?s)^.*?岗位职责", ""), r"(?U)^[：:\s]*", "")
    part = F.get(F.split(below, AFTER_DUTIES, 2), 0)
    return F.when(text_or_empty(context).contains("岗位职责"), F.filter(fields.bullets(part), lambda x: x.rlike(NUMBERED))).otherwise(none())


def with_missing(own: Column, context: Column) -> Column:
    """The lines with those of the context that they lack, where they agree with its beginning."""

    def of(s: Column) -> Column:
        mine, stated = F.transform(s["o"], strip), F.transform(s["c"], strip)
        lacking = F.filter(s["c"], lambda x: ~F.array_contains(mine, strip(x)))
        same = F.zip_with(mine, stated, lambda a, b: F.coalesce(a == b, F.lit(False)))
        prefix = F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(0))
        agreed = F.when(F.array_position(same, F.lit(False)) == 0, F.size(same)).otherwise(prefix)
        add = (F.size(s["o"]) > 0) & (F.size(lacking) > 0) & (agreed >= F.least(F.size(s["o"]), F.lit(2)))
        return fields.unique_texts(F.when(add, F.concat(s["o"], lacking)).otherwise(s["o"]))

    return F.get(F.transform(F.array(F.struct(own.alias("o"), duties_of(context).alias("c"))), of), 0)


def _first(items: Column, f) -> Column:
    """The first value other than empty of a function of the items."""
    return F.coalesce(F.get(F.filter(F.transform(items, f), lambda x: x != ""), 0), F.lit(""))


def _or(*options: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in options), F.lit(""))


def advert(json: Column, context: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The answer to an advert: lines that belong to another field moved, missing numbered duties added, skills as far as
    there is evidence that they are required, years and degree from wherever they are told, and the canonical direction."""
    v = text_or_empty(json)
    starts = lambda x, p: x.rlike(f"^(?:{p})")
    rest = lambda p: (lambda x: strip(F.regexp_replace(x, f"^(?:{p})[：: ]*", "")))

    def moved(s: Column) -> Column:
        duties = s["duties"]
        only = lambda p: F.filter(duties, lambda x: starts(x, p))
        own = F.filter(duties, lambda x: ~starts(x, "|".join((AS_DEMAND, AS_BONUS, AS_YEARS, AS_DEGREE))))
        demands = F.concat(s["demands"], F.transform(only(AS_DEMAND), rest(AS_DEMAND)))
        not_demand = lambda p: F.filter(duties, lambda x: starts(x, p) & ~starts(x, AS_DEMAND))
        years = _or(s["years"], _first(not_demand(AS_YEARS), fields.experience), _first(demands, fields.experience))
        degree = _or(s["degree"], _first(not_demand(AS_DEGREE), fields.degree), _first(demands, fields.degree))
        return F.struct(
            with_missing(own, s["context"]).alias("duties"), demands.alias("demands"), F.concat(
                s["bonus"], F.transform(not_demand(AS_BONUS), rest(AS_BONUS))
            ).alias("bonus"), s["skills"].alias("skills"),
            years.alias("years"), degree.alias("degree"), s["direction"].alias("direction"), s["context"].alias("context"),
        )

    def whole(s: Column) -> Column:
        told = F.array_join(F.concat(s["duties"], s["demands"], s["bonus"], s["skills"], F.array(s["context"])), "\n")
        duties, demands, bonus = (fields.unique_texts(s[k]) for k in ("duties", "demands", "bonus"))
        known = canonical_skills(s["skills"], vocabulary)
        evidence = skill_evidence(vocabulary, demands, duties, bonus, s["context"], known)
        required = F.transform(F.filter(evidence, lambda e: e["required"]), lambda e: e["skill"])
        around = F.concat_ws("\n", F.nullif(s["context"], F.lit("")), F.nullif(F.array_join(F.concat(duties, demands, required), "\n"), F.lit("")))
        key = F.lower(F.regexp_replace(s["direction"], r"(?U)\s+", ""))
        named = fields.cascade([(key == k, F.lit(n)) for k, n in RENAMED.items()], s["direction"])
        return F.struct(
            fields.canonical_direction(named, around).alias("岗位方向"), duties.alias("核心职责"), demands.alias("任职要求"), required.alias("必备技能"), evidence.alias("技能证据"), bonus.alias("加分项"),
            squeezed(_or(s["years"], fields.experience(told))).alias("经验要求"), squeezed(_or(s["degree"], fields.degree(told))).alias("学历要求"),
        )

    parts = F.struct(
        rows_of(v, "核心职责").alias("duties"), rows_of(v, "任职要求", "岗位要求").alias("demands"), rows_of(v, "加分项").alias("bonus"), rows_of(v, "必备技能", "核心技能").alias("skills"),
        text(v, "经验要求").alias("years"), text(v, "学历要求").alias("degree"), text(v, "岗位方向").alias("direction"), text_or_empty(context).alias("context"),
    )
    return F.when(F.try_parse_json(v).isNotNull(), F.get(F.transform(F.transform(F.array(parts), moved), whole), 0))


def tags(items: Column, aliases: dict[str, list[str]]) -> Column:
    """Strengths as short tags by their canonical names."""
    known = {"".join(a.split()).lower(): name for name, others in aliases.items() for a in (name, *others)}
    parts = F.flatten(F.transform(items, lambda x: F.split(x, TAG_PARTS)))
    short = F.transform(parts, lambda x: F.regexp_replace(strip(F.regexp_replace(strip(F.regexp_replace(x, TAG_START, "")), TAG_END, "")), r"(?U)\s+", ""))
    look = lambda x: F.coalesce(F.try_element_at(F.create_map(*(F.lit(y) for p in known.items() for y in p)), F.lower(x)), x) if known else x
    return fields.unique_texts(F.transform(short, look))


def resume(json: Column, context: Column, vocabulary: dict[str, list[str]], aliases: dict[str, list[str]] | None = None) -> Column:
    """The answer to a résumé: lists without repeats, canonical skills and direction, projects as sentences, short tags."""
    v = text_or_empty(json)
    named = text(v, "目标岗位")
    compact = F.lower(F.regexp_replace(named, r"(?U)\s+", ""))
    listed = fields.cascade([(compact.isin("".join(d.split()).lower(), "".join(d.split()).lower() + "工程师"), F.lit(d)) for d in DIRECTIONS], F.lit(""))
    around = F.when(text_or_empty(context) != "", context).otherwise(named)
    direction = F.when(named == "", "").otherwise(_or(listed, fields.canonical_direction(named, around), named))
    projects = fields.unique_texts(F.flatten(F.transform(texts(v, "项目经历"), lambda x: F.split(x, r"[；;]\s*"))))
    sentences = F.transform(projects, lambda x: F.when(x.rlike(ENDED), x).otherwise(F.concat(x, F.lit("。"))))
    out = F.struct(
        direction.alias("目标岗位"), fields.unique_texts(texts(v, "教育背景")).alias("教育背景"), canonical_skills(texts(v, "核心技能"), vocabulary, keep_unknown=True).alias("核心技能"),
        fields.unique_texts(texts(v, "实习经历")).alias("实习经历"), sentences.alias("项目经历"), tags(texts(v, "优势标签"), aliases or {}).alias("优势标签"),
    )
    return F.when(F.try_parse_json(v).isNotNull(), out)


def match(json: Column) -> Column:
    """The explanation of a match: its fields as texts and lists without repeats."""
    v = text_or_empty(json)
    out = F.struct(text(v, "匹配结论").alias("匹配结论"), *(fields.unique_texts(texts(v, k)).alias(k) for k in ("匹配优势", "主要短板", "简历优化建议", "推荐投递岗位方向")))
    return F.when(F.try_parse_json(v).isNotNull(), out)


def task_of(json: Column) -> Column:
    """Whether an answer is one to a résumé, a match or an advert."""
    v = text_or_empty(json)
    has = lambda *keys: sum(((at(v, k).isNotNull()).cast("int") for k in keys), F.lit(0)) > 0
    return F.when(has("目标岗位", "教育背景"), "resume_parse").when(has("匹配结论", "匹配优势", "主要短板"), "match").when(F.try_parse_json(v).isNotNull(), "jd_parse")


def normalized(said: Column, context: Column, vocabulary: dict[str, list[str]], aliases: dict[str, list[str]] | None = None) -> Column:
    """What a model said, repaired and normalised by its kind, as JSON; null where it can't be read."""
    json = repaired(said)
    kind = task_of(json)
    return F.when(
        kind == "resume_parse", F.to_json(resume(json, context, vocabulary, aliases))
    ).when(kind == "match", F.to_json(match(json))).when(kind == "jd_parse", F.to_json(advert(json, context, vocabulary)))
