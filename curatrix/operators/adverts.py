"""Normalised adverts, the chat samples made of them, and pools of rows from several origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import fields, sections, tiers
from curatrix.operators.pairing import known_skills
from curatrix.operators.selection import hash_order

#: The prompts of the tasks.
SYSTEM = "你是一个招聘文本解析助手。请严格基于输入内容输出 JSON，不要编造输入中没有的信息。"
ADVERT_PROMPT = "请解析以下招聘 JD，抽取岗位方向、核心职责、必备技能、加分项、经验要求和学历要求。\n只输出 JSON，不要输出解释。\n\nJD：\n"
RESUME_PROMPT = "请解析以下简历，抽取候选人的目标岗位、教育背景、核心技能、实习经历、项目经历和优势标签。\n只输出 JSON，不要输出解释。\n\n简历：\n"
MATCH_PROMPT = "请根据 JD、简历和规则评分结果生成岗位匹配分析。\n只输出 JSON，固定包含匹配结论、匹配优势、主要短板、简历优化建议、推荐投递岗位方向五个字段。匹配结论是字符串，其余字段是字符串列表。不要增加字段，不要编造输入中没有的信息。\n\n"
#: Fixed value: sources whose sections may be swapped.
SWAPPED = "^(?:hf_job_educational|hf_)"


def normalized(rows: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Normalised adverts of raw ones (id, source, job_title, company, location, raw_text, html, meta as JSON).

    Columns that ``rows`` lacks count as null. The years are those of the text, else of ``meta``, else of a former label.
    Each row is worked out by itself, in one projection.
    """
    own = lambda n: T.text_or_empty(F.col(n).cast("string")) if n in rows.columns else F.lit("")
    raw = F.when(own("raw_text") != "", own("raw_text")).otherwise(own("html"))
    meta = F.when(F.try_parse_json(own("meta")).isNotNull(), own("meta")).otherwise("{}")
    at = lambda key: T.text_or_empty(F.get_json_object(meta, f"$.{key}"))
    former = F.col("labels.experience") if "labels" in rows.columns else F.lit("")
    out = rows.select(
        F.col("id"), F.col("id").alias("raw_id"), own("job_title").alias("job_title"), F.when(own("source") != "", own("source")).otherwise(at("source")).alias("source"), own("company").alias("company"),
        own("location").alias("location"), own("salary").alias("salary"), T.clean(raw).alias("clean_text"), meta.alias("meta"), T.strip(T.text_or_empty(former)).alias("_former"),
    )
    years = fields.experience(F.col("clean_text"))
    of_meta = fields.experience_of_meta(F.col("meta"))
    labels = F.struct(
        fields.direction(F.col("job_title"), F.col("clean_text")).alias("direction"), known_skills(F.col("clean_text"), vocabulary).alias("skills"),
        F.when(years != "", years).when(of_meta != "", of_meta).otherwise(F.col("_former")).alias("experience"), fields.degree(F.col("clean_text")).alias("education"),
    )
    parts = sections.unswapped(sections.inline_sections(F.col("clean_text")), F.col("source").rlike(SWAPPED))
    ready = F.coalesce(F.get_json_object("meta", "$.sft_ready"), F.lit("true"))
    return out.select(
        "*", parts.alias("sections"), labels.alias("labels"), T.text_or_empty(F.get_json_object("meta", "$.language")).alias("language"),
        (~ready.isin("false", "0", "", "null")).alias("sft_ready")
    ).drop("_former")


def input_text(title: Column, company: Column, location: Column, text: Column) -> Column:
    """The text with title, company and place above it where its beginning does not name them."""
    x = T.strip(T.text_or_empty(text))
    line = lambda label, value, word, n: F.when(
        (T.strip(T.text_or_empty(value)) != "") & ~F.substring(x, 1, n).contains(word), F.concat(F.lit(label), T.strip(value))
    )
    return F.concat_ws("\n", line("岗位名称：", title, "岗位名称", 80), line("公司：", company, "公司", 120), line("工作地点：", location, "工作地点", 120), F.when(x != "", x))


def messages(prompt: Column, answer: Column) -> Column:
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(said("system", F.lit(SYSTEM)), said("user", prompt), said("assistant", answer))


def prompt(task: Column, text: Column, resume: Column, result: Column) -> Column:
    """The prompt of a task; null for an unknown one."""
    match = F.concat(F.lit(MATCH_PROMPT + "JD：\n"), text, F.lit("\n\n简历：\n"), resume, F.lit("\n\n规则评分结果：\n"), result)
    return F.when(task == "jd_parse", F.concat(F.lit(ADVERT_PROMPT), text)).when(
        task == "resume_parse", F.concat(F.lit(RESUME_PROMPT), text)
    ).when(task == "match", match)


def advert_answer(direction: Column, duties: Column, skills: Column, bonus: Column, years: Column, degree: Column) -> Column:
    """The JSON answer to an advert."""
    return F.to_json(
        F.struct(direction.alias("岗位方向"), duties.alias("核心职责"), skills.alias("必备技能"), bonus.alias("加分项"), years.alias("经验要求"), degree.alias("学历要求"))
    )


def _else(a: Column, b: Column) -> Column:
    return F.when(T.text_or_empty(a) != "", a).otherwise(b)


def advert_samples(rows: DataFrame) -> DataFrame:
    """(id, task_type, source_group, meta, messages) of normalised adverts."""
    x, answer = F.col("clean_text"), _answer_of_row()
    user = F.concat(F.lit(ADVERT_PROMPT), input_text(F.col("job_title"), F.col("company"), F.col("location"), x))
    added = {k: F.when((F.col(k) != "") & F.get_json_object("meta", f"$.{k}").isNull(), F.col(k)) for k in ("source", "company", "location")}
    meta = F.map_concat(
        F.coalesce(F.from_json("meta", "map<string,string>"), F.create_map().cast("map<string,string>")),
        F.map_filter(F.create_map(*(x for k, v in added.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    )
    group = F.coalesce(F.col("source_group"), F.col("id")) if "source_group" in rows.columns else F.col("id")
    return rows.select(
        F.concat("id", F.lit("_jd_parse")).alias("id"), F.lit("jd_parse").alias("task_type"), group.cast("string").alias("source_group"),
        F.to_json(meta).alias("meta"), messages(user, answer).alias("messages")
    )


def multilingual_samples(rows: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Samples of weak rows: English ones need one direction and two duties, others a direction and a duty."""
    x, english = F.col("clean_text"), F.col("language") == "en"
    head = lambda s: F.slice(fields.duties(F.col(f"sections.{s}")), 1, fields.DUTIES)
    rows = rows.filter(tiers.is_candidate())
    named = F.when(english, fields.english_direction(F.col("job_title"), x)).otherwise(T.text_or_empty(F.col("labels.direction")))
    listed = F.when(english, fields.main_duties(F.col("sections.responsibilities"), x)).otherwise(head("responsibilities"))
    rows = rows.withColumns({"_named": named, "_duties": listed}).filter((F.col("_named") != "") & (F.size("_duties") >= F.when(english, 2).otherwise(1)))
    none = F.array().cast("array<string>")
    answer = advert_answer(
        F.col("_named"), F.col("_duties"), F.when(english, known_skills(x, vocabulary)).otherwise(F.coalesce("labels.skills", none)), F.when(english, none).otherwise(head("bonus")),
        F.when(english, fields.english_experience(x)).otherwise(
            _else(F.col("labels.experience"), fields.experience(x))
        ), F.when(english, fields.english_degree(x)).otherwise(_else(F.col("labels.education"), fields.degree(x))),
    )
    user = F.concat(F.lit(ADVERT_PROMPT), input_text(F.col("job_title"), F.col("company"), F.col("location"), x))
    return rows.select(F.concat("id", F.lit("_jd_parse")).alias("id"), F.lit("jd_parse").alias("task_type"), messages(user, answer).alias("messages"))


def with_meta(meta: Column, **values: Column) -> Column:
    """A JSON object with further values; those given replace those it has."""
    own = F.map_filter(F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*values))
    return F.to_json(F.map_concat(own, F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))))


POOL = ("id", "source", "job_title", "company", "location", "salary", "raw_text", "meta")


def pool_rows(rows: DataFrame, origin: str, **more: Column) -> DataFrame:
    """Normalised rows in the shape of pools, with their origin."""
    raw = _else(F.col("clean_text"), F.col("raw_text") if "raw_text" in rows.columns else F.lit(""))
    meta = with_meta(F.col("meta"), language=F.col("language"), sft_ready=F.col("sft_ready"), pool_origin=F.lit(origin), **more)
    return rows.select("id", *(T.text_or_empty(F.col(c)).alias(c) for c in POOL[1:6]), raw.alias("raw_text"), meta.alias("meta"))


def manual_pool(rows: DataFrame) -> DataFrame:
    return pool_rows(rows.filter(tiers.is_strict()), "strict_manual")


def repairable_pool(rows: DataFrame) -> DataFrame:
    """Repairable rows with what was wrong and what mends it."""
    more = {
        "repair_reason": tiers.repair_reason(), "repaired_direction": tiers.row_direction(), "repair_has_education": tiers.filled("labels.education") != "",
        "repair_has_experience": tiers.filled("labels.experience") != "", "repair_has_skills": tiers.has_skills(),
    }
    return once(pool_rows(rows.filter(tiers.is_repairable()), "repairable_candidate", **more))


def weak_structured_pool(rows: DataFrame) -> DataFrame:
    return once(pool_rows(rows.filter(tiers.is_weak_structured()), "weak_structured_candidate"))


def supplemental_pool(rows: DataFrame) -> DataFrame:
    """Weak rows of other sources that may be used and have a direction."""
    fit = ~F.coalesce(F.col("source").isin(*tiers.TRUSTED_SOURCES), F.lit(False)) & tiers.training_allowed() & (tiers.filled("labels.direction") != "")
    return once(pool_rows(rows.filter(fit).filter(tiers.is_weak()), "supplemental_weak_high_conf"))


def training_rows(rows: DataFrame, *, weak: bool = False, total: int | None = None, seed: str = "42", strict: bool = True) -> DataFrame:
    """Strict rows, or all that are ready, and with ``weak`` the weak ones that aren't among them: all without ``total``, else as
    many as it lacks, in hash order."""
    marked = rows.withColumns({"_strong": tiers.is_strict() if strict else F.coalesce("sft_ready", F.lit(True)), "_weak": tiers.is_weak()})
    if not weak:
        return marked.filter("_strong").drop("_strong", "_weak")
    rank = F.struct((~F.col("_strong")).alias("late"), F.when(F.col("_strong"), "").otherwise(hash_order(seed, F.col("id"))).alias("h"), F.col("id"))
    fit = marked.filter("_strong or _weak").withColumn("_order", rank)
    if total is not None:
        few = max(total, fit.filter("_strong").count())
        fit = fit.orderBy("_order").limit(few)
    return fit.drop("_strong", "_weak", "_order")


def public_pool(rows: DataFrame) -> DataFrame:
    return once(rows.filter(tiers.is_usable_public()).select(*POOL))


def pool_key() -> Column:
    """The key by which pool rows are the same: title, company, place and the beginning of the text."""
    own = [T.strip(T.text_or_empty(F.col(c))) for c in ("job_title", "company", "location")]
    return F.sha1(F.concat_ws("\n", *own, F.substring(T.strip(T.text_or_empty(F.col("raw_text"))), 1, 500)))


def once(rows: DataFrame, *order: str) -> DataFrame:
    """The first row, by ``order`` and id, of each key."""
    best = F.struct(*order, "id")
    return rows.groupBy(pool_key().alias("_key")).agg(F.min_by(F.struct(*rows.columns), best).alias("row")).select("row.*")


def combined_pool(manual: DataFrame, public: DataFrame, supplemental: DataFrame | None = None, weak_structured: DataFrame | None = None) -> DataFrame:
    """Pools in order of trust; of the same rows that of the first pool stays. Rows of later pools name their origin."""
    from curatrix.sources.store import shared_copy

    # Written, since plans of normalised rows are large and the parts together would hold them many times over.
    named = lambda df, origin, always: shared_copy(df, "pool").select(
        *POOL[:-1],
        with_meta(F.col("meta"), pool_origin=F.lit(origin) if always else F.coalesce(F.get_json_object("meta", "$.pool_origin"), F.lit(origin))).alias("meta")
    )
    parts = [shared_copy(manual_pool(shared_copy(manual, "normalized")), "pool")]
    parts += [named(supplemental, "supplemental_candidate", False)] if supplemental is not None else []
    parts += [named(weak_structured, "weak_structured_candidate", False)] if weak_structured is not None else []
    parts += [named(public, "public_candidate", True)]
    ranked = [p.withColumn("rank", F.lit(i)) for i, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p)
    return once(out, "rank").drop("rank")


def quality_dataset(
    strict: DataFrame, candidates: DataFrame, vocabulary: dict[str, list[str]], total: int, *, excluded: DataFrame | None = None,
    max_weak_rate: float = 0.4, seed: str = "42"
) -> DataFrame:
    """Normalised rows of the tiers in turn, with ``tier``, ``risk_reasons``, ``risk`` and ``quality``.

    Stages: strict rows, strict_plus, bootstrap rows with years (250 at most), quality_weak, and the other bootstrap rows.
    ``candidates`` are raw rows that are normalised again; external ones need leave.
    """
    from curatrix.sources.store import shared_copy

    # Written, since several stages read them and each would work out all fields again.
    again = shared_copy(normalized(candidates.filter(tiers.training_allowed()), vocabulary), "normalized")
    clean = shared_copy(tiers.sanitized(again), "sanitized")
    first = tiers.sanitized(strict.filter(tiers.is_strict()))
    names = ["id", "source", "job_title", "company", "location", "clean_text", "sections", "labels", "meta", "language", "sft_ready"]
    with_years = F.col("labels.experience") != ""
    boot = again.filter(tiers.worth_bootstrapping())
    stages = [
        (first, "strict"), (
            tiers.sanitized(again.filter(tiers.is_strict_plus())), "strict_plus"
        ), (boot.filter(with_years), "bootstrap"), (clean.filter(tiers.is_quality_weak()), "quality_weak"), (boot.filter(~with_years), "bootstrap"),
    ]
    every = None
    for i, (df, tier) in enumerate(stages):
        part = df.select(*names, F.lit(i).alias("stage"), F.lit(tier).alias("tier"))
        every = part if every is None else every.unionByName(part)
    every = shared_copy(every, "stages")
    asked = F.concat(F.lit(ADVERT_PROMPT), input_text(F.col("job_title"), F.col("company"), F.col("location"), F.col("clean_text")))
    every = every.withColumn("risk_reasons", tiers.risk_reasons(_answer_of_row(), asked, F.col("tier"), F.col("source")))
    every = shared_copy(every, "risks").withColumns(
        {
            "risk": tiers.risk_score(F.col("risk_reasons")), "experience": F.col("labels.experience"),
            "weak": F.lower(tiers.of_meta("intended_usage")) == tiers.WEAK_USAGE
        }
    )
    chosen = tiers.select_tiers(every, total, max_weak_rate=max_weak_rate, excluded=excluded, stage_limits={2: 250}, seed=seed)
    return chosen.withColumn("quality", tiers.quality_score(F.col("tier"), F.col("risk"))).drop("experience", "stage")


def _answer_of_row() -> Column:
    x = F.col("clean_text")
    head = lambda s: F.slice(fields.duties(F.col(f"sections.{s}")), 1, fields.DUTIES)
    skills = F.when(tiers.has_skills(), F.col("labels.skills")).otherwise(known_skills(x, tiers.BASIC_SKILLS))
    return advert_answer(
        tiers.row_direction(), head("responsibilities"), skills, head("bonus"), _else(F.col("labels.experience"), fields.experience(x)),
        _else(F.col("labels.education"), fields.degree(x))
    )
