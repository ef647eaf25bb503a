"""Résumés: texts normalised and rendered by section, renderings of labels, noisy forms, samples, pools and pairs with adverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.text import lines, strip, text_or_empty
from curatrix.functions.values import normalized_hash
from curatrix.operators import fields
from curatrix.operators.adverts import RESUME_PROMPT, messages
from curatrix.operators.pairing import known_skills, score_pairs
from curatrix.operators.privacy import for_training
from curatrix.operators.sections import RESUME, line_sections
from curatrix.operators.selection import hash_order

#: Titles of sections in the order in which they are rendered; the first has none.
TITLES = {
    "header": "基础信息", "education": "教育背景", "skills": "核心技能", "internships": "实习经历", "projects": "项目经历", "work": "工作经历", "awards": "奖项证书",
    "profile": "个人优势"
}
#: A résumé's label; the names are fixed values.
LABEL = "struct<`目标岗位`:string,`教育背景`:array<string>,`核心技能`:array<string>,`实习经历`:array<string>,`项目经历`:array<string>,`优势标签`:array<string>>"
#: How a noisy form differs, in order.
NOISE = (("：", ":"), ("，", ","), ("；", ";"), ("。", ""), ("、", " "), ("MySQL", "My SOL"), ("Pytest", "Py test"), ("Kubernetes", "Kubernet es"))
#: Lines of adverts that tell of another task.
OTHER_TASK = "任务类型：从岗位中提取学历|任务类型:从岗位中提取学历|学历提示：|学历提示:"
EDUCATIONAL = "hf_job_educational_"


def normalized_text(c: Column) -> Column:
    """Lines trimmed, blanks squeezed, at most one empty line in a row."""
    unix = F.regexp_replace(F.translate(text_or_empty(c), "　", " "), "\r\n?", "\n")
    trimmed = F.transform(F.split(unix, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(trimmed, "\n"), "\n{3,}", "\n\n"))


def rendered(sections: Column, text: Column) -> Column:
    """The filled sections below their titles, else the text."""
    part = lambda k: strip(text_or_empty(sections[k]))
    blocks = F.concat_ws("\n\n", *(F.when(part(k) != "", part(k) if k == "header" else F.concat(F.lit(f"{t}：\n"), part(k))) for k, t in TITLES.items()))
    return F.when(blocks != "", blocks).otherwise(strip(text_or_empty(text)))


def normalized_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with clean_text, sections and normalized_text."""
    out = rows.withColumn("clean_text", normalized_text(F.col(text)))
    out = out.withColumn("sections", line_sections(F.col("clean_text"), RESUME))
    return out.withColumn("normalized_text", rendered(F.col("sections"), F.col("clean_text")))


def _listed(label: Column, name: str) -> Column:
    return F.coalesce(label[name], F.array().cast("array<string>"))


def _joined(label: Column, name: str, by: str) -> Column:
    return F.array_join(_listed(label, name), by)


def _items(label: Column, name: str, mark: str) -> Column:
    return F.array_join(F.transform(_listed(label, name), lambda x: F.concat(F.lit(mark), x)), "\n")


def _head(text: str, c: Column) -> Column:
    return F.concat(F.lit(text), text_or_empty(c))


def _if(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def card(label: Column) -> Column:
    """A profile card."""
    block = lambda title, name: F.when(F.size(_listed(label, name)) > 0, F.concat(F.lit(title + "：\n"), _items(label, name, "1. ")))
    strengths = F.when(F.size(_listed(label, "优势标签")) > 0, _head("优势标签：", _joined(label, "优势标签", "、")))
    return F.concat_ws(
        "\n", F.lit("候选人简历"), _head("目标岗位：", label["目标岗位"]), _head("教育背景：", _joined(label, "教育背景", "; ")),
        _head("核心技能：", _joined(label, "核心技能", "、")), block("实习经历", "实习经历"), block("项目经历", "项目经历"), strengths
    )


def bulleted(label: Column) -> Column:
    """Headings with items below them."""
    parts = [_head("求职方向：", label["目标岗位"])]
    for title, name in (("教育：", "教育背景"), ("技能栈：", "核心技能"), ("实习：", "实习经历"), ("项目：", "项目经历"), ("优势：", "优势标签")):
        parts += [F.lit(title), _if(_items(label, name, "- "))]
    return F.concat_ws("\n", *parts)


def compact(label: Column) -> Column:
    """A line a field; empty fields have none."""
    named = (("教育 ", "教育背景", "；"), ("技能 ", "核心技能", "、"), ("实习 ", "实习经历", "；"), ("项目 ", "项目经历", "；"), ("优势 ", "优势标签", "、"))
    every = [_head("目标岗位 ", label["目标岗位"]), *(_head(t, _joined(label, n, by)) for t, n, by in named)]
    return F.concat_ws("\n", *(F.when(~x.endswith(" "), x) for x in every))


def mixed(label: Column) -> Column:
    """Lines for short fields and items for long ones."""
    parts = [_head("候选人目标：", label["目标岗位"]), _head("教育经历：", _joined(label, "教育背景", "；")), _head("核心技能：", _joined(label, "核心技能", " / "))]
    for name in ("实习经历", "项目经历"):
        parts.append(F.when(F.size(_listed(label, name)) > 0, F.concat(F.lit(f"{name}：\n"), _items(label, name, "- "))))
    parts.append(F.when(F.size(_listed(label, "优势标签")) > 0, _head("个人优势：", _joined(label, "优势标签", "、"))))
    return F.concat_ws("\n", *parts)


def noisy(text: Column) -> Column:
    """A text as if it had been read by a machine."""
    for a, b in NOISE:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def bilingual(label: Column) -> Column:
    """English headings."""
    return F.concat_ws(
        "\n", _head("Target Role: ", label["目标岗位"]), _head("Education: ", _joined(label, "教育背景", "; ")), _head("Skills: ", _joined(label, "核心技能", ", ")),
        _head("Projects:\n", _items(label, "项目经历", "* ")), _head("Internships:\n", _items(label, "实习经历", "* ")), _head("Strengths: ", _joined(label, "优势标签", ", ")),
    )


RENDERINGS = {
    "original": lambda text, label: strip(text_or_empty(text)), "profile_card": lambda text, label: card(label), "bullets": lambda text, label: bulleted(label),
    "compact": lambda text, label: compact(label), "ocr_like": lambda text, label: noisy(mixed(label)), "mixed_cn_en": lambda text, label: bilingual(label),
}


def renderings(rows: DataFrame) -> DataFrame:
    """``rows`` (text, label) once for each rendering that isn't empty, with ``variant`` and ``rendered``; one pass."""
    every = F.array(*(F.struct(F.lit(n).alias("variant"), strip(f(F.col("text"), F.col("label"))).alias("rendered")) for n, f in RENDERINGS.items()))
    return rows.select("*", F.inline(every)).filter("rendered <> ''")


def _group(rows: DataFrame) -> Column:
    own = F.col("source_group") if "source_group" in rows.columns else F.lit(None).cast("string")
    return F.coalesce(F.nullif(own.cast("string"), F.lit("")), F.col("id").cast("string"))


def synthetic_pool(rows: DataFrame) -> DataFrame:
    """Renderings as rows of a pool."""
    meta = F.to_json(F.struct(F.lit("zh").alias("language"), F.lit("resume_variant_render_v1").alias("generator")))
    kind = F.when(F.col("variant") == "ocr_like", "synthetic_ocr_like").otherwise("synthetic_text")
    return renderings(rows).select(
        F.concat_ws("_", "id", "variant").alias("id"), F.lit("resume_parse").alias("task"), kind.alias("source_type"),
        _group(rows).alias("source_group"), F.col("rendered").alias("text"), "label", meta.alias("meta")
    )


def samples(rows: DataFrame) -> DataFrame:
    """Chat samples of all renderings; those of one source and its noisy form share a group."""
    user = F.concat(F.lit(RESUME_PROMPT), F.col("rendered"))
    group = F.regexp_replace(_group(rows), "_ocr$", "")
    out = renderings(rows).select(
        F.concat_ws("_", "id", "variant").alias("id"), F.lit("resume_parse").alias("task_type"), group.alias("source_group"),
        messages(user, F.to_json("label")).alias("messages")
    )
    return once_by_content(out)


def once_by_content(rows: DataFrame) -> DataFrame:
    """The sample of the least id of those with the same question and answer."""
    key = F.sha1(F.concat(F.get("messages", 1)["content"], F.lit("\n---\n"), F.element_at("messages", -1)["content"]))
    return rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.col("id")).alias("row")).select("row.*")


def samples_to_pool(rows: DataFrame) -> DataFrame:
    """The texts and labels of samples, as rows of a pool; those without either are dropped."""
    asked = F.get(F.filter("messages", lambda m: (m["role"] == "user") & m["content"].contains("简历：\n")), 0)["content"]
    text = strip(F.regexp_replace(text_or_empty(asked), "(?s)^.*?简历：\n", ""))
    said = F.filter("messages", lambda m: (m["role"] == "assistant") & (strip(text_or_empty(m["content"])) != ""))
    label = F.from_json(F.get(F.reverse(said), 0)["content"], LABEL)
    meta = F.to_json(F.struct(F.lit("zh").alias("language"), F.lit("resume_sft_projection_v1").alias("generator")))
    out = rows.select(
        "id", F.lit("resume_parse").alias("task"), F.lit("sft_materialized").alias("source_type"), text.alias("text"), label.alias("label"),
        meta.alias("meta")
    )
    return out.filter("text <> '' and label is not null")


#: What may be used, and how much of a label a public résumé needs.
USABLE_FOR = ("training", "sft_training", "training_and_evaluation")


def signals(label: Column) -> Column:
    """How many of a label's five main fields are filled."""
    lists = (F.size(_listed(label, n)) > 0 for n in ("教育背景", "核心技能", "项目经历", "实习经历"))
    return sum((c.cast("int") for c in (strip(text_or_empty(label["目标岗位"])) != "", *lists)), F.lit(0))


def _meta(key: str) -> Column:
    return F.lower(text_or_empty(F.get_json_object("meta", f"$.{key}")))


def is_usable_public_resume() -> Column:
    tongue = F.when(_meta("language") == "", "zh").otherwise(_meta("language"))
    licensed = (_meta("license_status") == "confirmed") & _meta("intended_usage").isin(*USABLE_FOR)
    return F.coalesce(
        (F.col("task") == "resume_parse") & licensed & tongue.startswith("zh") & (
            F.length(strip(text_or_empty(F.col("text")))) >= 80
        ) & (signals(F.col("label")) >= 3),
        F.lit(False)
    )


def is_usable_public_pair() -> Column:
    licensed = (_meta("license_status") == "confirmed") & _meta("intended_usage").isin(*USABLE_FOR) & ~_meta("provenance_status").isin("", "undocumented", "unknown")
    long = lambda c: F.length(strip(text_or_empty(F.col(c)))) >= 80
    judged = (text_or_empty(F.col("label.raw_label")) != "") | (text_or_empty(F.col("label.raw_score").cast("string")) != "")
    return F.coalesce(
        (F.col("task") == "match") & licensed & _meta("language").isin("", "zh", "zh-cn", "en") & long("jd_text") & long("resume_text") & judged,
        F.lit(False)
    )


POOL = ("id", "task", "source_type", "text", "label", "meta")


def combined_pool(*pools: DataFrame, public: DataFrame) -> DataFrame:
    """Pools in order, the usable public rows last, with private findings redacted; of equal texts that of the first pool
    and least id stays."""
    every = [p.select(*POOL, F.lit(i).alias("rank")) for i, p in enumerate((*pools, public.filter(is_usable_public_resume())))]
    out = every[0]
    for p in every[1:]:
        out = out.unionByName(p)
    out = out.withColumn("text", for_training(strip(text_or_empty(F.col("text")))))
    return out.groupBy(F.sha1("text").alias("_key")).agg(F.min_by(F.struct(*POOL), F.struct("rank", "id")).alias("row")).select("row.*")


def combined_pairs(*pools: DataFrame, public: DataFrame, max_rate: float = 0.4) -> DataFrame:
    """Pools of pairs in order, the usable public ones last; of equal pairs that of the first pool and least id stays, and
    those from one family of sources make ``max_rate`` of the result at most."""
    from curatrix.operators.selection import rate_cap

    names = ("id", "task", "source_type", "jd_text", "resume_text", "label", "meta")
    every = [p.select(*names, F.lit(i).alias("rank")) for i, p in enumerate((*pools, public.filter(is_usable_public_pair())))]
    out = every[0]
    for p in every[1:]:
        out = out.unionByName(p)
    key = F.sha1(F.concat(strip(text_or_empty(F.col("jd_text"))), F.lit("\n---\n"), strip(text_or_empty(F.col("resume_text")))))
    once = out.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*names, "rank"), F.struct("rank", "id")).alias("row")).select("row.*")
    family = F.col("id").contains(f"synthetic_match_{EDUCATIONAL}")
    return (once if max_rate >= 1.0 else rate_cap(once, family, max_rate, ["rank", "id"])).select(*names)


#: What a résumé made from an advert says.
MAJOR, TASKS, SOLID, ANY_DEGREE, ANY_SKILLS, ANY_COMPANY = "，计算机相关专业，示例高校", "负责基础开发、测试或联调工作。", "具备较强工程落地能力", "本科", "相关技术栈", "目标业务系统"


def from_adverts(rows: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Résumés made from raw adverts (id, index, job_title, company, raw_text) with a direction and two skills."""
    t, c, x = (strip(text_or_empty(F.col(n))) for n in ("job_title", "company", "raw_text"))
    out = rows.select("id", "index", t.alias("t"), c.alias("c"), x.alias("x")).withColumns(
        {"d": fields.direction(F.col("t"), F.col("x")), "e": fields.degree(F.col("x")), "s": known_skills(F.col("x"), vocabulary)}
    )
    out = out.filter("d <> '' and size(s) >= 2")
    named = F.when(F.col("t") != "", F.col("t")).otherwise(F.col("d"))
    project = F.concat(F.lit("围绕"), named, F.lit("相关场景完成核心模块开发与优化，重点使用"), F.array_join(F.slice("s", 1, 4), "、"), F.lit("支持业务落地。"))
    other = F.concat(F.lit("参与"), F.when(F.col("c") != "", F.col("c")).otherwise(ANY_COMPANY), F.lit("相关项目迭代，负责功能实现、问题定位与稳定性优化。"))
    intern = F.concat(F.lit("在"), F.col("d"), F.lit("方向团队参与"), named, F.lit("相关实习，" + TASKS))
    strengths = F.array(F.concat("d", F.lit("方向实践经验")), F.concat(F.lit("核心技能覆盖："), F.array_join(F.slice("s", 1, 3), "、")), F.lit(SOLID))
    school = F.concat(F.when(F.col("e") != "", F.col("e")).otherwise(ANY_DEGREE), F.lit(MAJOR))
    label = F.struct(
        F.col("d").alias("目标岗位"), F.array(school).alias("教育背景"), F.slice("s", 1, 8).alias("核心技能"), F.array(intern).alias("实习经历"),
        F.array(project, other).alias("项目经历"), strengths.alias("优势标签")
    )
    out = out.withColumn("label", label)
    text = F.concat_ws(
        "\n",
        *(
            _head(f"{h}：", _joined(F.col("label"), n, by) if by else F.col("label")[n]) for h, n,
            by in (("目标岗位", "目标岗位", ""), ("教育背景", "教育背景", "、"), ("核心技能", "核心技能", "、"), ("实习经历", "实习经历", "；"), ("项目经历", "项目经历", "；"), ("优势", "优势标签", "、"))
        )
    )
    meta = F.to_json(F.struct(F.lit("zh").alias("language"), F.lit("resume_bootstrap_from_jd_v1").alias("generator"), F.col("id").alias("source_jd")))
    return out.select(
        F.concat(F.lit("resume_bootstrap_"), F.col("index").cast("string"), F.lit("_"), "id").alias("id"), F.lit("resume_parse").alias("task"),
        F.lit("bootstrap_from_jd").alias("source_type"), text.alias("text"), "label", meta.alias("meta")
    )


def advert_for_matching(text: Column) -> Column:
    """A text without the lines of another task."""
    return strip(F.array_join(F.filter(lines(text), lambda x: ~strip(x).rlike(f"^(?:{OTHER_TASK})")), "\n"))


def split_by_group(df: DataFrame, group: str, family: str, seed: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """``df`` with ``split``: the groups of each family in hash order by shares, one valid and one test group at least; with
    fewer than three groups all are train.

    Ranks are taken over distinct groups, a row each.
    """
    groups = df.select(family, group).distinct().withColumn("h", hash_order(seed, F.concat_ws(":", family, group)))
    rank = F.row_number().over(W.partitionBy(family).orderBy("h", group)) - 1
    sizes = groups.groupBy(family).agg(F.count(F.lit(1)).alias("n"))
    ranked = groups.withColumn("rank", rank).join(sizes, family)
    n_valid = F.greatest(F.lit(1), (F.col("n") * valid).cast("long"))
    n_test = F.greatest(F.lit(1), F.col("n") - (F.col("n") * train).cast("long") - n_valid)
    n_train = F.col("n") - n_valid - n_test
    named = F.when((F.col("n") < 3) | (F.col("rank") < n_train), "train").when(F.col("rank") < n_train + n_valid, "valid").otherwise("test")
    return df.join(ranked.select(family, group, named.alias("split")), [family, group])


def match_pool(
    adverts: DataFrame, resumes: DataFrame, vocabulary: dict[str, list[str]], *, positives: int = 2, negatives: int = 1, max_adverts: int = 300,
    max_rate: float = 0.4, seed: str = "42"
) -> DataFrame:
    """Scored pairs of raw adverts (id, job_title, raw_text) and résumés (id, text, label).

    Adverts with a direction are taken in hash order, those of one family up to ``max_rate`` of ``max_adverts``. Both sides
    are split by entities, so no text is in two splits. Within a split an advert meets the next ``positives`` résumés of its
    direction and the next ``negatives`` of others, in hash order and round the end, so every résumé is met about as often.
    Résumés are numbered by direction and split, and an advert's partners are found by their numbers: an equi-join.
    """
    from curatrix.sources.store import shared_copy

    texts = adverts.select("id", F.col("job_title"), advert_for_matching(F.col("raw_text")).alias("jd_text"))
    usable = texts.withColumn("direction", fields.direction(F.col("job_title"), F.col("jd_text"))).filter(
        (strip(text_or_empty(F.col("job_title"))) != "") & (F.col("jd_text") != "") & (F.col("direction") != "")
    )
    usable = usable.withColumns({"family": F.col("id").startswith(EDUCATIONAL), "h": hash_order(seed, F.concat_ws("\n", "id", "jd_text"))})
    first = usable.withColumn("rn", F.row_number().over(W.partitionBy("family").orderBy("h", "id"))).filter(
        F.col("rn") <= F.when(F.col("family"), int(max_adverts * max_rate)).otherwise(max_adverts)
    )
    chosen = first.orderBy("h", "id").limit(max_adverts).withColumns({"entity": normalized_hash(F.col("jd_text")), "kind": F.col("family").cast("string")})
    # Both sides are written: the plan below reads each several times, and the digests come from Python.
    left = split_by_group(shared_copy(chosen, "adverts"), "entity", "kind", f"{seed}:jd")
    ready = resumes.filter(
        (strip(text_or_empty(F.col("label")["目标岗位"])) != "") & (F.size(_listed(F.col("label"), "核心技能")) > 0) & (strip(text_or_empty(F.col("text"))) != "")
    )
    right = ready.select(
        F.col("id").alias("resume_id"), for_training(F.col("text")).alias("resume_text"), F.col("label").alias("r"),
        strip(F.col("label")["目标岗位"]).alias("target")
    )
    right = shared_copy(right.withColumn("resume_entity", normalized_hash(F.col("resume_text"))), "resumes")
    right = split_by_group(right, "resume_entity", "target", f"{seed}:resume")
    order = hash_order(f"{seed}:r", F.col("resume_id"))
    numbered = right.withColumn("k", F.row_number().over(W.partitionBy("split", "target").orderBy(order, "resume_id")) - 1)
    sizes = numbered.groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))
    # Where each target's numbers begin when all of a split are in one row, targets in order.
    before = F.coalesce(F.sum("n").over(W.partitionBy("split").orderBy("target").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"begin": before, "all": F.sum("n").over(W.partitionBy("split"))})
    numbered = numbered.join(sizes, ["split", "target"]).withColumn("place", F.col("k") + F.col("begin"))
    totals = sizes.groupBy("split").agg(F.max("all").alias("total"))
    asked = left.join(sizes.select("split", F.col("target").alias("direction"), "n", "begin"), ["split", "direction"], "left").join(totals, "split")
    at = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40))
    own = F.coalesce("n", F.lit(0))
    same = F.when(
        own > 0,
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(positives), own).cast("int")),
            lambda i: F.struct(i.alias("idx"), (F.col("begin") + (at + i) % own).alias("place"))
        )
    )
    # The others are those before and after the own target's numbers.
    rest = F.col("total") - own
    other = F.when(
        (rest > 0) & F.lit(negatives > 0),
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(max(negatives, 1)), rest).cast("int")),
            lambda i: F.struct(
                (i + positives).alias("idx"),
                F.when((at + i) % rest < F.coalesce("begin", F.lit(0)), (at + i) % rest).otherwise((at + i) % rest + own).alias("place")
            )
        )
    )
    none = F.array().cast("array<struct<idx:int,place:bigint>>")
    partners = asked.select("*", F.inline(F.concat(F.coalesce(same, none), F.coalesce(other, none))))
    both = partners.alias("a").join(numbered.alias("b"), (F.col("a.split") == F.col("b.split")) & (F.col("a.place") == F.col("b.place")))
    empty = F.lit(None).cast("array<string>")
    advert = F.struct(
        F.col("direction"), known_skills(F.col("jd_text"), vocabulary).alias("skills"), fields.degree(F.col("jd_text")).alias("education"),
        fields.experience(F.col("jd_text")).alias("experience"), empty.alias("requirements"), empty.alias("responsibilities"),
        F.col("jd_text").alias("text")
    )
    resume = F.struct(
        F.col("r")["目标岗位"].alias("target"), F.col("r")["教育背景"].alias("education"), F.col("r")["核心技能"].alias("skills"),
        F.col("r")["项目经历"].alias("projects"), F.col("r")["实习经历"].alias("internships"), F.col("resume_text").alias("text")
    )
    pairs = both.select(
        F.concat_ws("_", F.lit("synthetic_match"), "id", "resume_id", F.col("idx").cast("string")).alias("id"), "jd_text", "resume_text", "direction",
        "target", F.col("a.split").alias("entity_split"), F.col("entity").alias("jd_entity_hash"), F.col("resume_entity").alias("resume_entity_hash"),
        advert.alias("advert"), resume.alias("resume")
    )
    scored = score_pairs(pairs, vocabulary)
    m = F.col("match")
    label = F.struct(
        m["level"].alias("匹配等级"), (m["relation"] != "mismatch").alias("岗位方向匹配"), m["education"].alias("学历匹配"), m["experience"].alias("经验匹配"),
        m["matched"].alias("命中技能"), m["missing"].alias("缺失技能"), m["projects"].alias("命中项目"), m["score"].alias("raw_score")
    )
    meta = F.to_json(
        F.struct(
            F.lit("zh").alias("language"), F.lit("jd_resume_rule_pairing_v1").alias("generator"), F.col("direction").alias("jd_direction"),
            F.col("target").alias("resume_direction"), "entity_split", "jd_entity_hash", "resume_entity_hash"
        )
    )
    return scored.select(
        "id", F.lit("match").alias("task"), F.lit("synthetic_text").alias("source_type"), "jd_text", "resume_text", label.alias("label"),
        meta.alias("meta")
    )
