"""Pairs of adverts and résumés: known skills, their evidence, compatible directions, scores, and checks of explanations.

All are column expressions or steps over a table of pairs; vocabularies are dicts from a name to its aliases. Null counts
as empty. Full-width characters are compared as their ASCII forms; other compatibility forms stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import lines, strip, text_or_empty
from curatrix.operators.matching import Policy, first_rule, rank_of_degree, required_degree, required_years, years
from curatrix.operators.sections import END, START

#: Headings and cues of the kinds of evidence, in the order in which cues are tried.
HEADINGS = {
    "requirement": ("任职要求", "任职资格", "岗位要求", "职位要求", "能力要求", "基本要求"),
    "responsibility": ("岗位职责", "职位职责", "工作职责", "核心职责", "岗位描述", "工作内容"),
    "bonus": ("加分项", "优先条件", "优先考虑"),
}
CUES = {
    "bonus": "优先|加分",
    "requirement": "熟悉|掌握|具备|要求|精通|经验|能力|能够|擅长|了解",
    "responsibility": "负责|参与|建设|开发|维护|研究|使用|完成|推进|支持",
}
KINDS = ("requirement", "responsibility", "bonus", "other")
#: Directions by what names them, special ones first.
DIRECTIONS = {
    "algorithm_platform": ("算法平台", "ai 平台", "ai平台"),
    "model_serving": ("模型服务", "模型 serving", "model serving", "推理工程"),
    "ai_backend": ("ai 后端", "ai后端"),
    "ai_infra": ("ai infra", "ai基础设施", "ai 基础设施"),
    "ai_application": ("大模型应用", "ai应用", "ai 应用"),
    "algorithm": ("算法工程", "算法开发", "算法"),
    "data_engineering": ("数据开发", "数据工程"),
    "data_science": ("数据科学", "数据分析"),
    "test_development": ("测试开发", "测试工程"),
    "frontend": ("前端开发", "前端"),
    "backend": ("后端开发", "服务端", "后端"),
    "client": ("客户端开发", "客户端"),
    "embedded": ("嵌式开发", "嵌入式"),
    "infrastructure": ("网络与基础设施", "运维开发", "基础设施"),
    "security": ("安全工程", "网络安全"),
    "hpc": ("高性能计算", "hpc"),
    "hardware": ("硬件研发", "硬件"),
    "automotive": ("汽车软件", "智驾研发", "自动驾驶"),
    "product": ("产品经理", "产品"),
}
#: Directions that platform work brings together, and the signs of platform, application and data work.
PLATFORM_PAIRS = (
    ("algorithm_platform", "ai_backend"), ("algorithm_platform", "backend"), ("algorithm_platform", "ai_infra"), ("model_serving", "ai_backend"), ("model_serving", "backend"),
    ("model_serving", "ai_infra"), ("ai_infra", "ai_backend"), ("ai_infra", "backend"), ("ai_backend", "backend"),
)
PLATFORM = r"(?iU)serving|在线推理|模型部署|推理服务|平台\s*api|服务平台|模型服务|容器化|kubernetes|docker"
APPLICATION = "(?iU)rag|agent|智能体|大模型应用|llm应用|应用落地|工作流"
DATA_WORK = "(?iU)数据平台|数据管道|etl|flink|spark|数仓|数据服务"
AI_SKILLS = ("PyTorch", "TensorFlow", "CUDA", "Transformers", "RAG", "Agent")
ENGINEERING_SKILLS = ("Python", "FastAPI", "Docker", "Kubernetes", "Linux", "Go", "Java")

WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def narrow(c: Column) -> Column:
    return F.translate(text_or_empty(c), WIDE, NARROW)


def squeezed(c: Column) -> Column:
    """Blanks as single spaces, none at the ends."""
    return strip(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def _listed(c: Column) -> Column:
    """The non-empty squeezed items of an array."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), squeezed), lambda x: x != "")


def skill_pattern(name: str) -> str:
    """A name between word borders, also with up to three blanks or hyphens between characters if it is long or signed."""
    word = lambda c: bool(re.match("[A-Za-z0-9]", c))
    left = "(?<![A-Za-z0-9])" if word(name[0]) else ""
    if name.lower() == "c":
        return left + r"c(?!\s*(?:\+|#|语言))(?![A-Za-z0-9-])"
    options = [f"{left}\\Q{name}\\E" + ("(?![A-Za-z0-9-])" if word(name[-1]) else "")]
    bare = re.sub(r"[\s-]+", "", name)
    if len(bare) >= 4 or re.search("[+#.]", bare):
        options.append(left + r"[\s-]{0,3}".join(f"\\Q{c}\\E" for c in bare) + ("(?![A-Za-z0-9-])" if word(bare[-1]) else "(?![A-Za-z0-9])"))
    return "|".join(options)


def known_skills(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The names, in the vocabulary's order, of which the name or an alias stands in the text."""

    def names(plain: Column) -> Column:
        found = (F.when(plain.rlike("(?iU)" + "|".join(skill_pattern(a) for a in (name, *aliases))), F.lit(name)) for name, aliases in vocabulary.items())
        return F.array_compact(F.array(*found))

    # The narrowed text is bound to a variable, else each name would narrow it again.
    return F.get(F.transform(F.array(narrow(text)), names), 0)


def merged(*vocabularies: dict[str, list[str]]) -> dict[str, list[str]]:
    """One vocabulary of several: names in order of sight, each with all its aliases once."""
    out: dict[str, list[str]] = {}
    for vocabulary in vocabularies:
        for name, aliases in vocabulary.items():
            own = out.setdefault(name, [])
            own += [a for a in aliases if a not in own]
    return out


def canonical_skills(items: Column, vocabulary: dict[str, list[str]], keep_unknown: bool = False) -> Column:
    """Skills by their names, looked up by spelling and then without blanks and hyphens; the first of equal ones stays."""
    exact, near = {}, {}
    for name, aliases in vocabulary.items():
        for a in (name, *aliases):
            exact[a.lower()] = name
            near.setdefault(re.sub(r"[\s-]+", "", a).lower(), set()).add(name)
    near = {k: next(iter(v)) for k, v in near.items() if k and len(v) == 1}
    look = lambda m, k: F.try_element_at(F.create_map(*(F.lit(x) for pair in m.items() for x in pair)), k)

    def name_of(x: Column) -> Column:
        x = squeezed(narrow(x))
        return F.coalesce(
            look(exact, F.lower(x)), look(near, F.lower(F.regexp_replace(x, r"(?U)[\s-]+", ""))), x if keep_unknown else F.lit(None).cast("string")
        )

    names = F.filter(F.transform(_listed(items), name_of), lambda x: x.isNotNull())
    keys = F.transform(names, F.lower)
    firsts = F.transform(
        F.array(F.struct(names.alias("n"), keys.alias("k"))), lambda s: F.filter(s["n"], lambda x, i: F.array_position(s["k"], F.lower(x)) == i + 1)
    )
    return F.get(firsts, 0)


def segments(text: Column) -> Column:
    """(kind, line) of a text: the kind of the heading above, else by the first cue, else other."""
    every = "|".join(w for words in HEADINGS.values() for w in words)
    cut = F.regexp_replace(F.regexp_replace(text_or_empty(text), f"[{START}{END}]", ""), rf"(?U)(?<!^)(?=(?:{every})\s*[：:])", "\n")

    def line(x: Column) -> Column:
        out = F.concat(x, F.lit("\n"))
        for kind, words in reversed(HEADINGS.items()):
            spaced = "|".join(r"\s*".join(w) for w in words)
            out = F.when(
                x.rlike(f"(?U)^(?:{spaced})"),
                F.concat(F.lit(f"{START}{kind}{END}"), strip(F.regexp_replace(x, rf"(?U)^(?:{every})\s*[：:]?\s*", "")), F.lit("\n"))
            ).otherwise(out)
        return out

    trimmed = F.transform(lines(cut), lambda x: F.regexp_replace(x, "^[ \t\\-•]+|[ \t\\-•]+$", ""))
    marked = F.concat(F.lit(START + END), F.array_join(F.transform(F.filter(trimmed, lambda x: x != ""), line), ""))

    def of_part(part: Column) -> Column:
        kind, body = F.substring_index(part, END, 1), F.regexp_replace(part, f"(?s)^[^{END}]*{END}", "")
        by_cue = lambda x: first_rule([(x.rlike(p), k) for k, p in CUES.items()], "other")
        return F.transform(
            F.filter(F.split(body, "\n"), lambda x: x != ""),
            lambda x: F.struct(F.when(kind != "", kind).otherwise(by_cue(x)).alias("kind"), x.alias("line"))
        )

    parts = F.filter(F.split(marked, START), lambda p: p != "")
    return F.flatten(F.transform(parts, of_part))


def skill_evidence(vocabulary: dict[str, list[str]], requirements: Column, responsibilities: Column, bonus: Column, text: Column, candidates: Column) -> Column:
    """By skill, in order of sight: whether it is required, and the distinct lines of each kind that name it. Candidates
    come last and are not required by being listed."""
    given = [F.transform(_listed(c), _of_kind(kind)) for kind, c in zip(KINDS, (requirements, responsibilities, bonus), strict=False)]
    every = F.concat(*given, segments(text), F.transform(_listed(candidates), _of_kind("")))
    hits = F.transform(
        every, lambda s: F.struct(s["kind"].alias("kind"), squeezed(s["line"]).alias("line"), known_skills(s["line"], vocabulary).alias("skills"))
    )

    def of_skill(hits: Column, skill: Column) -> Column:
        naming = lambda kind: F.filter(hits, lambda h: (h["kind"] == kind) & F.array_contains(h["skills"], skill))
        excerpts = (F.array_distinct(F.transform(naming(k), lambda h: h["line"])).alias(k) for k in KINDS)
        return F.struct(skill.alias("skill"), (F.size(naming("requirement")) > 0).alias("required"), *excerpts)

    bound = F.transform(
        F.array(hits), lambda hs: F.transform(F.array_distinct(F.flatten(F.transform(hs, lambda h: h["skills"]))), lambda skill: of_skill(hs, skill))
    )
    return F.get(bound, 0)


def _of_kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("line"))


def direction_leaf(direction: Column, context: Column) -> Column:
    """The first direction whose name occurs, else the text; algorithms and backends by the signs of platform work."""
    text, around = F.lower(squeezed(direction)), F.lower(squeezed(context))
    has = lambda words: text.rlike("|".join(f"\\Q{w}\\E" for w in words))
    out = text
    for leaf, words in reversed(DIRECTIONS.items()):
        name = F.lit(leaf)
        if leaf in ("algorithm", "backend"):
            name = F.when(
                around.rlike(PLATFORM) & F.contains(text, F.lit("算法")), "algorithm_platform"
            ).when(around.rlike(PLATFORM) & around.rlike("模型|ai|推理"), "ai_backend").otherwise(leaf)
        out = F.when(has(words), name).otherwise(out)
    return out


def direction_relation(left: Column, right: Column, left_context: Column, right_context: Column, shared: Column) -> Column:
    """What relates two leaves: an evidence type; ``same_direction_leaf`` is exact, those of overlap are compatible, the
    rest a mismatch."""
    pair = F.array_join(F.array_sort(F.array(left, right)), "|")
    both = lambda p: text_or_empty(left_context).rlike(p) & text_or_empty(right_context).rlike(p)
    among = lambda *pairs: pair.isin(*("|".join(sorted(p)) for p in pairs))
    has = lambda skills: F.arrays_overlap(shared, F.array(*map(F.lit, skills)))
    enough = F.size(F.array_distinct(shared)) >= 2
    rules = [
        ((left != "") & (left == right), "same_direction_leaf"),
        ((left == "") | (right == ""), "missing_direction"),
        (among(*PLATFORM_PAIRS) & enough & has(AI_SKILLS) & has(ENGINEERING_SKILLS) & both(PLATFORM), "ai_platform_responsibility_and_skill_overlap"),
        (among(("algorithm", "ai_application")) & enough & both(APPLICATION), "ai_application_responsibility_and_skill_overlap"),
        (among(("data_engineering", "backend")) & enough & both(DATA_WORK), "data_platform_responsibility_and_skill_overlap"),
    ]
    return first_rule(rules, "insufficient_cross_role_evidence")


def score_pairs(pairs: DataFrame, vocabulary: dict[str, list[str]], policy: Policy | None = None, advert: str = "advert", resume: str = "resume") -> DataFrame:
    """``pairs`` with the struct ``match``.

    ``advert`` is a struct of direction, skills, education, experience, requirements, responsibilities and text,
    ``resume`` one of target, education, skills, projects, internships and text; lists are arrays. Each row is scored by
    itself, without a shuffle. Skills count as required by evidence where the advert has a text, else as listed.
    """
    policy = policy or Policy()
    a, r, none = (lambda f: F.col(f"{advert}.{f}")), (lambda f: F.col(f"{resume}.{f}")), F.array().cast("array<string>")
    key = lambda x: F.lower(squeezed(x))
    joined = lambda *parts: F.array_join(F.concat(*parts), "\n")
    text = lambda c: F.array(text_or_empty(c))
    work = F.concat(_listed(r("projects")), _listed(r("internships")))
    out = pairs.withColumn(
        "_evidence",
        F.when(strip(text_or_empty(a("text"))) != "", skill_evidence(vocabulary, a("requirements"), a("responsibilities"), none, a("text"), a("skills")))
    )
    out = out.withColumns({
        "_required": F.coalesce(
            F.transform(F.filter("_evidence", lambda e: e["required"]), lambda e: e["skill"]),
            canonical_skills(a("skills"), vocabulary, keep_unknown=True)
        ),
        "_has": F.transform(F.concat(_listed(r("skills")), known_skills(joined(_listed(r("skills")), work, text(r("text"))), vocabulary)), key),
        "_work": work,
    })
    out = out.withColumns({
        "_matched": F.filter("_required", lambda s: F.array_contains("_has", key(s))),
        "_missing": F.filter("_required", lambda s: ~F.array_contains("_has", key(s))),
        "_projects": F.array_distinct(F.filter("_work", lambda p: F.exists("_required", lambda s: F.contains(F.lower(p), F.lower(s))))),
        "_left": joined(text(a("text")), _listed(a("responsibilities")), _listed(a("requirements")), F.col("_required")),
        "_right": joined(text(r("text")), F.col("_work"), _listed(r("skills"))),
    })
    out = out.withColumns({"_leaf": direction_leaf(a("direction"), F.col("_left")), "_other": direction_leaf(r("target"), F.col("_right"))})
    degree, wanted = required_degree(text_or_empty(a("education"))), required_years(a("experience"))
    owned = F.array_max(F.transform(F.concat(_listed(r("education")), text(r("text"))), rank_of_degree))
    worked = F.greatest(years(r("text")), years(F.array_join("_work", "\n")))
    out = out.withColumns({
        "_why": direction_relation(F.col("_leaf"), F.col("_other"), F.col("_left"), F.col("_right"), F.col("_matched")),
        "_education": (degree == 0) | (owned >= degree),
        "_experience": (wanted == 0) | (worked >= wanted),
    })
    exact, compatible = F.col("_why") == "same_direction_leaf", F.col("_why").endswith("_skill_overlap")
    out = out.withColumn(
        "_score",
        policy.score(exact | compatible, F.size("_required"), F.size("_matched"), F.col("_education"), F.col("_experience"), F.size("_projects")).cast("int")
    )
    match = F.struct(
        F.col("_score").alias("score"), policy.level(F.col("_score")).alias("level"),
        F.when(exact, "exact").when(compatible, "compatible").otherwise("mismatch").alias("relation"), F.col("_why").alias("relation_evidence"),
        F.col("_leaf").alias("advert_leaf"), F.col("_other").alias("resume_leaf"), F.col("_education").alias("education"), F.col("_experience").alias("experience"),
        F.col("_matched").alias("matched"), F.col("_missing").alias("missing"), F.col("_projects").alias("projects"), F.col("_evidence").alias("evidence"),
    )
    return out.select(*(F.col(c) for c in pairs.columns), match.alias("match"))


def contradictions(
    direction: Column, education: Column, experience: Column, missing: Column, level: Column, strengths: Column, gaps: Column, conclusion: Column
) -> Column:
    """Codes of what an explanation says against the rules' result, in order."""
    says = lambda c, *words: text_or_empty(c).rlike("|".join(words))
    checks = []
    for name, flag, good, bad in (("岗位方向匹配", direction, "方向一致", "方向不一致"), ("学历匹配", education, "学历背景满足", "学历条件"), ("经验匹配", experience, "经验背景满足", "经验条件")):
        checks += [
            (~flag & says(strengths, good), f"{name}:false_but_strength_positive"),
            (flag & says(gaps, bad) & says(gaps, "差距"), f"{name}:true_but_gap_negative")
        ]
    checks += [
        ((F.size(missing) > 0) & says(gaps, "暂无明显硬性短板"), "missing_skills_but_no_hard_gap"),
        ((level == "高匹配") & says(conclusion, "匹配度有限", "低匹配", "不匹配"), "high_level_but_negative_conclusion"),
        ((level == "低匹配") & says(conclusion, "高度匹配", "整体较匹配"), "low_level_but_positive_conclusion"),
    ]
    return F.array_compact(F.array(*(F.when(ok, F.lit(code)) for ok, code in checks)))


def ungrounded(
    vocabulary: dict[str, list[str]], matched: Column, missing: Column, education: Column, experience: Column, strengths: Column, gaps: Column,
    advice: Column
) -> Column:
    """Codes of claims in an explanation that the rules' result doesn't support, distinct and in order."""
    matched, missing = F.coalesce(matched, F.array().cast("array<string>")), F.coalesce(missing, F.array().cast("array<string>"))

    def of_field(field: str, text: Column) -> Column:
        lacking = text_or_empty(text).rlike("缺失|未掌握|未体现|欠缺")
        code = lambda what, s: F.concat(F.lit(f"{field}:{what}:"), s)

        def of_skill(s: Column) -> Column:
            out = F.when(~F.array_contains(matched, s) & ~F.array_contains(missing, s), code("unsupported_skill", s))
            if field == "匹配优势":
                out = out.when(F.array_contains(missing, s), code("claims_missing_skill_as_strength", s))
            if field == "主要短板":
                out = out.when(F.array_contains(matched, s) & lacking, code("claims_matched_skill_as_missing", s))
            return out

        return F.array_compact(F.transform(known_skills(text, vocabulary), of_skill))

    claims = []
    for name, flag, good, bad in (("学历", education, "学历满足", "学历不满足"), ("经验", experience, "经验满足", "经验不足")):
        claims += [
            F.when(~flag & F.contains(strengths, F.lit(good)), f"{name}:unsupported_positive_claim"),
            F.when(flag & F.contains(gaps, F.lit(bad)), f"{name}:unsupported_negative_claim")
        ]
    fields = [of_field(f, c) for f, c in (("匹配优势", strengths), ("主要短板", gaps), ("简历优化建议", advice))]
    return F.array_distinct(F.concat(*fields, F.array_compact(F.array(*claims))))
