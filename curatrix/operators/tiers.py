"""Tiers of job advertisements: which rows are fit for training, why others are not, how risky a row is, and selection by tier.

Rows are normalised adverts (:func:`curatrix.operators.adverts.normalized`): id, source, job_title, company, location,
salary, clean_text, ``sections`` (responsibilities, requirements, bonus), ``labels`` (direction, skills, experience,
education), ``meta`` (a JSON object), language and sft_ready. Predicates are single column expressions over these names,
so a tier is one filter without a shuffle. Null counts as empty; a null sft_ready as ready. Word lists are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.text import lines, strip, text_or_empty
from curatrix.operators.fields import ALGORITHM_ROLE, APPLIED_ALGORITHM, SECURITY_ROLE, cascade, degree, effective_direction, experience, has
from curatrix.operators.matching import first_rule
from curatrix.operators.pairing import known_skills
from curatrix.operators.selection import hash_order

#: Sources by how far they are trusted.
WEAK_SOURCES = (
    "hf_job_educational_train_2026_05_17", "hf_job_educational_validation_2026_05_17", "hf_job_educational_test_2026_05_17", "github_jhcoco_bosszp",
    "github_workaggregation_test"
)
TRUSTED_SOURCES = (
    "zhaopin.jd.com", "careers.tencent.com", "talent.baidu.com", "careers.ctrip.com", "hr.xiaomi.com", "zhaopin.meituan.com", "talent.didiglobal.com",
    "moka_voyah", "moka_se", "moka_eastmoney", "moka_supcon", "moka_baai", "moka_hq", "moka_threatbook", "moka_sina", "moka_bosssoft", "moka_ztgame", "moka_transwarp",
    "moka_shopee", "moka_rastar", "moka_qianli1", "moka_cyou_inc", "moka_reo", "moka_wellintech", "moka_smoore", "moka_jspdg", "moka_step", "moka_high_flyer", "moka_whfhtx",
    "moka_thfund", "moka_huahong", "moka_xmyanquhr",
)
SHORT_SOURCE, SHORT_CATEGORY = "careers.tencent.com", "技术"
WEAK_PREFIXES = ("hf_", "github_")
USABLE_FOR = ("training", "training_and_evaluation", "weak_supervision_only")
WEAK_USAGE = "weak_supervision_only"
#: Words of titles that speak for and against technical work.
TECH_TITLE = "工程师|开发|算法|测试|研发|数据|前端|后端|运维|架构|java|python|c++|go|嵌入式|客户端|android|ios"
STRONG_FOR = "工程师|软件|software|研发|算法|开发|测试|数据|前端|后端|客户端|服务端|java|python|c++|golang|go|运维|sre|infra|平台|数据库|ai|agent|大模型|机器学习|产品经理|架构师|安全|ios|android|嵌入式|固件|dba"
STRONG_AGAINST = "销售|实施|理财顾问|投资顾问|课程顾问|售前|售后|物流|采购|运营|市场|设计师|美术|策划|财务|法务|人力|hr|行政|助教|机械|结构工程师|解决方案架构师|售前解决方案|电气|工艺|材料|飞机|土建|消防|公关|客服|采销|渠道经理|商品经理|招商|店长|陈列|merchandising|account manager|客户经理|品牌经理|投放|教师|老师|讲师|助教|编导|编剧|摄制|新闻编辑|课程开发|培训方案"
WEAK_FOR = "java|python|后端|后台|前端|测试|qa|算法|数据|开发|软件|客户端|android|ios|嵌入式|运维|sre|infra|平台"
WEAK_AGAINST = "销售|实施|技术支持|售前|售后|硬件|机械|电气|工艺|材料|质量|生产|结构|管道|飞机|电力|化工|暖通|土木|采购|运营"
#: Further words for titles of a direction, and those that excuse a word against it.
HINTS = {
    "产品经理": "产品|产品负责人|策略产品|商业策略产品",
    "算法工程": "专家|研究员|科学家|推理|训练|模型负责人|视频生成|生成模型|world model|应用研究|分布式通信库|多模态|推荐策略|深度学习|机器学习|nlp",
    "后端开发": "olap|控制面|中间件|引擎|数据库|dba|分布式存储|服务器开发|后台团队负责人|操作系统|编译优化",
    "网络与基础设施": "网络规划|网络开发|网络工程师|网络交付|基础架构|基础设施",
    "AI Infra": "ai infra|机器学习平台|训练平台|推理平台|训推平台|算力平台|rl infra",
    "高性能计算": "高性能计算|hpc|gpu集群|gpu 集群|计算集群",
    "汽车软件/智驾研发": "智驾系统|驾驶辅助|智能行车系统|泊车功能开发|底盘集成控制系统开发|底盘电控功能开发工程师|感知质量开发工程师|智驾软件集成",
    "运维开发": "gpu资源|指挥中心|可靠性|devops|sre|infra|运营开发",
    "客户端开发": "app|ios|android|unity|ue|u3d|sdk|游戏客户端|音视频引擎",
    "嵌入式开发": "固件|驱动|bsp|rtos|单片机|嵌入式",
    "硬件研发": "硬件开发|硬件工程师|功率硬件|电力电子|结构设计工程师|系统集成工程师|音响开发|npi工程师|电子电器",
    "安全工程": "渗透|攻防|漏洞|安全|威胁",
}
EXCUSES = {
    "安全工程": "安全运营|大模型安全运营",
    "后端开发": "研发岗",
    "运维开发": "sre|devops|运营开发",
    "网络与基础设施": "网络规划|网络开发|网络工程师|网络交付",
    "AI Infra": HINTS["AI Infra"],
    "高性能计算": "高性能计算|hpc",
    "汽车软件/智驾研发": HINTS["汽车软件/智驾研发"],
}
#: What marks a structured text; a few skills that every text is searched for.
MARKERS = "岗位职责|工作职责|职位描述|工作内容|职责描述|任职要求|岗位要求|职位要求|任职资格|能力要求|技能要求"
FEWER_MARKERS = "岗位职责|工作职责|职位描述|工作内容|任职要求|岗位要求|技能要求|任职资格"
BASIC_SKILLS = {"Python": ["python"], "Java": ["java"], "C++": ["c++"], "SQL": ["sql"], "Linux": ["linux"]}
#: Titles and texts of low signal, degrees that are no experience, titles of other trades.
LOW_TITLE = "实习|应届|校招|校园招聘|培训生|教师|老师|讲师|助教|培训师|培训讲师|编导|编剧|摄制|新闻编辑"
LOW_TITLE_SHORT = "实习|应届|校招|培训生"
LOW_TEXT = "任务类型：从岗位中提取学历|毕业生|管培生|实习单位|2025届|2026届|2027届"
DEGREE_ONLY = ("专科", "大专", "本科", "本科及以上", "硕士", "硕士及以上", "博士", "博士及以上", "统招本科", "全日制本科")
OTHER_TRADES = "教师|老师|讲师|助教|编导|编剧|摄制|新闻编辑|课程开发|培训方案|招生"
STRUCTURED_DIRECTIONS = ("算法工程", "后端开发", "前端开发", "客户端开发", "测试开发", "运维开发", "数据开发", "嵌入式开发", "硬件研发", "安全工程", "网络与基础设施", "AI Infra", "高性能计算", "汽车软件/智驾研发")
LIKE_TECH = r"工程师|开发|算法|测试|研发|后端|前端|客户端|服务端|运维|\bsre\b|架构|\bsdk\b|编译|网络|内核|数据库|固件|驱动|模型|智能体"
#: Reasons a row can be mended, and by what.
REPAIRABLE = ("missing_direction", "missing_sections", "missing_edu_exp_skill", "clean_text_too_short")
#: Signs and weights of risks, and the score from which a row is risky.
SUSPICIOUS_TITLE = "教师|老师|讲师|助教|培训师|编导|编剧|摄制|新闻编辑|校园招聘|管培生|实习"
DEMAND_MARKERS = ("任职要求", "岗位要求", "职位要求", "任职资格", "能力要求", "技能要求", "专业要求")
DUTY_MARKERS = ("岗位职责", "工作职责", "职位描述", "工作内容", "职责描述")
RISKS = {
    "invalid_assistant_json": 5, "suspicious_title_keyword": 4, "responsibility_contains_requirement_marker": 4, "requirement_contains_responsibility_marker": 4,
    "quality_weak_missing_core_field": 3, "empty_responsibilities": 2, "oversized_single_responsibility": 2, "empty_skills": 1, "empty_education": 1, "empty_experience": 1,
    "quality_weak_tier": 0, "weak_public_source": 0,
}
HIGH_RISK = 4
#: Points of the tiers, of other rows, and what a point of risk costs.
TIER_POINTS, OTHER_POINTS, RISK_POINTS = {"strict": 100, "strict_plus": 90, "quality_weak": 75, "bootstrap": 60}, 50, 10
#: Directions that titles of weak sources name, tried in order around two patterns.
NAMED_FIRST = {"AI Infra": "ai infra|训练平台|推理平台|算力平台", "高性能计算": "hpc|高性能计算|gpu集群|gpu 集群"}
NAMED_LAST = {
    "网络与基础设施": "网络|基础设施|基础架构", "运维开发": "sre|devops|运维", "测试开发": "测试|qa", "算法工程": "算法|机器学习|深度学习|大模型", "客户端开发": "android|ios|客户端",
    "嵌入式开发": "嵌入式|驱动|bsp|固件", "前端开发": "前端|web前端|vue|react", "后端开发": "后端|后台|服务端|java|golang|python|php|.net|c#",
}


def filled(name: str) -> Column:
    return strip(text_or_empty(F.col(name)))


def any_of(c: Column, words: str) -> Column:
    """Whether one of the words, parted by bars, is part of the text."""
    return c.rlike("|".join(f"\\Q{w}\\E" for w in words.split("|")))


def of_meta(key: str) -> Column:
    """A value of the row's other data."""
    return text_or_empty(F.get_json_object("meta", f"$.{key}"))


def row_direction() -> Column:
    return effective_direction(F.col("labels.direction"), F.col("job_title"), F.col("clean_text"))


def has_skills() -> Column:
    return F.coalesce(F.size("labels.skills") > 0, F.lit(False))


def source_is_external() -> Column:
    return F.coalesce(F.col("source").rlike("^(?:hf_|github_)"), F.lit(False))


def training_allowed() -> Column:
    """External rows need an explicit leave."""
    return ~source_is_external() | ((of_meta("training_eligible") == "true") & F.lower(of_meta("intended_usage")).isin(*USABLE_FOR))


def clean_experience() -> Column:
    """The labelled years, empty where they are only a degree."""
    own = filled("labels.experience")
    return F.when(own.isin(*DEGREE_ONLY), "").otherwise(own)


#: What rules ask of a row.
ASKED = {
    "title": lambda: F.lower(filled("job_title")),
    "text": lambda: filled("clean_text"),
    "direction": row_direction,
    "label": lambda: filled("labels.direction"),
    "duties": lambda: filled("sections.responsibilities"),
    "demands": lambda: filled("sections.requirements"),
    "bonus": lambda: filled("sections.bonus") != "",
    "skills": lambda: F.greatest(F.coalesce(F.size("labels.skills"), F.lit(0)), F.lit(0)),
    "basic": lambda: has_skills() | (F.size(known_skills(filled("clean_text"), BASIC_SKILLS)) > 0),
    "degree": lambda: (filled("labels.education") != "") | (degree(filled("clean_text")) != ""),
    "years": lambda: (filled("labels.experience") != "") | (experience(filled("clean_text")) != ""),
    "school": lambda: filled("labels.education") != "",
    "worked": lambda: filled("labels.experience") != "",
    "really_worked": lambda: clean_experience() != "",
    "lines": lambda: F.size(F.filter(lines(filled("sections.responsibilities")), lambda x: strip(x) != "")),
    "language": lambda: F.lower(filled("language")),
    "source": lambda: text_or_empty(F.col("source")),
    "category": lambda: strip(of_meta("category")),
    "ready": lambda: F.coalesce(F.col("sft_ready"), F.lit(True)),
    "allowed": training_allowed,
}


def of_row(names: str, f) -> Column:
    """``f`` of a struct of what is asked. The struct is bound to a variable, so that each part is worked out once."""
    asked = F.struct(*(ASKED[n]().alias(n) for n in names.split()))
    return F.get(F.transform(F.array(asked), f), 0)


def title_excluded(t: Column) -> Column:
    return any_of(t, STRONG_AGAINST)


def _by_direction(t: Column, d: Column, words: dict[str, str]) -> Column:
    return cascade([(d == name, any_of(t, w)) for name, w in words.items()], F.lit(False))


def title_technical(t: Column, d: Column) -> Column:
    return any_of(t, STRONG_FOR) | _by_direction(t, d, HINTS)


def title_excused(t: Column, d: Column) -> Column:
    return _by_direction(t, d, EXCUSES)


def like_tech(name: Column) -> Column:
    return has(strip(text_or_empty(name)), LIKE_TECH)


def _short_technical(r: Column) -> Column:
    signal = r["years"] | (r["skills"] > 0) | r["degree"]
    return (r["source"] == SHORT_SOURCE) & (r["category"] == SHORT_CATEGORY) & F.length(r["text"]).between(120, 179) & (r["direction"] != "") & (r["lines"] >= 2) & signal


def short_technical() -> Column:
    """Short rows of one source that are still complete."""
    return of_row("source category text direction lines years skills degree", _short_technical)


def _complete(r: Column) -> Column:
    """Whether sections and signals make a row complete, or its markers and more signals, or it is a short technical one."""
    duties, demands, n = r["duties"] != "", r["demands"] != "", F.length(r["text"])
    signals = sum((c.cast("int") for c in (r["skills"] > 0, r["degree"], r["years"], r["bonus"])), F.lit(0))
    base = ((duties & demands) | ((n >= 180) & (duties | demands))) & (r["degree"] | r["years"] | (r["skills"] > 0))
    return base | (any_of(r["text"], MARKERS + "|加分项") & (n >= 180) & (signals >= 2)) | _short_technical(r)


def _chinese(r: Column, *unstated: str) -> Column:
    return r["language"].isin("zh", "zh-cn") | ((r["language"] == "") & r["source"].isin(*unstated))


_STRICT = "title text direction duties demands bonus skills degree years lines language source category ready"


def is_strict() -> Column:
    """Rows of trusted sources with a technical title, sections and signals."""

    def of(r: Column) -> Column:
        t, d = r["title"], r["direction"]
        named = (~title_excluded(t) | title_excused(t, d)) & title_technical(t, d)
        return _chinese(r, *TRUSTED_SOURCES) & r["ready"] & r["source"].isin(*TRUSTED_SOURCES) & (t != "") & (r["text"] != "") & (d != "") & named & _complete(r)

    return of_row(_STRICT, of)


def _rejection(r: Column) -> Column:
    t, d, parts = r["title"], r["direction"], (r["duties"] != "") | (r["demands"] != "")
    rules = [
        (~_chinese(r, SHORT_SOURCE), "language_not_zh"),
        (~r["ready"], "sft_not_ready"),
        (~r["source"].isin(*TRUSTED_SOURCES), "source_not_high_trust"),
        (t == "", "missing_title"),
        (r["text"] == "", "missing_clean_text"),
        (d == "", "missing_direction"),
        (title_excluded(t) & ~title_excused(t, d), "excluded_title"),
        (~title_technical(t, d), "missing_title_signal"),
        (_complete(r), "accepted"),
        (~parts, "missing_sections"),
        (F.length(r["text"]) < 180, "clean_text_too_short"),
        (~(r["degree"] | r["years"] | (r["skills"] > 0)), "missing_edu_exp_skill"),
    ]
    return first_rule(rules, "structure_or_signal_fail")


def rejection() -> Column:
    """The first reason why a row is not in the strict tier, or accepted."""
    return of_row(_STRICT, _rejection)


def is_weak() -> Column:
    """Rows of weak sources with a technical title, both sections, a degree, and years or skills."""

    def of(r: Column) -> Column:
        t, n = r["title"], F.length(r["text"])
        titled = any_of(t, TECH_TITLE) & any_of(t, WEAK_FOR) & ~any_of(t, WEAK_AGAINST)
        parts = (r["duties"] != "") & (r["demands"] != "") & any_of(r["text"], MARKERS)
        return (r["language"] == "zh") & r["source"].isin(*WEAK_SOURCES) & titled & (n >= 180) & parts & r["degree"] & (r["years"] | r["basic"]) & ((n >= 260) | r["basic"])

    return of_row("title text duties demands degree years basic language source", of)


def is_strict_plus() -> Column:
    """Rows with direction and degree, a long section, and years or skills; more skills for external sources."""

    def of(r: Column) -> Column:
        long = (F.length(r["duties"]) >= 40) | (F.length(r["demands"]) >= 40)
        signals = F.when(
            r["source"].rlike("^(?:hf_|github_)"), (r["skills"] >= 1) & (r["worked"] | (r["skills"] >= 2))
        ).otherwise(r["worked"] | (r["skills"] >= 1))
        return (r["label"] != "") & r["school"] & ~any_of(r["title"], LOW_TITLE) & (~any_of(r["text"], LOW_TEXT) | r["worked"]) & long & signals

    return of_row("title text label duties demands skills school worked source", of)


def is_bootstrap() -> Column:
    """Rows with a degree and two more signals; weak sources by rules of their own."""

    def of(r: Column) -> Column:
        duties, demands, n, years = r["duties"], r["demands"], r["skills"], r["worked"]
        some = ((duties != "") | (demands != "")) & ((r["lines"] > 0) | (F.length(duties) >= 60))
        weak = ~any_of(r["title"], LOW_TITLE_SHORT) & (~any_of(r["text"], LOW_TEXT) | years) & (n >= 1) & some & (
            years | ((n >= 2) & (F.length(r["text"]) >= 220))
        )
        signals = sum((c.cast("int") for c in (duties != "", demands != "", r["bonus"], n > 0, years)), F.lit(0))
        return r["school"] & F.when(r["source"].isin(*WEAK_SOURCES), weak).otherwise(signals >= 2)

    return of_row("title text duties demands bonus skills school worked lines source", of)


def worth_bootstrapping() -> Column:
    """Bootstrap rows that have a direction and any label."""
    return (filled("labels.direction") != "") & is_bootstrap()


def is_quality_weak() -> Column:
    """Rows of other sources with a direction, two skills, and a degree or years."""

    def of(r: Column) -> Column:
        longest = F.greatest(F.length(r["duties"]), F.length(r["demands"]))
        named = (r["title"] != "") & (r["text"] != "") & ~any_of(r["title"], LOW_TITLE) & ~any_of(r["title"], OTHER_TRADES)
        enough = (r["label"] != "") & (r["skills"] >= 2) & (r["school"] | r["really_worked"]) & (F.length(r["text"]) >= 180) & (longest >= 30)
        return named & enough & (~any_of(r["text"], LOW_TEXT) | (r["school"] & (longest >= 80)))

    return of_row("title text label duties demands skills school really_worked", of)


def _repair_reason(r: Column) -> Column:
    return F.when((r["label"] == "") & (r["direction"] != ""), "missing_direction").otherwise(_rejection(r))


def repair_reason() -> Column:
    """The reason for the rejection, or a missing direction where only the label lacks one."""
    return of_row(_STRICT + " label", _repair_reason)


def is_repairable() -> Column:
    """Trusted rows of technical titles that were rejected for what can be mended."""

    def of(r: Column) -> Column:
        n, signal, marked = F.length(r["text"]), r["years"] | (r["skills"] > 0) | r["degree"], any_of(r["text"], MARKERS)
        reason, parts = _repair_reason(r), (r["duties"] != "") | (r["demands"] != "")
        enough = {
            "missing_direction": (n >= 120) & signal, "missing_sections": (n >= 180) & marked & signal,
            "missing_edu_exp_skill": (n >= 180) & marked & parts, "clean_text_too_short": n.between(100, 179) & signal,
        }
        base = r["source"].isin(*TRUSTED_SOURCES) & (r["title"] != "") & (r["text"] != "") & like_tech(r["title"]) & (r["direction"] != "")
        return base & F.exists(F.array(reason), lambda why: cascade([(why == name, ok) for name, ok in enough.items()], F.lit(False)))

    return of_row(_STRICT + " label", of)


def is_weak_structured() -> Column:
    """Rows of weak sources that may be used and are structured."""

    def of(r: Column) -> Column:
        t, n, duties, demands = r["title"], F.length(r["text"]), r["duties"] != "", r["demands"] != ""
        titled = (F.length(t) >= 2) & ~any_of(t, STRONG_AGAINST) & (any_of(t, STRONG_FOR) | r["label"].isin(*STRUCTURED_DIRECTIONS))
        base = r["allowed"] & r["source"].isin(*WEAK_SOURCES) & (r["language"] == "zh") & (r["label"] != "")
        built = any_of(r["text"], FEWER_MARKERS) | (duties & demands)
        return base & titled & (n >= 140) & r["degree"] & built & ((n >= 220) | (r["skills"] > 0)) & (duties | demands | r["bonus"])

    return of_row("title text label duties demands bonus skills degree language source allowed", of)


def is_usable_public() -> Column:
    """Raw rows (raw_text, salary, meta) of public sources that may be used, with two of four fields."""
    raw, said, t = strip(text_or_empty(F.col("raw_text"))), F.lower(of_meta("language")), F.lower(filled("job_title"))
    signals = [
        (text_or_empty(F.col("salary")) != "") | raw.contains("薪资范围："),
        (of_meta("education") != "") | raw.contains("学历要求："),
        (of_meta("experience") != "") | (of_meta("work_year") != "") | raw.contains("经验要求："),
        raw.contains("岗位职责：") | raw.contains("职位描述："),
    ]
    allowed = (of_meta("training_eligible") == "true") & F.lower(of_meta("intended_usage")).isin(*USABLE_FOR) & ((said == "") | said.startswith("zh"))
    return allowed & (F.length(t) >= 2) & (F.length(raw) >= 120) & any_of(t, STRONG_FOR) & ~any_of(t, STRONG_AGAINST) & (
        sum((s.cast("int") for s in signals), F.lit(0)) >= 2
    )


def is_candidate() -> Column:
    """All English rows and others that are ready."""
    return (F.coalesce("language", F.lit("")) == "en") | F.coalesce(F.col("sft_ready"), F.lit(True))


def direction_of_title(named: Column, current: Column) -> Column:
    """The direction that a title of a weak source names, else the current one."""
    t = F.lower(text_or_empty(named))
    algorithm = has(t, ALGORITHM_ROLE) & ~has(t, APPLIED_ALGORITHM)
    rules = [(any_of(t, w), d) for d, w in NAMED_FIRST.items()] + [
        (algorithm, "算法工程"), (has(t, SECURITY_ROLE), "安全工程")
    ] + [(any_of(t, w), d) for d, w in NAMED_LAST.items()]
    return cascade(rules, text_or_empty(current))


def _leaked(part: Column, other: Column, markers: tuple[str, ...]) -> tuple[Column, Column]:
    """(part, other) with what follows the first listed marker that stands in the part moved to the other."""
    rest, more = part, other
    for marker in reversed(markers):
        at = F.instr(part, marker)
        before, after = F.substring(part, F.lit(1), at - 1), F.substring(part, at + len(marker), F.length(part))
        moved = strip(F.concat(F.lit(f"{marker}："), F.regexp_replace(after, "^[ ：:;；]+|[ ：:;；]+$", "")))
        found = at > 0
        rest = F.when(found, F.regexp_replace(before, "^[ ：:;；\n]+|[ ：:;；\n]+$", "")).otherwise(rest)
        more = F.when(found, strip(F.concat_ws("\n", F.when(other != "", other), moved))).otherwise(more)
    return rest, more


def separated(sections: Column) -> Column:
    """Sections with demands that leaked into the duties moved, and then the other way round."""
    duties, demands = _leaked(strip(text_or_empty(sections["responsibilities"])), strip(text_or_empty(sections["requirements"])), DEMAND_MARKERS)

    def back(s: Column) -> Column:
        demands, duties = _leaked(s["requirements"], s["responsibilities"], DUTY_MARKERS)
        return F.struct(duties.alias("responsibilities"), demands.alias("requirements"), s["bonus"].alias("bonus"))

    first = F.struct(duties.alias("responsibilities"), demands.alias("requirements"), strip(text_or_empty(sections["bonus"])).alias("bonus"))
    return F.get(F.transform(F.array(first), back), 0)


def sanitized(rows: DataFrame) -> DataFrame:
    """Rows without degrees as years, with directions of weak sources by title, and with separated sections."""
    d = F.when(
        source_is_external(), direction_of_title(strip(text_or_empty(F.col("job_title"))), filled("labels.direction"))
    ).otherwise(F.col("labels.direction"))
    labels = F.struct(
        d.alias("direction"), F.col("labels.skills").alias("skills"), clean_experience().alias("experience"),
        F.col("labels.education").alias("education")
    )
    return rows.withColumns({"labels": labels, "sections": separated(F.col("sections"))})


def risk_reasons(answer: Column, prompt: Column, tier: Column, source: Column) -> Column:
    """Reasons that make a sample risky, in order. ``answer`` is the JSON of the sample; one that isn't JSON has that reason alone."""
    parsed = F.from_json(answer, "`核心职责` array<string>, `必备技能` array<string>, `学历要求` string, `经验要求` string, `任职要求` string")
    name = strip(F.regexp_extract(text_or_empty(prompt), r"(?U)岗位名称[：:]\s*([^\n]+)", 1))
    none = F.array().cast("array<string>")

    def of(p: Column) -> Column:
        duties, skills = F.coalesce(p["核心职责"], none), F.coalesce(p["必备技能"], none)
        no = lambda c: text_or_empty(c) == ""
        weak = text_or_empty(tier) == "quality_weak"
        found = {
            "quality_weak_tier": weak,
            "weak_public_source": text_or_empty(source).rlike("^(?:hf_|github_)"),
            "suspicious_title_keyword": any_of(name, SUSPICIOUS_TITLE),
            "empty_responsibilities": F.size(duties) == 0,
            "empty_skills": F.size(skills) == 0,
            "empty_education": no(p["学历要求"]),
            "empty_experience": no(p["经验要求"]),
            "responsibility_contains_requirement_marker": any_of(F.array_join(duties, "\n"), "|".join(DEMAND_MARKERS)),
            "requirement_contains_responsibility_marker": any_of(text_or_empty(p["任职要求"]), "|".join(DUTY_MARKERS)),
            "oversized_single_responsibility": (F.size(duties) == 1) & (F.length(F.get(duties, 0)) > 500),
            "quality_weak_missing_core_field": weak & (no(p["学历要求"]) | (F.size(skills) == 0)),
        }
        return F.array_compact(F.array(*(F.when(ok, F.lit(reason)) for reason, ok in found.items())))

    reasons = F.get(F.transform(F.array(parsed), of), 0)
    return F.when(F.try_parse_json(answer).isNull(), F.array(F.lit("invalid_assistant_json"))).otherwise(reasons)


def risk_score(reasons: Column) -> Column:
    """The weights of the reasons in sum; unknown ones weigh 1."""
    weights = F.create_map(*(F.lit(x) for pair in RISKS.items() for x in pair))
    return F.aggregate(reasons, F.lit(0), lambda a, r: a + F.coalesce(F.try_element_at(weights, r), F.lit(1)))


def is_high_risk(reasons: Column, threshold: int = HIGH_RISK) -> Column:
    return risk_score(reasons) >= threshold


def sample_source(meta_source: Column, row_id: Column) -> Column:
    """The source of a sample, else what its id begins with."""
    own = text_or_empty(row_id)
    plain = F.split_part(F.regexp_replace(own, "_jd_parse", ""), F.lit("_"), F.lit(1))
    rules = [
        (text_or_empty(meta_source) != "", meta_source), (own.startswith("hf_job_educational_train"), WEAK_SOURCES[0]),
        (own.startswith("hf_job_educational_validation"), WEAK_SOURCES[1]), (own.startswith("github_workaggregation_test"), WEAK_SOURCES[4])
    ]
    return cascade(rules, plain)


def quality_score(tier: Column, risk: Column) -> Column:
    """The points of the tier less those of the risk, 0 at least."""
    points = cascade([(tier == name, F.lit(p)) for name, p in TIER_POINTS.items()], F.lit(OTHER_POINTS))
    return F.greatest(F.lit(0), points - risk * RISK_POINTS)


def select_tiers(
    rows: DataFrame, total: int, *, max_risk: int = HIGH_RISK - 1, max_weak_rate: float = 0.4, excluded: DataFrame | None = None,
    stage_limits: dict[int, int] | None = None, seed: str = "42"
) -> DataFrame:
    """At most ``total`` rows of ``rows`` (id, stage, risk, experience, weak boolean), the stages in turn.

    A row counts by its first stage only; risky ones and those of ``excluded`` (id) are left out. Within a stage rows with
    years come first, then those of less risk, then by a hash of the id; stage 0 keeps the order of ids. Of weak rows only
    the first ``max_weak_rate`` of the total count, and ``stage_limits`` bound what single stages add. The limits make the
    result bounded, so ranks are taken after a cut of the first ``total`` rows of each stage and kind.
    """
    if not 0.0 <= max_weak_rate <= 1.0:
        raise ValueError("max_weak_rate must be between 0 and 1")
    key = F.regexp_replace("id", "_jd_parse$", "")
    fit = rows.filter((F.col("id") != "") & (F.col("risk") <= max_risk))
    if excluded is not None:
        gone = excluded.select(F.regexp_replace("id", "_jd_parse$", "").alias("gone")).distinct()
        fit = fit.join(gone, key == F.col("gone"), "left_anti")
    order = F.struct(
        "stage", F.when(F.col("stage") > 0, F.col("experience") == "").otherwise(False).alias("bare"),
        F.when(F.col("stage") > 0, F.col("risk")).otherwise(0).alias("r"),
        F.when(F.col("stage") > 0, hash_order(seed, F.col("id"))).otherwise("").alias("h"), F.col("id").alias("i")
    )
    once = fit.withColumn("order", order).groupBy("id").agg(F.min_by(F.struct(*fit.columns, "order"), "order").alias("row")).select("row.*")
    few = once.withColumn("rn", F.row_number().over(W.partitionBy("stage", "weak").orderBy("order"))).filter(F.col("rn") <= total)
    limits = cascade([(F.col("stage") == s, F.lit(n)) for s, n in (stage_limits or {}).items()], F.lit(total))
    weak_rank = F.row_number().over(W.partitionBy("weak").orderBy("order"))
    few = few.withColumn("weak_rank", weak_rank).filter(~F.col("weak") | (F.col("weak_rank") <= int(total * max_weak_rate)))
    few = few.withColumn("in_stage", F.row_number().over(W.partitionBy("stage").orderBy("order"))).filter(F.col("in_stage") <= limits)
    return few.orderBy("order").limit(total).select(*rows.columns)


def rejection_summary(rows: DataFrame, by: str, groups: int = 20, reasons: int = 5) -> DataFrame:
    """The groups of ``by`` with most rejected rows of ``rows`` (reason), each with its commonest reasons."""
    bad = rows.filter("reason <> 'accepted'")
    pairs = bad.groupBy(by, "reason").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy(by).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), by).limit(groups)
    ranked = pairs.join(F.broadcast(totals), by).withColumn(
        "rn", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "reason"))
    ).filter(F.col("rn") <= reasons)
    return ranked.select(by, "total", "reason", "n")


def rejection_samples(rows: DataFrame, per_reason: int, seed: str = "42") -> DataFrame:
    """Some rejected rows of each reason, by a hash of the id."""
    ranked = rows.filter("reason <> 'accepted'").withColumn("rn", F.row_number().over(W.partitionBy("reason").orderBy(hash_order(seed, F.col("id")))))
    return ranked.filter(F.col("rn") <= per_reason).drop("rn").orderBy("reason", "source", "job_title")
