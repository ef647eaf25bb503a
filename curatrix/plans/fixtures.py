"""Queries on literal rows, one for each operator that the general tables can't exercise, with the results they must give.

The rows are small cases in the operators' own layouts. Their SQL states the expected results, worked out by hand from the
operators' definitions, as a table of values.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.values import normalized_hash
from curatrix.operators import adverts, answers, audits, evaluation, fields, pairing, preferences, privacy, resumes, sections, spans, tiers
from curatrix.sources import imports
from curatrix.sources.folders import shared_copy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = {"Python": ["python"], "FastAPI": [], "RAG": ["检索增强"], "Java": ["java"], "MySQL": ["mysql"], "Redis": [], "PyTorch": ["pytorch"]}


def quoted(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of values; ``columns`` are names with types."""
    named = [c.split() for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    return "select " + ", ".join(
        f"cast(c{i} as {t}) as {n}" for i, (n, t) in enumerate(named)
    ) + f" from (values {body}) as v({', '.join(f'c{i}' for i in range(len(named)))})"


def fixture(columns: str, rows: list[tuple]):
    def add(f: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark)

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = values(columns, rows)
        return f

    return add


def cases(spark: SparkSession, rows: list[tuple], columns: str = "") -> DataFrame:
    """Rows with their number as ``i``."""
    columns = columns or ", ".join(f"c{k} string" for k in range(len(rows[0])))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {columns}")


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def dumped(x) -> str:
    return json.dumps(x, ensure_ascii=False)


TITLES = [
    ("百度集团公关（支持智能驾驶事业群）", "岗位职责：负责品牌传播、公关合作和对外沟通。", ""), ("国际费用结算", "岗位职责：负责费用结算、单据处理和流程跟进。", ""), ("微生物研究员", "负责菌株培养、微生物检测和实验结果记录。", ""),
    ("机器视觉研究员", "负责计算机视觉算法、深度学习模型训练和推理优化。", "算法工程"), ("鸿蒙安全研究员", "负责操作系统漏洞挖掘、安全攻防和检测工具开发。", "安全工程"), ("食品安全方向研究员", "负责食品安全风险评估和微生物实验研究。", ""),
    ("高级研究员", "研究游戏大模型架构，负责模型训练、多模态和扩散模型方案。", "算法工程"), ("AI行业研究员", "跟踪生成式AI和大模型市场趋势，撰写投资研究和赛道分析报告。", ""), ("硬件研发工程师", "负责电源板原理图设计、硬件调试和EMC测试。", "硬件研发"),
    ("AIGC产品实习生", "负责用户需求分析、产品方案和版本迭代，协同算法团队。", "产品经理"), ("OLAP引擎研发", "岗位职责：负责 OLAP 引擎研发、数据库优化和分布式查询性能调优。", "后端开发"),
    ("Text To Speech (TTS) Algorithm Engineer", "岗位职责：负责 TTS 模型训练、推理优化和语音生成效果提升。", "算法工程"), ("微信安全-多模态大模型高级算法工程师", "岗位职责：负责多模态模型训练和内容理解算法研发。", "算法工程"),
    ("B端招商入驻研发岗", "岗位职责：负责平台招商系统研发、服务端能力建设和数据库设计。", "后端开发"), ("网络规划专家", "岗位职责：负责网络规划、基础架构设计与网络容量建设。", "网络与基础设施"), (
        "AI Infra研发工程师", "岗位职责：负责机器学习平台、训练平台和推理平台建设。", "AI Infra"
    ),
    (
        "高性能计算研发工程师", "岗位职责：负责高性能计算集群、分布式计算和 GPU 集群优化。", "高性能计算"
    ), ("智驾系统架构工程师", "岗位职责：负责智驾系统架构设计、软件模块集成和功能开发。", "汽车软件/智驾研发"), ("秒送物流SRE", "岗位职责：负责系统稳定性、发布巡检、监控告警和自动化运维平台建设。", "运维开发"),
    ("大模型应用算法工程师", "负责智能客服与工作流落地", "AI应用开发"), ("大模型应用算法工程师", "负责后训练与强化学习", "算法工程"), ("工作人员", "使用 spark、flink 和数仓", "数据开发"), (None, None, ""),
]


@fixture("i bigint, direction varchar", [(i, d) for i, (*_, d) in enumerate(TITLES)])
def f01_directions_of_adverts(spark):
    return cases(spark, TITLES).select("i", fields.direction(F.col("c0"), F.col("c1")).alias("direction"))


NAMED = [("后端", "岗位名称：前端开发工程师\n写页面", "前端开发"), ("", "使用 spark 和 flink", "数据开发"), ("AI应用开发", "负责模型训练", "算法工程")]


@fixture("i bigint, direction varchar", [(i, d) for i, (*_, d) in enumerate(NAMED)])
def f02_canonical_directions(spark):
    return cases(spark, NAMED).select("i", fields.canonical_direction(F.col("c0"), F.col("c1")).alias("direction"))


YEARS = [
    (
        "任职要求：具备 3 年以上 Android 开发经验", "具备 3 年以上 Android 开发经验", ""
    ), ("至少两年 iOS 开发经验", "至少两年 iOS 开发经验", ""), ("工作年限3～5年", "3～5年", ""), ("任职资格：1-2024年10月1日至2025年9月30日期间毕业，本科及以上学历", "", "本科及以上"),
    ("经验要求：3年以上，其他", "3年以上", ""), ("相关专业研究生及以上学历", "", "研究生及以上学历"), ("专科及以上学历，五年以上经验", "五年以上经验", "专科及以上学历"), ("招聘要求：博士研究生学历", "", "博士研究生学历"), ("硕士优先", "", "硕士优先"),
    ("学士及学士以上的学历", "", "学士及学士以上的学历"), ("本科及以上学历，计算机专业，硕士优先", "", "本科及以上"), (None, "", ""),
]


@fixture("i bigint, years varchar, degree varchar", [(i, y, d) for i, (_, y, d) in enumerate(YEARS)])
def f03_years_and_degrees(spark):
    return cases(spark, YEARS).select("i", fields.experience(F.col("c0")).alias("years"), fields.degree(F.col("c0")).alias("degree"))


METAS = [
    ('{"experience": "不限"}', "经验不限"), ('{"experience": "", "work_year": "3-5年"}', "3-5年"), ('{"experience": "abc", "workYear": "5年及以上"}', "5年及以上"),
    ("{}", ""), ("x", "")
]


@fixture("i bigint, years varchar", [(i, y) for i, (_, y) in enumerate(METAS)])
def f04_years_of_other_data(spark):
    return cases(spark, METAS).select("i", fields.experience_of_meta(F.col("c0")).alias("years"))


ENGLISH = [
    ("Frontend Developer", "React work, a PhD or master's degree, 5+ years  of experience; x", "前端开发", "博士", "5+ years of experience"),
    ("Data Engineer", "etl with android, a doctorate, else a Bachelor's degree, minimum 3 years working. y", "", "本科", "minimum 3 years working"),
    ("Clerk", "files", "", "", "")
]


@fixture("i bigint, direction varchar, degree varchar, years varchar", [(i, *r[2:]) for i, r in enumerate(ENGLISH)])
def f05_english_adverts(spark):
    t, x = F.col("c0"), F.col("c1")
    return cases(spark, ENGLISH).select(
        "i", fields.english_direction(t, x).alias("direction"), fields.english_degree(x).alias("degree"), fields.english_experience(x).alias("years")
    )


LISTS = [("- a\n\n•  b \n* c", "a|b|c", "a|b|* c"), ("- 写代码\n任职要求：x\n • 测试 -", "写代码|任职要求：x|测试 -", "写代码|测试"), (None, "", "")]


@fixture("i bigint, bullets varchar, duties varchar", [(i, a, b) for i, (_, a, b) in enumerate(LISTS)])
def f06_items_of_lists(spark):
    return cases(spark, LISTS).select("i", joined(fields.bullets(F.col("c0"))).alias("bullets"), joined(fields.duties(F.col("c0"))).alias("duties"))


BODY = "岗位职责：\n负责后端服务开发与性能优化，保障系统稳定运行\n参与数据库设计和代码评审，推动工程质量提升\n任职要求：\n本科及以上学历，3年以上后端开发经验\n熟悉 Python、MySQL，具备良好的沟通能力" + "，持续学习新技术" * 12
ZH = '{"language": "zh"}'
WEAK = '{"language": "zh", "training_eligible": true, "intended_usage": "weak_supervision_only"}'
RAW = [
    ("a", "zhaopin.jd.com", "后端开发工程师", "京东", "北京", "", BODY, ZH), (
        "b", "zhaopin.jd.com", "后端开发工程师（市场）", "京东", "", "", BODY, ZH
    ), ("c", "x.com", "后端开发工程师", "", "", "", BODY, ZH),
    ("d", "zhaopin.jd.com", "后端开发工程师", "", "", "", "短文本", ZH), ("e", "zhaopin.jd.com", "后端开发工程师", "", "", "", BODY, '{"language": "en"}'), (
        "f", "hf_job_educational_train_2026_05_17", "python开发工程师", "", "", "", BODY, WEAK
    ),
    ("g", "zhaopin.jd.com", "后端开发工程师", None, None, None, None, "no json"), (
        "h", "zhaopin.jd.com", "后端开发工程师", "", "", "", BODY, '{"language": "zh", "sft_ready": false}'
    ),
]
RAW_COLUMNS = "id string, source string, job_title string, company string, location string, salary string, raw_text string, meta string"


def clean(spark: SparkSession) -> DataFrame:
    return adverts.normalized(spark.createDataFrame(RAW, RAW_COLUMNS), VOCABULARY)


_FULL = ("后端开发", "Python|MySQL", "3年以上后端开发经验", "本科及以上", 2)


@fixture("id varchar, direction varchar, skills varchar, years varchar, degree varchar, n_duties bigint, ready boolean", [
    *((i, *_FULL, True) for i in "abce"), ("d", "后端开发", "", "", "", 0, True), ("f", *_FULL, True), ("g", "后端开发", "", "", "", 0, True), ("h", *_FULL, False),
])
def f07_normalized_adverts(spark):
    n = F.size(fields.duties(F.col("sections.responsibilities"))).cast("long")
    return clean(spark).select(
        "id", F.col("labels.direction").alias("direction"), joined(F.col("labels.skills")).alias("skills"), F.col("labels.experience").alias("years"),
        F.col("labels.education").alias("degree"), n.alias("n_duties"), F.col("sft_ready").alias("ready")
    )


@fixture("id varchar, strict boolean, weak boolean, reason varchar", [
    ("a", True, False, "accepted"), ("b", False, False, "excluded_title"), ("c", False, False, "source_not_high_trust"), ("d", False, False, "missing_sections"), ("e", False, False, "language_not_zh"),
    ("f", False, True, "source_not_high_trust"), ("g", False, False, "language_not_zh"), ("h", False, False, "sft_not_ready"),
])
def f08_strict_and_weak_tiers(spark):
    return clean(spark).select("id", tiers.is_strict().alias("strict"), tiers.is_weak().alias("weak"), tiers.rejection().alias("reason"))


@fixture("id varchar, strict_plus boolean, bootstrap boolean, quality_weak boolean, structured boolean, allowed boolean, candidate boolean", [
    *(
        (i, True, True, True, False, True, True) for i in "abce"
    ), ("d", False, False, False, False, True, True), ("f", True, True, True, True, True, True), ("g", False, False, False, False, True, True), ("h", True, True, True, False, True, False),
])
def f09_other_tiers(spark):
    return clean(spark).select(
        "id", tiers.is_strict_plus().alias("strict_plus"), tiers.is_bootstrap().alias("bootstrap"), tiers.is_quality_weak().alias("quality_weak"),
        tiers.is_weak_structured().alias("structured"), tiers.training_allowed().alias("allowed"), tiers.is_candidate().alias("candidate")
    )


REPAIRS = [("训练平台研发", "AI Infra"), ("数据安全岗", "安全工程"), ("web前端", "前端开发"), ("文员", "x"), ("C# 岗", "后端开发"), ("推荐算法专家", "算法工程"), ("网络运维", "网络与基础设施")]


@fixture("i bigint, direction varchar, duties varchar, demands varchar", [(i, d, "写代码", "会写\n任职要求：本科") for i, (_, d) in enumerate(REPAIRS)])
def f10_repaired_directions_and_sections(spark):
    parts = F.struct(F.lit("写代码；任职要求：本科").alias("responsibilities"), F.lit("会写").alias("requirements"), F.lit("").alias("bonus"))
    return cases(spark, REPAIRS).select(
        "i", tiers.direction_of_title(F.col("c0"), F.lit("x")).alias("direction"), tiers.separated(parts)["responsibilities"].alias("duties"),
        tiers.separated(parts)["requirements"].alias("demands")
    )


_GOOD = dumped({"核心职责": ["a", "b"], "必备技能": ["x"], "学历要求": "本科", "经验要求": "3年"})
_BAD = dumped({"核心职责": ["任职要求" + "x" * 500]})
RISKS = [
    ("{", "", "", "", "invalid_assistant_json", 5, 0), (_GOOD, "岗位名称：工程师", "strict", "x", "", 0, 100),
    (
        _BAD, "岗位名称：讲师\n", "quality_weak", "hf_x",
        "quality_weak_tier|weak_public_source|suspicious_title_keyword|empty_skills|empty_education|empty_experience|responsibility_contains_requirement_marker|oversized_single_responsibility|quality_weak_missing_core_field",
        16, 0
    ),
]


@fixture("i bigint, reasons varchar, risk bigint, high boolean, quality bigint", [(i, r[4], r[5], r[5] >= 4, r[6]) for i, r in enumerate(RISKS)])
def f11_risks(spark):
    df = cases(spark, [r[:4] for r in RISKS]).withColumn("r", tiers.risk_reasons(F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3")))
    n = tiers.risk_score(F.col("r"))
    return df.select(
        "i", joined(F.col("r")).alias("reasons"), n.cast("long").alias("risk"), tiers.is_high_risk(F.col("r")).alias("high"),
        tiers.quality_score(F.col("c2"), n).cast("long").alias("quality")
    )


@fixture(
    "id varchar, roles varchar, asked varchar, answer varchar, n_duties bigint",
    [("a_jd_parse", "system|user|assistant", "岗位名称：后端开发工程师|公司：京东|工作地点：北京", dumped({"岗位方向": "后端开发", "经验要求": "3年以上后端开发经验", "学历要求": "本科及以上", "必备技能": "[\"Python\",\"MySQL\"]"}), 2)]
)
def f12_advert_samples(spark):
    s = adverts.advert_samples(clean(spark).filter("id = 'a'"))
    answer, user = F.element_at("messages", 3)["content"], F.element_at("messages", 2)["content"]
    told = F.concat(
        F.lit('{"岗位方向": "'), F.get_json_object(answer, "$.岗位方向"), F.lit('", "经验要求": "'), F.get_json_object(answer, "$.经验要求"), F.lit('", "学历要求": "'),
        F.get_json_object(answer, "$.学历要求"), F.lit('", "必备技能": "'), F.replace(F.get_json_object(answer, "$.必备技能"), F.lit('"'), F.lit('\\"')),
        F.lit('"}')
    )
    head = joined(F.slice(F.split(F.regexp_replace(user, "(?s)^.*?JD：\n", ""), "\n"), 1, 3))
    return s.select(
        "id", joined(F.transform("messages", lambda m: m["role"])).alias("roles"), head.alias("asked"), told.alias("answer"),
        F.size(F.from_json(F.get_json_object(answer, "$.核心职责"), "array<string>")).cast("long").alias("n_duties")
    )


@fixture("id varchar, origin varchar", [("a", "strict_manual"), ("q", "public_candidate"), ("s", "supplemental_candidate")])
def f13_combined_pools(spark):
    rows = shared_copy(clean(spark), "normalized")
    manual = shared_copy(adverts.manual_pool(rows), "pool")
    other = manual.withColumns({"id": F.lit("q"), "job_title": F.lit("t")})
    more = manual.withColumns({"id": F.lit("s"), "company": F.lit("z"), "meta": F.lit("{}")})
    both = adverts.combined_pool(rows, other.unionByName(manual.withColumn("id", F.lit("p"))), more)
    return both.select("id", F.get_json_object("meta", "$.pool_origin").alias("origin"))


@fixture("id varchar, tier varchar, quality bigint", [("a", "strict", 100), ("c", "strict_plus", 90), ("f", "strict_plus", 90)])
def f14_quality_dataset(spark):
    rows = clean(spark)
    candidates = rows.filter("id in ('c', 'f')").select(
        "id", "source", "job_title", "company", "location", "salary", F.col("clean_text").alias("raw_text"), "meta"
    )
    return adverts.quality_dataset(rows, candidates, VOCABULARY, 10).select("id", "tier", F.col("quality").cast("long").alias("quality"))


SITE = [("后端开发工程师", "北京·海淀·上地", "20-30K", "示例公司", "3年", "本科", "五险一金"), ("", "上海", "", "", "", "", ""), ("测试", "None", None, "甲", "", "", "")]


@fixture("job_title varchar, location varchar, city varchar, detail varchar, raw_text varchar", [
    (
        "后端开发工程师", "北京·海淀·上地", "北京", "海淀 / 上地", "岗位名称：后端开发工程师\n公司名称：示例公司\n工作地点：北京·海淀·上地\n薪资范围：20-30K\n经验要求：3年\n学历要求：本科\n福利标签：五险一金"
    ), ("测试", "", "", "", "岗位名称：测试\n公司名称：甲"),
])
def f15_job_site_rows(spark):
    df = spark.createDataFrame(
        SITE, "job_name string, job_area string, job_salary string, com_name string, work_year string, education string, job_benefits string"
    )
    m = lambda k: F.get_json_object("meta", f"$.{k}").alias(k.split("_")[-1])
    return imports.job_site_rows(df, "s", "u", "t").select("job_title", "location", m("job_area_city"), m("job_area_detail"), "raw_text")


@fixture("id varchar, company varchar, raw_text varchar", [("agg", "站点", "岗位名称：测试\n来源站点：站点\n关键词：词\n工作地点：上海\n经验要求：1年\n学历要求：大专\n公司性质：国企\n行业标签：IT\n职位描述：做事")])
def f16_collected_rows(spark):
    df = spark.createDataFrame(
        [("测试", "上海", "None", "1年", "大专", "国企", "IT", "站点", "词", "做事")],
        "title string, place string, salary string, experience string, education string, companytype string, industry string, provider string, keyword string, description string"
    )
    return imports.aggregated_rows(df, "agg", "u", "t").select(F.split_part("id", F.lit("_"), F.lit(1)).alias("id"), "company", "raw_text")


_USER = "<岗位名称>后端开发工程师</岗位名称><岗位描述>负责 Java 服务开发，本科及以上学历。</岗位描述><学历描述>本科</学历描述>"


@fixture("id varchar, label varchar, raw_text varchar", [("hf_123", "本科", "岗位名称：后端开发工程师\n任务类型：从岗位中提取学历\n岗位描述：\n负责 Java 服务开发，本科及以上学历。\n学历提示：本科")])
def f17_degree_task_rows(spark):
    df = spark.createDataFrame([(123, _USER, "本科"), (5, _USER, None)], "job_id long, user string, assistant string")
    return imports.degree_task_rows(df, "hf", "u", "t", min_chars=10).select("id", F.get_json_object("meta", "$.education_label").alias("label"), "raw_text")


@fixture(
    "id varchar, location varchar, salary varchar, head varchar",
    [("1", "Berlin | Rome", "1.5 EUR/year", "岗位名称：Backend Engineer\n公司标识：acme\n部门：R&D\n工作地点：Berlin | Rome\n远程：是\n薪资范围：1.5 EUR/year\n职位描述：\na & b")]
)
def f18_open_offer_rows(spark):
    kind = "id string, title string, department string, description_html string, locations array<string>, salary_min double, salary_max double, salary_currency string, salary_period string, remote boolean, source_slug string"
    rows = [
        ("1", "Backend Engineer", "R&D", "<p>a &amp; b</p>" + "x" * 600, [" Berlin ", "", "Rome"], 1.5, None, "EUR", "year", True, "acme"),
        ("2", "Sales Engineer", "", "x" * 700, None, None, None, None, None, None, "acme")
    ]
    return imports.open_offer_rows(spark.createDataFrame(rows, kind), "open", "src", "t").select(
        "id", "location", "salary", F.regexp_replace("raw_text", "\nx+$", "").alias("head")
    )


POSTS = [
    (
        "tencent", {"PostId": 7, "RecruitPostName": "后台", "LocationName": "深圳", "Responsibility": "写", "RequireWorkYearsName": "三年"}, "tencent_7",
        "岗位名称：后台\n工作地点：深圳\n岗位职责：\n写\n经验要求：三年", True
    ),
    ("baidu", {"postId": "b1", "name": " 研发 ", "workContent": "做", "serviceCondition": "会"}, "baidu_b1", "岗位名称：研发\n公司名称：百度\n岗位职责：\n做\n任职要求：\n会", True),
    ("jd", {"requirementId": 3, "positionId": 4, "positionName": "店长", "jobTypeCode": "yanfa"}, "jd_careers_3", "岗位名称：店长\n公司名称：京东\n岗位职责：\n任职要求：", True),
    (
        "meituan", {"jobUnionId": 9, "name": "产品经理", "jobFamily": "产品类", "cityList": [{"name": "北京"}, {"name": "上海"}], "jobDuty": "d"}, "meituan_9",
        "岗位名称：产品经理\n公司名称：美团\n职位类别：产品类\n工作地点：北京 / 上海\n部门介绍：\n岗位职责：\nd\n任职要求：\n优先条件：\n职位亮点：", True
    ),
    ("didi", {"jdId": "d2", "jobName": "司机", "jobType": "运营"}, "didi_d2", "岗位名称：司机\n公司名称：滴滴\n职位类别：运营\n岗位职责：\n任职要求：", False),
    ("ctrip", {"id": 5, "jobTitle": "客服", "jobFamilyGroupCode": "JFG_41"}, "ctrip_5", "岗位名称：客服\n公司名称：携程\n职位类别编码：JFG_41\n职位描述：", False),
]


@fixture("id varchar, raw_text varchar, technical boolean", [p[2:] for p in POSTS])
def f19_posts_of_portals(spark):
    parts = [imports.post_rows(spark.createDataFrame([(dumped(p),), ("{}",)], "post string"), imports.PORTALS[name], "t") for name, p, *_ in POSTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "raw_text", (F.get_json_object("meta", "$.sft_ready") == "true").alias("technical"))


@fixture(
    "id varchar, location varchar, salary varchar, url varchar, technical boolean",
    [("moka_org_social_x1", "中国 / 杭州", "10-20K", "https://app.mokahr.com/social-recruitment/org/12#/", True)]
)
def f20_posts_of_boards(spark):
    job = {
        "id": "x1", "title": "数据工程师", "description": "<p>负责数据平台建设与维护</p>", "locations": [{"country": "中国", "city": "杭州"}] * 2, "minSalary": 10,
        "maxSalary": 20, "minExperience": 3
    }
    rows = imports.board_rows(spark.createDataFrame([(dumped(job),), ("{}",)], "post string"), "org", "公司", "social", "s", "u", "t", site=12)
    return rows.select("id", "location", "salary", "url", (F.get_json_object("meta", "$.sft_ready") == "true").alias("technical"))


_LIST = '<tr> <td class="first"><a href="https://hr.xiaomi.com/job/view/42">Go &amp; C<span class="hot-tip"></span></a></td> <td>研发</td> <td>Beijing</td> <td>2026-01-01</td> </tr>'
_DETAIL = '<td class="details-title require">工作职责：</td> <td class="job-details" colspan="3">写<br/>测</td><td class="details-title">工作地点：</td><td class="details-list">wuhan</td>'


@fixture("id varchar, location varchar, raw_text varchar", [("xiaomi_42", "武汉", "岗位名称：Go & C\n公司名称：小米\n工作地点：武汉\n职位类别：研发\n发布日期：2026-01-01\n岗位职责：\n写\n测\n任职要求：")])
def f21_list_and_detail_pages(spark):
    rows = imports.list_rows(spark.createDataFrame([(_LIST,)], "html string")).withColumn("fields", imports.detail_fields(F.lit(_DETAIL)))
    return imports.detail_rows(rows, "t", "list").select("id", "location", "raw_text")


@fixture("text varchar, target varchar, skills varchar, education varchar", [("正文", "算法", "a|b", "x|y")])
def f22_imported_resumes(spark):
    df = spark.createDataFrame(
        [(0, ("正文",), "算法", ["a", None, " b "], "x、y"), (1, ("None",), "", None, None)],
        "index int, body struct<text:string>, job string, skills array<string>, edu string"
    )
    rows = imports.convert_rows(
        df,
        {"name": "s", "schema": "resume_parse_rows", "mapping": {"text": "body.text", "target_job": "job", "skills": "skills", "education": "edu"}}
    )
    return rows.select(
        "text", F.col("label")["目标岗位"].alias("target"), joined(F.col("label")["核心技能"]).alias("skills"),
        joined(F.col("label")["教育背景"]).alias("education")
    )


@fixture("text varchar, tags varchar", [("张三", "B-NAME|0")])
def f23_imported_tags(spark):
    df = spark.createDataFrame([(0, ["张", "三"], [7, 0]), (1, [], [])], "index int, tokens array<string>, tags array<int>")
    rows = imports.convert_rows(df, {"name": "n", "schema": "resume_ner_rows", "mapping": {"tokens": "tokens", "tags": "tags"}, "tag_names": {7: "B-NAME"}})
    return rows.select("text", joined(F.col("ner_tags")).alias("tags"))


@fixture("jd_text varchar, resume_text varchar, label varchar, license varchar", [("j", "r", "good", "unconfirmed")])
def f24_imported_pairs(spark):
    df = spark.createDataFrame([(0, "j", "r", "good"), (1, "j", "", "x")], "index int, a string, b string, c string")
    rows = imports.convert_rows(df, {"name": "m", "schema": "match_pair_rows", "mapping": {"jd_text": "a", "resume_text": "b", "label": "c"}})
    return rows.select("jd_text", "resume_text", F.col("label.raw_label").alias("label"), F.col("meta.license_status").alias("license"))


_RESUME = "# 张三\n## 教育背景\n- **本科** 某大学\n---\n## 专业技能\nPython\nx\n## 教育经历\n硕士"


@fixture("target varchar, education varchar, skills varchar", [("后端", "本科 某大学|硕士", "Python")])
def f25_written_resumes(spark):
    df = spark.createDataFrame([(_RESUME, ("后端",)), ("  ", None)], "content string, metadata struct<position:string>")
    return imports.written_resumes(df, "w").select(
        F.col("label")["目标岗位"].alias("target"), joined(F.col("label")["教育背景"]).alias("education"), joined(F.col("label")["核心技能"]).alias("skills")
    )


_ADVERT = {"加分项": [], "学历要求": "本科", "岗位方向": "后端开发", "必备技能": ["Python"], "核心职责": ["写代码", "测试"], "经验要求": "3年"}


def compact(x: dict) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@fixture("strategy varchar, worse varchar", [
    (
        "unexpected_field", compact(_ADVERT | {"岗位摘要": "候选输出中不应额外生成未约定字段"})
    ), ("direction_mismatch", compact(_ADVERT | {"岗位方向": "前端开发"})), ("responsibility_drop", compact(_ADVERT | {"核心职责": ["写代码"]})),
    ("responsibility_skill_leak", compact(_ADVERT | {"必备技能": ["Python", "写代码"]})), ("education_experience_mix", compact(_ADVERT | {"经验要求": "3年；本科"})),
])
def f26_worse_advert_answers(spark):
    return spark.createDataFrame([(dumped(_ADVERT),)], "a string").select(
        F.inline(preferences.worse(F.col("a"), "jd_parse"))
    ).select("strategy", F.col("json").alias("worse"))


_PERSON = {"优势标签": ["t"], "教育背景": ["本科"], "目标岗位": "x", "项目经历": ["p", "q"]}


@fixture("strategy varchar, worse varchar", [
    (
        "unexpected_field", compact(_PERSON | {"岗位摘要": "候选输出中不应额外生成未约定字段"})
    ), ("resume_strength_drop", compact(_PERSON | {"优势标签": []})), ("resume_project_drop", compact(_PERSON | {"项目经历": ["p"]})),
    ("resume_education_skill_leak", compact(_PERSON | {"核心技能": ["本科"]})),
])
def f27_worse_resume_answers(spark):
    return spark.createDataFrame([(dumped(_PERSON),)], "a string").select(
        F.inline(preferences.worse(F.col("a"), "resume_parse"))
    ).select("strategy", F.col("json").alias("worse"))


_MATCH = {"主要短板": ["b"], "匹配优势": ["a"], "匹配结论": "c", "简历优化建议": []}


@fixture("strategy varchar, worse varchar", [
    ("unexpected_field", compact(_MATCH | {"岗位摘要": "候选输出中不应额外生成未约定字段"})), ("match_gap_drop", compact(_MATCH | {"主要短板": []})), (
        "match_strength_gap_swap", compact(_MATCH | {"主要短板": ["a"], "匹配优势": ["b"]})
    ), ("match_suggestion_drop", None),
])
def f28_worse_match_answers(spark):
    return spark.createDataFrame([(dumped(_MATCH),)], "a string").select(F.inline(preferences.worse(F.col("a"), "match"))).select("strategy", F.col("json").alias("worse"))


def _picked(ident: str) -> str:
    import hashlib

    names = list(preferences.WORSE["jd_parse"])
    return names[int(hashlib.sha1(ident.encode()).hexdigest()[:8], 16) % len(names)]  # noqa: S324


@fixture("source_id varchar, strategy varchar, n_prompt bigint", [(f"r{i}", _picked(f"r{i}"), 2) for i in range(8)])
def f29_bootstrap_preferences(spark):
    rows = spark.createDataFrame([(f"r{i}", "jd_parse", dumped(_ADVERT)) for i in range(8)], "id string, task_type string, a string")
    got = preferences.bootstrap_preferences(rows.select("id", "task_type", adverts.messages(F.lit("问"), F.col("a")).alias("messages")))
    return got.select("source_id", F.col("meta.rejection_strategy").alias("strategy"), F.size("prompt").cast("long").alias("n_prompt"))


_LABELS = [
    (
        "synthetic_match_1_2_3",
        {"匹配等级": "较匹配", "岗位方向匹配": True, "学历匹配": False, "经验匹配": True, "命中技能": list("abcdefg"), "缺失技能": [], "命中项目": ["p", "q", "r"]},
        {"jd_direction": "后端"}
    ),
    ("x_ocr", {"匹配等级": "低匹配"}, {}),
]


@fixture("id varchar, source_group varchar, good varchar, bad varchar, advice varchar, roles varchar", [
    (
        "synthetic_match_1_2_3", "synthetic_match_1_2", "求职方向与岗位方向一致|经验背景满足岗位要求|已覆盖关键技能：a、b、c、d、e、f|项目经历提供直接岗位证据：p；q", "学历条件与 JD 要求存在差距",
        "保持当前简历结构，继续强化核心项目成果与量化结果", "后端"
    ),
    ("x_ocr", "x", "已有简历信息可作为初步评估基础", "目标岗位方向与 JD 方向不一致|学历条件与 JD 要求存在差距|经验条件与 JD 要求存在差距", "增加与岗位相关的项目、实习或工作经历描述|明确简历目标岗位，并突出与目标方向一致的项目与技能", "请补充明确的目标岗位"),
])
def f30_explanations_and_match_samples(spark):
    kind = f"id string, label struct<{preferences.LABEL.replace('` ', '`:')}>, meta string, jd_text string, resume_text string"
    rows = preferences.match_samples(spark.createDataFrame([(i, x, dumped(m), "J", "R") for i, x, m in _LABELS], kind), normalized_hash)
    a = F.from_json(F.element_at("messages", 3)["content"], "`匹配优势` array<string>, `主要短板` array<string>, `简历优化建议` array<string>, `推荐投递岗位方向` array<string>")
    return rows.withColumn("a", a).select(
        "id", "source_group",
        *(joined(F.col("a")[k]).alias(n) for k, n in (("匹配优势", "good"), ("主要短板", "bad"), ("简历优化建议", "advice"), ("推荐投递岗位方向", "roles")))
    )


_LABEL = ("后端", ["本科"], ["Python", "MySQL"], [], ["项目甲。", "项目乙"], ["踏实"])


@fixture("variant varchar, rendered varchar", [
    ("original", "正文"), ("profile_card", "候选人简历\n目标岗位：后端\n教育背景：本科\n核心技能：Python、MySQL\n项目经历：\n1. 项目甲。\n1. 项目乙\n优势标签：踏实"),
    (
        "bullets", "求职方向：后端\n教育：\n- 本科\n技能栈：\n- Python\n- MySQL\n实习：\n项目：\n- 项目甲。\n- 项目乙\n优势：\n- 踏实"
    ), ("compact", "目标岗位 后端\n教育 本科\n技能 Python、MySQL\n项目 项目甲。；项目乙\n优势 踏实"),
    ("ocr_like", "候选人目标:后端\n教育经历:本科\n核心技能:Python / My SOL\n项目经历:\n- 项目甲\n- 项目乙\n个人优势:踏实"),
    ("mixed_cn_en", "Target Role: 后端\nEducation: 本科\nSkills: Python, MySQL\nProjects:\n* 项目甲。\n* 项目乙\nInternships:\n\nStrengths: 踏实"),
])
def f31_renderings_of_resumes(spark):
    return resumes.renderings(spark.createDataFrame([("r", " 正文 ", _LABEL)], f"id string, text string, label {resumes.LABEL}")).select("variant", "rendered")


@fixture("clean varchar, rendered varchar", [("张三\n\n教育背景：\n某 大学 本科\n项目经历\n做事", "张三\n\n教育背景：\n某 大学 本科\n\n项目经历：\n做事")])
def f32_normalized_resumes(spark):
    df = spark.createDataFrame([("张三\r\n\r\n\r\n\r\n教育背景：\r\n 某　大学\t 本科\n项目经历\n做事",)], "text string")
    return resumes.normalized_rows(df).select(F.col("clean_text").alias("clean"), F.col("normalized_text").alias("rendered"))


@fixture("id varchar, text varchar, skills varchar", [("resume_bootstrap_1_a", "目标岗位：后端开发", "Python|MySQL")])
def f33_resumes_from_adverts(spark):
    df = spark.createDataFrame(
        [("a", 1, "后端开发工程师", "", "熟悉 python 与 mysql，硕士及以上学历"), ("b", 2, "文员", "", "python mysql"), ("c", 3, "后端开发工程师", "", "python")],
        "id string, index int, job_title string, company string, raw_text string"
    )
    rows = resumes.from_adverts(df, VOCABULARY)
    return rows.select("id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"), joined(F.col("label")["核心技能"]).alias("skills"))


_SAID = {
    "岗位方向": "大模型应用", "核心职责": ["写代码", "任职要求：本科及以上学历，3年以上开发经验", "加分项：熟悉 Java", "经验要求：5年以上经验"], "必备技能": "python\nmysql", "任职要求": [],
    "岗位要求": ["熟悉 Python"], "加分项": ["x", "X"]
}


@fixture(
    "direction varchar, duties varchar, demands varchar, skills varchar, bonus varchar, years varchar, degree varchar",
    [("算法工程", "写代码", "熟悉 Python|本科及以上学历，3年以上开发经验", "Python", "x|熟悉 Java", "5年以上经验", "本科及以上")]
)
def f34_normalized_advert_answers(spark):
    df = spark.createDataFrame([(dumped(_SAID),)], "a string").select(answers.advert(F.col("a"), F.lit(""), VOCABULARY).alias("x"))
    x = lambda k: F.col("x")[k]
    return df.select(
        x("岗位方向").alias("direction"),
        *(joined(x(k)).alias(n) for k, n in (("核心职责", "duties"), ("任职要求", "demands"), ("必备技能", "skills"), ("加分项", "bonus"))),
        x("经验要求").alias("years"), x("学历要求").alias("degree")
    )


_HEARD = {
    "目标岗位": "后端 开发工程师", "教育背景": {"学校": "某大学", "学历": "本科"}, "核心技能": ["python", "Go", "PYTHON"], "实习经历": None, "项目经历": ["做了甲；做了乙。", ["丙"]],
    "优势标签": ["具备沟通能力、执行能力强和学习能力"]
}


@fixture("target varchar, education varchar, skills varchar, projects varchar, tags varchar", [("后端开发", "某大学，本科", "Python|Go", "做了甲。|做了乙。|丙。", "沟通力|执行|学习")])
def f35_normalized_resume_answers(spark):
    df = spark.createDataFrame([(dumped(_HEARD),)], "a string").select(answers.resume(F.col("a"), F.lit(""), VOCABULARY, {"沟通力": ["沟通"]}).alias("x"))
    x = lambda k: joined(F.col("x")[k])
    return df.select(
        F.col("x")["目标岗位"].alias("target"), x("教育背景").alias("education"), x("核心技能").alias("skills"), x("项目经历").alias("projects"),
        x("优势标签").alias("tags")
    )


@fixture("conclusion varchar, good varchar, bad varchar", [("好 的", "a", "b")])
def f36_normalized_match_answers(spark):
    df = spark.createDataFrame(
        [(dumped({"匹配结论": " 好  的 ", "匹配优势": "a", "主要短板": ["b", "B"], "其他": 1}),)], "a string"
    ).select(answers.match(F.col("a")).alias("x"))
    return df.select(F.col("x")["匹配结论"].alias("conclusion"), joined(F.col("x")["匹配优势"]).alias("good"), joined(F.col("x")["主要短板"]).alias("bad"))


MARKED = [
    ("会用 Python 编程", "会用 @@Python##K @@编程##S", "3:9:K:Python|10:12:S:编程"), ("a", "@@a##L", "0:1:L:a"), ("a", "a@@b", None), ("ab", "@@a##Lc", None),
    ("a", "@@##Ka", None), ("x", "x", ""), ("", "x", None)
]


@fixture("i bigint, spans varchar", [(i, s) for i, (*_, s) in enumerate(MARKED)])
def f37_marked_spans(spark):
    return cases(spark, MARKED).select(
        "i",
        joined(
            F.transform(
                spans.marked_spans(F.col("c0"), F.col("c1")),
                lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"], s["text"])
            )
        ).alias("spans")
    )


@fixture(
    "split varchar, pos bigint, outcome varchar",
    [("test", 0, "kept"), ("test", 1, "within_split_text"), ("train", 0, "cross_split_source_group"), ("train", 1, "cross_split_text"), ("train", 2, "kept")]
)
def f38_isolated_splits(spark):
    rows = [("test", 0, "g1", "用 A"), ("test", 1, "g2", "用  a"), ("train", 0, "g1", "别的"), ("train", 1, "g3", "用 a"), ("train", 2, "g3", "好 B")]
    return spans.isolate(spark.createDataFrame(rows, "split string, pos long, source_group string, text string")).select("split", "pos", "outcome")


SETS = [
    (["A ", "b"], ["a", "c"], 0.5, 0.5, 0.5), ([], [], 1.0, 1.0, 1.0), ([], ["a"], 0.0, 0.0, 0.0), (["a"], [], 0.0, 0.0, 0.0),
    (["a", "b", "c", "d"], ["a"], 0.25, 1.0, 0.4)
]


@fixture("i bigint, p double, r double, f double", [(i, *s[2:]) for i, s in enumerate(SETS)])
def f39_set_scores(spark):
    df = cases(spark, [s[:2] for s in SETS], "a array<string>, b array<string>").withColumn("s", evaluation.set_scores(F.col("a"), F.col("b")))
    return df.select("i", F.col("s.precision").alias("p"), F.col("s.recall").alias("r"), F.col("s.f1").alias("f"))


PREDICTED = [
    ("a", True, {"岗位方向": "后端 开发", "核心职责": ["x"], "必备技能": ["Go"]}, {"岗位方向": "后端  开发", "核心职责": ["x", "y"], "必备技能": ["go"]}),
    ("b", True, {"岗位方向": "前端"}, {"岗位方向": "后端"}), ("c", False, None, {"岗位方向": "后端"})
]


@fixture(
    "field varchar, recall double, exact_match double",
    [("核心职责", 0.75, None), ("必备技能", 1.0, None), ("加分项", 1.0, None), ("岗位方向", None, 0.5), ("经验要求", None, 1.0), ("学历要求", None, 1.0)]
)
def f40_evaluated_predictions(spark):
    df = spark.createDataFrame(
        [(i, "jd_parse", ok, p and dumped(p), dumped(g)) for i, ok, p, g in PREDICTED],
        "id string, task string, ok boolean, parsed string, label string"
    )
    return evaluation.metrics(evaluation.scored(df, evaluation.SPECS["jd_parse"])).select("field", "recall", "exact_match")


_GOLD = {"匹配等级": "高匹配", "岗位方向匹配": True, "学历匹配": True, "经验匹配": False, "命中技能": ["Go"], "缺失技能": []}


@fixture("layer varchar, field varchar, exact_match double", [(x, f, v) for x, v in (("product_final", 0.0), ("raw_model_derived", 1.0)) for f in ("匹配等级",)])
def f41_layers_of_matches(spark):
    found = _GOLD | {"匹配等级": "低匹配"}
    kind = "struct<rule_result:string,structured_result_available:boolean>"
    df = spark.createDataFrame(
        [("a", dumped(_GOLD), True, True, dumped(found), (dumped(_GOLD), True), ("{}", False))],
        f"id string, label string, jd_ok boolean, resume_ok boolean, rule_result string, raw_model {kind}, normalized {kind}"
    )
    return evaluation.metrics(evaluation.layers(df), "layer").filter("field = '匹配等级'").select("layer", "field", "exact_match")


@fixture(
    "name varchar, actual double, passed boolean",
    [("jd_direction_exact_match", 0.96, True), ("jd_json_valid_rate", 0.5, False), ("match_hit_skill_f1", 0.85, True)]
)
def f42_readiness(spark):
    long = spark.createDataFrame(
        [("jd", "岗位方向", "exact_match", 0.96), ("jd", "", "valid_rate", 0.5), ("match", "命中技能", "f1", 0.85)],
        "report string, field string, key string, value double"
    )
    return evaluation.readiness(spark, long).filter("actual > 0").select("name", "actual", "passed")


@fixture("id varchar, priority bigint, reasons varchar", [("a", 14, "经验标签与原文明示年限矛盾|标签判缺失但评分器找到双侧技能证据|标签未覆盖评分器找到的技能证据|评分器漏掉标签声明命中的技能"), ("b", 2, "缺少对应预测结果")])
def f43_review_queue(spark):
    gold = spark.createDataFrame(
        [("a", "要求 3 年经验，本科", "5 年经验，硕士", dumped({"经验匹配": False, "学历匹配": True, "命中技能": ["Go"], "缺失技能": ["Java"], "匹配等级": "高匹配"})), ("b", "无", "无", "{}")],
        "id string, jd_text string, resume_text string, label string"
    )
    found = spark.createDataFrame(
        [("a", dumped({"命中技能": ["Java", "C"], "缺失技能": ["Go"], "匹配等级": "高匹配"}), 2), ("a", "{}", 1)], "id string, rule_result string, pos int"
    )
    return evaluation.review_queue(gold, found).select(
        "id", F.col("priority_score").cast("long").alias("priority"), joined(F.col("review_reasons")).alias("reasons")
    )


BAD_LABELS = [
    (dumped(_GOLD), ""),
    (dumped(_GOLD | {"匹配等级": "x", "学历匹配": "是", "缺失技能": ["Go"]}), "invalid_match_level|invalid_bool:学历匹配|skill_in_both_matched_and_missing"),
    ("[]", "label_not_object"), (None, "label_not_object")
]


@fixture("i bigint, errors varchar", [(i, e) for i, (_, e) in enumerate(BAD_LABELS)])
def f44_label_errors(spark):
    return cases(spark, BAD_LABELS).select("i", joined(evaluation.label_errors(F.col("c0"))).alias("errors"))


PAIRS = [
    (
        ("AI应用开发", ["Python", "FastAPI", "RAG"], "本科及以上", "3年以上开发经验", None, None, None),
        (
            "AI应用开发工程师", ["本科，计算机科学与技术"], ["Python", "FastAPI", "RAG", "MySQL"], ["负责企业知识库问答系统开发，完成 RAG 链路、FastAPI 接口和 Python 服务开发"],
            ["3年后端与 AI 应用开发经验"], "本科，3年后端与 AI 应用开发经验"
        ),
        95, "高匹配", "exact", "Python|FastAPI|RAG", ""
    ),
    (
        ("后端开发", ["Java", "MySQL", "Redis"], "本科及以上", "5年以上开发经验", None, None, None),
        ("测试开发工程师", ["大专，软件技术"], ["Python"], ["负责自动化测试脚本开发"], ["2年测试经验"], "大专，2年测试经验，掌握 Python"), 0, "低匹配", "mismatch", "", "Java|MySQL|Redis"
    ),
    (
        ("后端开发", ["Java"], "硕士优先", "", ["熟悉 Redis"], ["用 Java 写服务"], "任职要求：熟悉 Redis\n岗位职责：用 Java 写服务"), ("后端开发", None, ["Redis"], None, None, None),
        90, "高匹配", "exact", "Redis", ""
    ),
]


@fixture("i bigint, score bigint, level varchar, relation varchar, matched varchar, missing varchar", [(i, *p[2:]) for i, p in enumerate(PAIRS)])
def f45_scored_pairs(spark):
    left = "struct<direction:string, skills:array<string>, education:string, experience:string, requirements:array<string>, responsibilities:array<string>, text:string>"
    right = "struct<target:string, education:array<string>, skills:array<string>, projects:array<string>, internships:array<string>, text:string>"
    m = F.col("match")
    return pairing.score_pairs(cases(spark, [p[:2] for p in PAIRS], f"advert {left}, resume {right}"), VOCABULARY).select(
        "i", m["score"].cast("long").alias("score"), m["level"].alias("level"), m["relation"].alias("relation"),
        joined(m["matched"]).alias("matched"), joined(m["missing"]).alias("missing")
    )


SECTIONS = [("岗位职责：写代码 任职要求：会写\n加分项\n开源", "写代码", "会写", "开源"), ("【任职要求】本科，有经验者优先\n岗位职责\n测试", "测试", "本科，有经验者优先", ""), (None, "", "", "")]


@fixture("i bigint, duties varchar, demands varchar, bonus varchar", [(i, *s[1:]) for i, s in enumerate(SECTIONS)])
def f46_sections_of_adverts(spark):
    s = sections.inline_sections(F.col("c0"))
    return cases(spark, SECTIONS).select("i", s["responsibilities"].alias("duties"), s["requirements"].alias("demands"), s["bonus"].alias("bonus"))


_ORIGINS = [("synthetic_match_hf_job_educational_1", "synthetic_text", "{}"), ("b", "real", '{"annotation_status": "human_verified"}'), ("c", "x", "{}")]


@fixture("total bigint, synthetic bigint, reviewed bigint, unknown bigint, origin varchar, rate double", [(3, 1, 1, 1, "mixed", 0.3333)])
def f47_origins_of_pairs(spark):
    r = audits.pair_origins(spark.createDataFrame(_ORIGINS, "id string, source_type string, meta string"))
    return r.select(
        F.col("total_rows").alias("total"), F.col("synthetic_rows").alias("synthetic"), F.col("human_reviewed_pairs").alias("reviewed"),
        F.col("unknown_pairs").alias("unknown"), F.col("training_origin").alias("origin"), F.col("synthetic_rate").alias("rate")
    )


_FULL_ANSWER = {"岗位方向": "前端开发", "核心职责": ["a"], "必备技能": ["x"], "学历要求": "本科", "经验要求": ""}
_SAMPLES = [
    ("1", "train", "后端开发", dumped(_FULL_ANSWER), "g"), ("2", "valid", "后端开发", dumped(_FULL_ANSWER), "g"), ("2", "valid", "讲师", "{", "h"),
    ("3", "test", "前端开发", dumped(_FULL_ANSWER), "h")
]


def chat_samples(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(_SAMPLES, "id string, split string, t string, a string, g string")
    ask = F.concat(F.lit("岗位名称："), "t", F.lit("\n3年以上开发经验"))
    return df.select(
        "id", "split", F.lit("jd_parse").alias("task_type"), F.col("g").alias("source_group"), F.array("g").alias("linked_source_groups"),
        F.lit(None).cast("string").alias("source_id"), F.lit("{}").alias("meta"), adverts.messages(ask, F.col("a")).alias("messages")
    )


@fixture("total bigint, invalid bigint, contents bigint, inputs bigint, linked bigint, no_years double, ready boolean", [(4, 1, 1, 1, 1, 0.75, False)])
def f48_audited_samples(spark):
    r = audits.sample_audit(chat_samples(spark), "jd")
    names = {
        "total": "total", "invalid_json": "invalid", "cross_split_duplicates": "contents", "cross_split_inputs": "inputs",
        "cross_split_linked_groups": "linked", "empty_经验要求": "no_years", "format_ready": "ready"
    }
    return r.select(*(F.col(f"`{k}`").alias(v) for k, v in names.items()))


@fixture(
    "split varchar, task varchar, n bigint, n_groups bigint, ratio double",
    [("train", "jd_parse", 1, 1, 1.0), ("valid", "jd_parse", 2, 2, 1.0), ("test", "jd_parse", 1, 1, 1.0)]
)
def f49_task_mix(spark):
    return audits.task_mix(chat_samples(spark)).select(
        "split", "task", F.col("rows").alias("n"), F.col("unique_source_groups").alias("n_groups"), F.col("source_group_ratio").alias("ratio")
    )


@fixture("expected varchar, actual varchar, n bigint", [("后端开发", "前端开发", 2)])
def f50_direction_conflicts(spark):
    return audits.conflict_groups(audits.direction_conflicts(chat_samples(spark))).select("expected", "actual", F.col("count").alias("n"))


@fixture("empty_rows bigint, recoverable_rows bigint, recoverable_rate double", [(3, 3, 1.0)])
def f51_experience_gaps(spark):
    return audits.gap_report(audits.experience_gaps(chat_samples(spark)))


@fixture("name varchar, decision varchar, groups bigint", [("good", "training_allowed", 25), ("flat", "rejected", 1), ("none", "rejected", 0)])
def f52_source_admission(spark):
    kind = "struct<`目标岗位`:string,`教育背景`:array<string>,`核心技能`:array<string>,`实习经历`:array<string>,`项目经历`:array<string>>"
    label = ("x", ["y"], ["z"], [], ["p"])
    rows = spark.createDataFrame(
        [
            ("resume_parse", f"正文 {i}", label, None, dumped({"source_name": "good"})) for i in range(25)
        ] + [("resume_parse", "同文", label, None, dumped({"source_name": "flat"}))] * 5,
        f"task string, text string, label {kind}, ner_tags array<string>, meta string"
    )
    manifest = spark.createDataFrame(
        [(n, "resume_parse_rows", "confirmed", "training", "documented", "collected", "training_allowed", None, None) for n in ("good", "flat", "none")],
        "name string, schema string, license_status string, intended_usage string, provenance_status string, collection_method string, admission_decision string, min_unique_content_groups int, max_duplicate_template_ratio double"
    )
    return audits.source_admission(rows, manifest).select("name", F.col("final_decision").alias("decision"), F.col("unique_content_groups").alias("groups"))


PRIVATE = [("电话 13812345678", "phone", "[手机号]"), ("邮箱 x@y.com", "email", "[邮箱]"), ("普通文本", "", None)]


@fixture("i bigint, kinds varchar, masked boolean", [(i, k, m is not None) for i, (_, k, m) in enumerate(PRIVATE)])
def f53_private_values(spark):
    mask = F.create_map(*(x for i, (*_, m) in enumerate(PRIVATE) for x in (F.lit(i).cast("long"), F.lit(m or "\x00"))))
    return cases(spark, [p[:1] for p in PRIVATE]).select(
        "i", joined(F.array_distinct(F.transform(privacy.findings(F.col("c0")), lambda f: f["kind"]))).alias("kinds"),
        F.contains(privacy.redacted(F.col("c0")), F.element_at(mask, F.col("i"))).alias("masked")
    )
