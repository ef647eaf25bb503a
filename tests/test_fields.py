"""Fields of adverts, tiers, risks and samples on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from curatrix.operators import adverts, fields, tiers

VOCABULARY = {"Python": ["python"], "Java": ["java"], "MySQL": ["mysql"], "PyTorch": ["pytorch"], "Redis": []}


def values(spark, f, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r.x for r in df.select("i", f(*(F.col(f"c{k}") for k in range(len(rows[0])))).alias("x")).orderBy("i").collect()]


def test_experience(spark):
    cases = {
        "任职要求：具备 3 年以上 Android 开发经验": "具备 3 年以上 Android 开发经验", "至少两年 iOS 开发经验": "至少两年 iOS 开发经验", "工作年限3～5年": "3～5年",
        "任职资格：1-2024年10月1日至2025年9月30日期间毕业，本科及以上学历": "", "经验要求：3年以上，其他": "3年以上", "经验不限": "经验不限", "": "", "1-3年经验优先": "1-3年经验",
    }
    assert values(spark, fields.experience, *((k,) for k in cases)) == list(cases.values())
    metas = {
        '{"experience": "不限"}': "经验不限", '{"experience": "", "work_year": "3-5年"}': "3-5年", '{"experience": "abc", "workYear": "5年及以上"}': "5年及以上",
        "{}": "", "x": ""
    }
    assert values(spark, fields.experience_of_meta, *((k,) for k in metas)) == list(metas.values())


def test_degree(spark):
    cases = {
        "相关专业研究生及以上学历": "研究生及以上学历", "相关领域的学士及以上学位": "学士及以上学位", "专科及以上学历，五年以上经验": "专科及以上学历", "招聘要求：博士研究生学历": "博士研究生学历",
        "招聘要求：硕士研究生学历": "硕士研究生学历", "研究生及以上学历优先": "研究生及以上学历优先", "硕士优先": "硕士优先", "学士及学士以上的学历": "学士及学士以上的学历", "本科及以上学历，计算机专业，硕士优先": "本科及以上",
        "全日制本科及以上": "全日制本科及以上", "无": "",
    }
    assert values(spark, fields.degree, *((k,) for k in cases)) == list(cases.values())


DIRECTIONS = [
    ("百度集团公关（支持智能驾驶事业群）", "岗位职责：负责品牌传播、公关合作和对外沟通。", ""),
    ("国际费用结算", "岗位职责：负责费用结算、单据处理和流程跟进。", ""),
    ("微生物研究员", "负责菌株培养、微生物检测和实验结果记录。", ""),
    ("理化助理研究员", "负责实验室样品检测、仪器系统记录和设备日常运维。", ""),
    ("机器视觉研究员", "负责计算机视觉算法、深度学习模型训练和推理优化。", "算法工程"),
    ("鸿蒙安全研究员", "负责操作系统漏洞挖掘、安全攻防和检测工具开发。", "安全工程"),
    ("食品安全方向研究员", "负责食品安全风险评估和微生物实验研究。", ""),
    ("实时全模态交互世界模型研究员", "负责多模态基础模型训练、推理和生成算法研发。", "算法工程"),
    ("高级研究员", "研究游戏大模型架构，负责模型训练、多模态和扩散模型方案。", "算法工程"),
    ("生物信息多组学研究员", "负责多组学实验分析，协助AI工程师构建深度学习模型。", ""),
    ("AI行业研究员", "跟踪生成式AI和大模型市场趋势，撰写投资研究和赛道分析报告。", ""),
    ("行业AI技术研究员", "负责机器学习、深度学习算法研发，使用PyTorch训练模型。", "算法工程"),
    ("硬件研发工程师", "负责电源板原理图设计、硬件调试和EMC测试。", "硬件研发"),
    ("AIGC产品实习生", "负责用户需求分析、产品方案和版本迭代，协同算法团队。", "产品经理"),
    ("OLAP引擎研发", "岗位职责：负责 OLAP 引擎研发、数据库优化和分布式查询性能调优。", "后端开发"),
    ("Text To Speech (TTS) Algorithm Engineer", "岗位职责：负责 TTS 模型训练、推理优化和语音生成效果提升。", "算法工程"),
    ("安全运营工程师", "岗位职责：负责安全告警分析、漏洞处置和安全运营平台建设。", "安全工程"),
    ("微信安全-多模态大模型高级算法工程师", "岗位职责：负责多模态模型训练和内容理解算法研发。", "算法工程"),
    ("网络与信息安全研究岗", "岗位职责：负责漏洞研究、安全攻防和风险分析。", "安全工程"),
    ("大模型安全运营", "岗位职责：负责大模型安全治理、风险监控与安全运营平台建设。", "安全工程"),
    ("B端招商入驻研发岗", "岗位职责：负责平台招商系统研发、服务端能力建设和数据库设计。", "后端开发"),
    ("功率硬件工程师", "岗位职责：负责功率硬件设计、板级调试和硬件验证。", "硬件研发"),
    ("网络规划专家", "岗位职责：负责网络规划、基础架构设计与网络容量建设。", "网络与基础设施"),
    ("AI Infra研发工程师", "岗位职责：负责机器学习平台、训练平台和推理平台建设。", "AI Infra"),
    ("高性能计算研发工程师", "岗位职责：负责高性能计算集群、分布式计算和 GPU 集群优化。", "高性能计算"),
    ("智驾系统架构工程师", "岗位职责：负责智驾系统架构设计、软件模块集成和功能开发。", "汽车软件/智驾研发"),
    ("秒送物流SRE", "岗位职责：负责系统稳定性、发布巡检、监控告警和自动化运维平台建设。", "运维开发"),
    ("开发质量工程师（软件）", "岗位职责：负责软件质量保障、测试流程建设和自动化验证。", "测试开发"),
    ("资深架构师岗（电商业务）", "岗位职责：负责电商服务端架构设计、数据库治理和系统演进。", "后端开发"),
    ("服务器开发工程师（UGC业务）", "岗位职责：负责游戏服务器端架构设计、开发和性能优化。", "后端开发"),
    ("交换机软件研发工程师", "岗位职责：负责交换机软件设计、开发、测试和维护工作。", "网络与基础设施"),
    ("运营开发工程师-EdgeOne", "岗位职责：负责边缘云健康探测系统架构设计、核心功能开发与性能优化。", "运维开发"),
    ("AI编译优化工程师(北京/上海/深圳)", "岗位职责：负责高性能图和算子编译器研发与生成算子优化。", "高性能计算"),
    ("游戏玩法开发专家", "岗位职责：负责角色控制、相机控制、NPC控制等模块的开发与相关技术预研。", "后端开发"),
    ("游戏AI开发工程师", "岗位职责：负责NPC、Bot与拟人AI的行为开发、感知、寻路与动作系统优化。", "算法工程"),
    ("大模型应用算法工程师", "负责智能客服与工作流落地", "AI应用开发"),
    ("大模型应用算法工程师", "负责后训练与强化学习", "算法工程"),
    ("工作人员", "使用 spark、flink 和数仓", "数据开发"),
    (None, None, ""),
]


def test_direction(spark):
    assert values(spark, fields.direction, *((t, x) for t, x, _ in DIRECTIONS)) == [d for *_, d in DIRECTIONS]
    got = values(spark, fields.canonical_direction, ("后端", "岗位名称：前端开发工程师\n写页面"), ("", "使用 spark 和 flink"), ("AI应用开发", "负责模型训练"))
    assert got == ["前端开发", "数据开发", "算法工程"]


def test_english_adverts(spark):
    got = values(spark, fields.english_direction, ("Frontend Developer", "React work"), ("Data Engineer", "etl with android"), ("Clerk", "files"))
    assert got == ["前端开发", "", ""]
    assert values(spark, fields.english_degree, ("A PhD or master's degree",), ("a doctorate, else a Bachelor's degree",), ("none",)) == ["博士", "本科", ""]
    assert values(
        spark, fields.english_experience, ("5+ years  of experience; x",), ("minimum 3 years working. y",), ("0",)
    ) == ["5+ years of experience", "minimum 3 years working", ""]


def test_lists(spark):
    assert values(spark, fields.bullets, ("- a\n\n•  b \n* c",)) == [["a", "b", "c"]]
    assert values(spark, fields.duties, ("- 写代码\n任职要求：x\n • 测试 -",)) == [["写代码", "测试"]]
    assert values(spark, lambda c: fields.unique_texts(F.split(c, ",")), ("Go, go,  a  b ,A B,",)) == [["Go", "a b"]]


BODY = "岗位职责：\n负责后端服务开发与性能优化，保障系统稳定运行\n参与数据库设计和代码评审，推动工程质量提升\n任职要求：\n本科及以上学历，3年以上后端开发经验\n熟悉 Python、MySQL，具备良好的沟通能力" + "，持续学习新技术" * 12
RAW = "id string, source string, job_title string, company string, location string, salary string, raw_text string, meta string"


@pytest.fixture(scope="module")
def clean(spark):
    rows = [
        ("a", "zhaopin.jd.com", "后端开发工程师", "京东", "北京", "", BODY, '{"language": "zh"}'),
        ("b", "zhaopin.jd.com", "后端开发工程师（市场）", "京东", "", "", BODY, '{"language": "zh"}'),
        ("c", "x.com", "后端开发工程师", "", "", "", BODY, '{"language": "zh"}'),
        ("d", "zhaopin.jd.com", "后端开发工程师", "", "", "", "短文本", '{"language": "zh"}'),
        ("e", "zhaopin.jd.com", "后端开发工程师", "", "", "", BODY, '{"language": "en"}'),
        (
            "f", "hf_job_educational_train_2026_05_17", "python开发工程师", "", "", "", BODY,
            '{"language": "zh", "training_eligible": true, "intended_usage": "weak_supervision_only"}'
        ),
        ("g", "zhaopin.jd.com", "后端开发工程师", None, None, None, None, "no json"),
        ("h", "zhaopin.jd.com", "后端开发工程师", "", "", "", BODY, '{"language": "zh", "sft_ready": false}'),
    ]
    return adverts.normalized(spark.createDataFrame(rows, RAW), VOCABULARY).cache()


def test_normalized_adverts(clean):
    a = clean.filter("id = 'a'").first()
    assert a.labels.asDict() == {"direction": "后端开发", "skills": ["Python", "MySQL"], "experience": "3年以上后端开发经验", "education": "本科及以上"}
    assert a.sections.responsibilities.startswith("负责后端") and a.sections.requirements.startswith("本科") and a.language == "zh" and a.sft_ready
    g = clean.filter("id = 'g'").first()
    assert g.clean_text == "" and g.meta == "{}" and g.labels.direction == "后端开发" and g.sft_ready


def test_tiers(clean):
    got = {
        r.id: (r.s, r.w, r.why) for r in clean.select("id", tiers.is_strict().alias("s"), tiers.is_weak().alias("w"), tiers.rejection().alias("why")).collect()
    }
    assert got == {
        "a": (True, False, "accepted"), "b": (False, False, "excluded_title"), "c": (False, False, "source_not_high_trust"), "d": (False, False, "missing_sections"),
        "e": (False, False, "language_not_zh"), "f": (False, True, "source_not_high_trust"), "g": (False, False, "language_not_zh"), "h": (False, False, "sft_not_ready"),
    }
    more = {
        r.id: (r.p, r.b, r.q, r.u, r.t) for r in clean.select(
            "id", tiers.is_strict_plus().alias("p"), tiers.is_bootstrap().alias("b"), tiers.is_quality_weak().alias("q"),
            tiers.is_weak_structured().alias("u"), tiers.training_allowed().alias("t")
        ).collect()
    }
    assert more["a"] == (True, True, True, False, True) and more["d"] == (False, False, False, False, True) and more["f"] == (True, True, True, True, True)
    samples = tiers.rejection_samples(clean.select("id", "source", "job_title", tiers.rejection().alias("reason")), 1).collect()
    assert len(samples) == len({r.reason for r in samples}) == 5
    top = tiers.rejection_summary(clean.select("source", tiers.rejection().alias("reason")), "source").collect()
    assert {(r.source, r.total) for r in top} == {("zhaopin.jd.com", 5), ("x.com", 1), ("hf_job_educational_train_2026_05_17", 1)}


def test_repairs(spark, clean):
    assert values(
        spark, lambda t: tiers.direction_of_title(t, F.lit("x")), ("训练平台研发",), ("数据安全岗",), ("web前端",), ("文员",), ("C# 岗",)
    ) == ["AI Infra", "安全工程", "前端开发", "x", "后端开发"]
    both = F.struct(F.lit("写代码；任职要求：本科").alias("responsibilities"), F.lit("会写").alias("requirements"), F.lit("").alias("bonus"))
    assert values(spark, lambda _: tiers.separated(both), ("",))[0].asDict() == {"responsibilities": "写代码", "requirements": "会写\n任职要求：本科", "bonus": ""}
    short = clean.filter("id = 'd'").withColumn("clean_text", F.lit("岗位职责：负责后端开发，本科及以上学历，熟悉 Python" + "，保障系统稳定" * 16)).withColumn(
        "sections", F.struct(F.lit("负责").alias("responsibilities"), F.lit("").alias("requirements"), F.lit("").alias("bonus"))
    )
    row = adverts.repairable_pool(
        short.withColumn(
            "labels",
            F.struct(F.lit("").alias("direction"), F.array(F.lit("Python")).alias("skills"), F.lit("").alias("experience"), F.lit("本科").alias("education"))
        )
    ).first()
    assert json.loads(row.meta)["repair_reason"] == "missing_direction" and json.loads(row.meta)["repaired_direction"] == "后端开发"


def test_risks(spark):
    good = json.dumps({"核心职责": ["a", "b"], "必备技能": ["x"], "学历要求": "本科", "经验要求": "3年"}, ensure_ascii=False)
    cases = [
        ("{", "", "", "", ["invalid_assistant_json"], 5), (good, "岗位名称：工程师", "strict", "x", [], 0),
        (
            json.dumps({"核心职责": ["任职要求" + "x" * 500]}, ensure_ascii=False), "岗位名称：讲师\n", "quality_weak", "hf_x",
            [
                "quality_weak_tier", "weak_public_source", "suspicious_title_keyword", "empty_skills", "empty_education", "empty_experience",
                "responsibility_contains_requirement_marker", "oversized_single_responsibility", "quality_weak_missing_core_field"
            ],
            16
        ),
    ]
    got = values(
        spark, lambda a, p, t, s: F.struct(tiers.risk_reasons(a, p, t, s).alias("r"), tiers.risk_score(tiers.risk_reasons(a, p, t, s)).alias("n")),
        *(c[:4] for c in cases)
    )
    assert [(g.r, g.n) for g in got] == [(c[4], c[5]) for c in cases]
    assert values(spark, lambda t: tiers.quality_score(t, F.lit(3)), ("strict",), ("?",), ("bootstrap",)) == [70, 20, 30]
    assert values(
        spark, tiers.sample_source, ("m", "x"), ("", "hf_job_educational_train_9"), (None, "jd_1_jd_parse")
    ) == ["m", "hf_job_educational_train_2026_05_17", "jd"]


def test_samples_and_pools(spark, clean):
    s = adverts.advert_samples(clean.filter("id = 'a'")).first()
    assert [m.role for m in s.messages] == ["system", "user", "assistant"] and s.id == "a_jd_parse" and s.source_group == "a"
    answer = json.loads(s.messages[2].content)
    assert list(answer) == ["岗位方向", "核心职责", "必备技能", "加分项", "经验要求", "学历要求"] and answer["必备技能"] == ["Python", "MySQL"] and len(answer["核心职责"]) == 2
    assert "岗位名称：后端开发工程师\n公司：京东\n工作地点：北京\n" in s.messages[1].content and json.loads(s.meta)["company"] == "京东"
    pool = adverts.manual_pool(clean)
    assert [r.id for r in pool.collect()] == ["a"] and json.loads(pool.first().meta)["pool_origin"] == "strict_manual"
    both = adverts.combined_pool(clean, pool.withColumn("id", F.lit("p")), pool.withColumns({"id": F.lit("q"), "job_title": F.lit("t")})).collect()
    assert {r.id for r in both} == {"a", "q"} and adverts.weak_structured_pool(clean).count() == 1
    weak = adverts.multilingual_samples(clean, VOCABULARY).collect()
    assert {r.id for r in weak} == {f"{i}_jd_parse" for i in "abcf"}


def test_selection_by_tiers(spark):
    rows = [
        ("a", 0, 0, "", False), ("b", 1, 1, "3年", True), ("b", 2, 1, "3年", True), ("c_jd_parse", 1, 0, "", False), ("d", 1, 9, "", False),
        ("e", 2, 0, "", False), ("f", 2, 2, "1年", True), ("", 0, 0, "", False)
    ]
    df = spark.createDataFrame(rows, "id string, stage int, risk int, experience string, weak boolean")
    out = lambda *a, **k: [r.id for r in tiers.select_tiers(df, *a, **k).collect()]
    assert out(10) == ["a", "b", "c_jd_parse", "f", "e"] and out(10, max_weak_rate=0.1) == ["a", "b", "c_jd_parse", "e"] and out(2) == ["a", "c_jd_parse"]
    assert out(10, excluded=spark.createDataFrame([("c",)], "id string")) == ["a", "b", "f", "e"] and out(10, stage_limits={1: 1}) == ["a", "b", "f", "e"]
    with pytest.raises(ValueError, match="between 0 and 1"):
        tiers.select_tiers(df, 1, max_weak_rate=2)


def test_rows_for_training(spark, clean):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(adverts.training_rows(clean)) == ["a"] and ids(adverts.training_rows(clean, weak=True)) == ["a", "f"] and ids(adverts.training_rows(clean, weak=True, total=1)) == ["a"]
    assert ids(adverts.training_rows(clean, strict=False)) == list("abcdefg") and ids(adverts.supplemental_pool(clean)) == ["f"]


def test_combined_pool_plans_do_not_hold_their_parts(spark):
    """Of rows with a costly plan, the pool's plan holds no more than what reads the written parts."""
    from curatrix.plans.fixtures import f13_combined_pools

    plan = f13_combined_pools(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000 and "LogicalRDD" not in plan
