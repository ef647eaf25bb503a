"""Worse answers, explanations, renderings, pools and pairs on literal rows."""

import hashlib
import json

from pyspark.sql import functions as F

from curatrix.functions.values import normalized_hash
from curatrix.operators import preferences, resumes
from curatrix.operators.adverts import messages

VOCABULARY = {"Python": ["python"], "Java": ["java"], "MySQL": ["mysql"]}
ADVERT = {"岗位方向": "后端开发", "核心职责": ["写代码", "测试"], "必备技能": ["Python"], "经验要求": "3年", "学历要求": "本科"}


def dumped(x):
    return json.dumps(x, ensure_ascii=False)


def test_ways_to_make_answers_worse(spark):
    def ways(task, answer):
        row = spark.createDataFrame([(dumped(answer),)], "a string").select(preferences.worse(F.col("a"), task).alias("w")).first()
        return {w.strategy: w.json and json.loads(w.json) for w in row.w}

    got = ways("jd_parse", ADVERT)
    assert got == {
        "unexpected_field": ADVERT | {"岗位摘要": "候选输出中不应额外生成未约定字段"}, "direction_mismatch": ADVERT | {"岗位方向": "前端开发"}, "responsibility_drop": ADVERT | {"核心职责": ["写代码"]},
        "responsibility_skill_leak": ADVERT | {"必备技能": ["Python", "写代码"]}, "education_experience_mix": ADVERT | {"经验要求": "3年；本科"},
    }
    assert ways("jd_parse", {"岗位方向": "其他"})["direction_mismatch"] == {"岗位方向": "后端开发"} and ways("jd_parse", {})["responsibility_drop"] is None
    resume = {"目标岗位": "x", "教育背景": ["本科"], "项目经历": ["p", "q"], "优势标签": ["t"]}
    got = ways("resume_parse", resume)
    assert got["resume_strength_drop"]["优势标签"] == [] and got["resume_project_drop"]["项目经历"] == ["p"] and got["resume_education_skill_leak"]["核心技能"] == ["本科"]
    got = ways("match", {"匹配结论": "c", "匹配优势": ["a"], "主要短板": ["b"], "简历优化建议": []})
    assert got["match_strength_gap_swap"]["匹配优势"] == ["b"] and got["match_gap_drop"]["主要短板"] == [] and got["match_suggestion_drop"] is None


def test_bootstrap_preferences(spark):
    rows = spark.createDataFrame(
        [(f"r{i}", "jd_parse", dumped(ADVERT)) for i in range(20)] + [("m", None, dumped({"匹配结论": "c"}))], "id string, task_type string, a string"
    )
    rows = rows.select("id", "task_type", messages(F.lit("问"), F.col("a")).alias("messages"))
    got = {r.source_id: r for r in preferences.bootstrap_preferences(rows).collect()}
    names = list(preferences.WORSE["jd_parse"])
    for i in range(20):
        r = got[f"r{i}"]
        want = names[int(hashlib.sha1(f"r{i}".encode()).hexdigest()[:8], 16) % 5]
        assert r.meta.rejection_strategy == want and r.id == f"r{i}_{want}" and len(r.prompt) == 2 and json.loads(r.chosen[0].content) == ADVERT and r.chosen[0].content != r.rejected[0].content
    assert got["m"].meta.rejection_strategy == "unexpected_field" and got["m"].task_type == "jd_parse"


def test_explanations_and_match_samples(spark):
    label = {"匹配等级": "较匹配", "岗位方向匹配": True, "学历匹配": False, "经验匹配": True, "命中技能": list("abcdefg"), "缺失技能": [], "命中项目": ["p", "q", "r"]}
    rows = [("synthetic_match_1_2_3", "JD 文", "简历", label, dumped({"jd_direction": "后端", "entity_split": "train"})), ("x_ocr", "J", "R", {"匹配等级": "低匹配"}, "{}")]
    df = spark.createDataFrame(rows, f"id string, jd_text string, resume_text string, label struct<{preferences.LABEL.replace('` ', '`:')}>, meta string")
    got = {r.id: r for r in preferences.match_samples(df, normalized_hash).collect()}
    a = json.loads(got["synthetic_match_1_2_3"].messages[2].content)
    assert a["匹配优势"] == ["求职方向与岗位方向一致", "经验背景满足岗位要求", "已覆盖关键技能：a、b、c、d、e、f", "项目经历提供直接岗位证据：p；q"] and a["主要短板"] == ["学历条件与 JD 要求存在差距"]
    assert a["推荐投递岗位方向"] == ["后端"] and a["简历优化建议"] == [preferences.GO_ON] and got["synthetic_match_1_2_3"].source_group == "synthetic_match_1_2"
    assert got["synthetic_match_1_2_3"].linked_source_groups[0] == "match_jd:" + hashlib.sha1("jd文".encode()).hexdigest() and json.loads(got["synthetic_match_1_2_3"].meta) == {"entity_split": "train"}
    b = json.loads(got["x_ocr"].messages[2].content)
    assert got["x_ocr"].source_group == "x" and b["匹配结论"] == preferences.POOR and len(b["主要短板"]) == 3 and b["匹配优势"] == [preferences.NO_POINTS] and b["推荐投递岗位方向"] == [preferences.NO_ROLE]


def test_mismatch_preferences_and_audit(spark):
    same, other = dumped(ADVERT), dumped(ADVERT | {"岗位方向": "前端开发"})
    rows = [
        ("a", "jd_parse", "t", same, other, ""), ("b", "jd_parse", "t", same, same, ""), ("c", "jd_parse", "t", same, None, " raw "),
        ("d", "match", "t", dumped({"匹配等级": "高匹配"}), None, "")
    ]
    df = spark.createDataFrame(
        rows, "id string, task string, text string, label string, parsed string, prediction string"
    ).withColumn("rule_result", F.lit(dumped({"匹配等级": "低匹配"})))
    got = {r.id: r for r in preferences.mismatch_preferences(df).collect()}
    assert set(got) == {"a", "c", "d"} and got["c"].rejected[0].content == "raw" and got["d"].meta.rejection_strategy == "match_analysis_mismatch" and got["a"].prompt[1].content.endswith("JD：\nt")
    prefs = preferences.mismatch_preferences(df)
    both = prefs.withColumns({"split": F.lit("train"), "source_id": F.col("id")}).unionByName(
        prefs.filter("id = 'a'").withColumns({"split": F.lit("valid"), "source_id": F.lit("h")})
    )
    one = preferences.audit(both, spark.createDataFrame([("h",)], "id string")).first()
    assert (
        one.train, one.valid, one.invalid_rows, one.duplicate_ids, one.chosen_equals_rejected, one.holdout_overlap, one.cross_split_prompt_hashes
    ) == (3, 1, 1, 1, 0, 1, 1)
    assert not one.format_ready and one.preference_origin == "non_synthetic_or_unknown"


LABEL = ("后端", ["本科"], ["Python", "MySQL"], [], ["项目甲。", "项目乙"], ["踏实"])


def resume_rows(spark, n=1):
    return spark.createDataFrame([(f"r{i}", f" 正文 {i} python mysql 大型系统开发经历 " * 6, LABEL) for i in range(n)], f"id string, text string, label {resumes.LABEL}")


def test_renderings(spark):
    got = {r.variant: r.rendered for r in resumes.renderings(resume_rows(spark)).collect()}
    assert got["profile_card"] == "候选人简历\n目标岗位：后端\n教育背景：本科\n核心技能：Python、MySQL\n项目经历：\n1. 项目甲。\n1. 项目乙\n优势标签：踏实"
    assert got["bullets"] == "求职方向：后端\n教育：\n- 本科\n技能栈：\n- Python\n- MySQL\n实习：\n项目：\n- 项目甲。\n- 项目乙\n优势：\n- 踏实"
    assert got["compact"] == "目标岗位 后端\n教育 本科\n技能 Python、MySQL\n项目 项目甲。；项目乙\n优势 踏实"
    assert got["ocr_like"] == "候选人目标:后端\n教育经历:本科\n核心技能:Python / My SOL\n项目经历:\n- 项目甲\n- 项目乙\n个人优势:踏实"
    assert got["mixed_cn_en"] == "Target Role: 后端\nEducation: 本科\nSkills: Python, MySQL\nProjects:\n* 项目甲。\n* 项目乙\nInternships:\n\nStrengths: 踏实"
    pool = {r.id: r for r in resumes.synthetic_pool(resume_rows(spark)).collect()}
    assert pool["r0_ocr_like"].source_type == "synthetic_ocr_like" and pool["r0_compact"].source_group == "r0"
    twice = resume_rows(spark).unionByName(resume_rows(spark).withColumn("id", F.lit("s")))
    samples = resumes.samples(twice)
    assert samples.count() == 6 and {r.id for r in resumes.samples_to_pool(samples).collect()} == {f"r0_{v}" for v in resumes.RENDERINGS}


def test_normalized_resumes(spark):
    row = resumes.normalized_rows(spark.createDataFrame([("张三\r\n\r\n\r\n\r\n教育背景：\r\n 某　大学\t 本科\n项目经历\n做事",)], "text string")).first()
    assert row.clean_text == "张三\n\n教育背景：\n某 大学 本科\n项目经历\n做事" and row.normalized_text == "张三\n\n教育背景：\n某 大学 本科\n\n项目经历：\n做事"


def test_pools_of_resumes(spark):
    good = json.dumps({"license_status": "confirmed", "intended_usage": "training"})
    public = resume_rows(spark, 2).withColumns(
        {"task": F.lit("resume_parse"), "source_type": F.lit("public_text"), "meta": F.when(F.col("id") == "r0", good).otherwise("{}")}
    )
    own = public.filter("id = 'r1'").withColumn("id", F.lit("own"))
    assert {r.id for r in resumes.combined_pool(own, own, public=public).collect()} == {"own", "r0"}
    adverts = spark.createDataFrame(
        [("a", 1, "后端开发工程师", "", "熟悉 python 与 mysql，硕士及以上学历"), ("b", 2, "文员", "", "python mysql"), ("c", 3, "后端开发工程师", "", "python")],
        "id string, index int, job_title string, company string, raw_text string"
    )
    made = resumes.from_adverts(adverts, VOCABULARY).collect()
    assert [r.id for r in made] == ["resume_bootstrap_1_a"] and made[0].label["教育背景"] == ["硕士及以上学历，计算机相关专业，示例高校"] and made[0].text.startswith("目标岗位：后端开发\n教育背景：硕士")


def test_match_pool(spark):
    adverts = spark.createDataFrame(
        [(f"{'hf_job_educational_' if i % 2 else 'a'}{i}", "后端开发工程师" if i % 3 else "前端开发工程师", f"任务类型：从岗位中提取学历\n任职要求：熟悉 Python 和 Java，本科，编号{i}") for i in range(40)],
        "id string, job_title string, raw_text string"
    )
    people = spark.createDataFrame(
        [(f"r{i}", f"简历 {i} python 本科", (("后端开发", "前端开发", "测试开发")[i % 3], ["本科"], ["Python"], [], ["Python 项目"], [])) for i in range(60)],
        f"id string, text string, label {resumes.LABEL}"
    )
    rows = resumes.match_pool(adverts, people, VOCABULARY, max_adverts=30).collect()
    metas = [json.loads(r.meta) for r in rows]
    by = {}
    for r, m in zip(rows, metas, strict=True):
        parts = r.id.split("_")
        by.setdefault(m["jd_entity_hash"], []).append((parts[-1], m["jd_direction"] == m["resume_direction"]))
        assert r.label["岗位方向匹配"] == (m["jd_direction"] == m["resume_direction"]) and r.label["命中技能"] == ["Python"] and r.label["缺失技能"] == ["Java"] and "任务类型" not in r.jd_text
    assert all(
        sorted(v) == [("1", True), ("2", True), ("3", False)] or len(v) < 3 for v in by.values()
    ) and sum(len(v) == 3 for v in by.values()) >= 24 and len(by) <= 30
    assert sum("hf_job_educational" in r.id for r in rows) <= 12 * 3 and {m["entity_split"] for m in metas} == {"train", "valid", "test"}
    sides = {}
    for m in metas:
        for k in ("jd_entity_hash", "resume_entity_hash"):
            sides.setdefault(m[k], set()).add(m["entity_split"])
    assert all(len(s) == 1 for s in sides.values())
