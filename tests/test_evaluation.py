"""Scores, layers, error types, readiness, review queues and gold audits on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from curatrix.operators import evaluation as E


def dumped(x):
    return json.dumps(x, ensure_ascii=False)


def test_set_scores(spark):
    rows = [(["A ", "b"], ["a", "c"]), ([], []), ([], ["a"]), (["a"], []), (None, None), (["a", "A"], ["a"])]
    got = [
        r.s.asDict() for r in spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)], "i int, p array<string>, g array<string>"
        ).select("i", E.set_scores(F.col("p"), F.col("g")).alias("s")).orderBy("i").collect()
    ]
    want = [(0.5, 0.5, 0.5), (1, 1, 1), (0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert [tuple(g[k] for k in ("precision", "recall", "f1")) for g in got] == want


PREDICTED = [
    ("a", True, {"岗位方向": "后端 开发", "核心职责": ["x"], "必备技能": ["Go"]}, {"岗位方向": "后端  开发", "核心职责": ["x", "y"], "必备技能": ["go"]}, "t1"),
    ("b", True, {"岗位方向": "前端"}, {"岗位方向": "后端"}, "t1"),
    ("c", False, None, {"岗位方向": "后端"}, "t2"),
]


def test_evaluated_predictions(spark):
    df = spark.createDataFrame(
        [(i, "jd_parse", ok, p and dumped(p), dumped(g), s) for i, ok, p, g, s in PREDICTED],
        "id string, task string, ok boolean, parsed string, label string, source_type string"
    )
    got = {r.field: r for r in E.evaluated(df).collect()}
    assert got["岗位方向"].exact_match == 0.5 and got["核心职责"].recall == 0.75 and got["必备技能"].f1 == 1 and got["经验要求"].exact_match == 1
    rows = E.scored(df, E.SPECS["jd_parse"])
    one = E.rates(rows).first()
    assert (one.num_samples, round(one.valid_rate, 4), one.num_mismatch_samples) == (3, 0.6667, 2)
    assert {(r.id, tuple(r.mismatched)) for r in E.mismatches(rows).collect()} == {("a", ("核心职责",)), ("b", ("岗位方向",))}
    assert {r.source_type for r in E.evaluated(df, "source_type").collect()} == {"t1"}
    with pytest.raises(ValueError, match="one known task"):
        E.evaluated(df.withColumn("task", F.when(F.col("id") == "a", "jd_parse").otherwise("resume_parse")))


def test_layers_and_errors(spark):
    gold = {"匹配等级": "高匹配", "岗位方向匹配": True, "学历匹配": True, "经验匹配": False, "命中技能": ["Go"], "缺失技能": []}
    found = gold | {"匹配等级": "低匹配", "命中技能": ["Java"]}
    df = spark.createDataFrame(
        [("a", dumped(gold), True, True, dumped(found), (dumped(gold), True), ("{}", False))],
        "id string, label string, jd_ok boolean, resume_ok boolean, rule_result string, raw_model struct<rule_result:string,structured_result_available:boolean>, normalized struct<rule_result:string,structured_result_available:boolean>"
    )
    got = {(r.layer, r.field): r for r in E.metrics(E.layers(df), "layer").collect()}
    assert got["raw_model_derived", "匹配等级"].exact_match == 1 and got["product_final", "匹配等级"].exact_match == 0 and ("normalized", "匹配等级") not in got and got["product_final", "命中技能"].f1 == 0
    kinds = "命中技能 array<string>, 缺失技能 array<string>, 匹配等级 string, 岗位方向匹配 boolean, 学历匹配 boolean, 经验匹配 boolean"
    kinds = ", ".join(f"`{k.split()[0]}` {k.split()[1]}" for k in kinds.split(", "))
    errors = E.error_types(F.from_json("label", kinds), F.from_json("rule_result", kinds), F.array(F.lit("技能同义词")), F.lit(False), F.lit(True))
    rows = df.withColumn("errors", errors)
    assert rows.first().errors == ["输出格式错误", "技能漏召回", "技能误识别", "同义表达错误", "匹配等级错误", "模型解释与结构矛盾"]
    assert E.error_ranking(rows).count() == 6
    said = spark.createDataFrame(
        [(dumped(found), dumped({"匹配优势": ["方向一致", "掌握 Go"], "主要短板": ["暂无"], "匹配结论": "高度匹配"})), (dumped(found), "{}")],
        "rule_result string, analysis string"
    )
    one, two = E.explained(said, {"Go": [], "Java": []}).collect()
    assert not one.structural_consistent and one.contradictions == ["low_level_but_positive_conclusion"] and "匹配优势:unsupported_skill:Go" in one.ungrounded and two.structural_consistent and two.evidence_grounded


def test_readiness_and_regressions(spark):
    long = spark.createDataFrame(
        [("jd", "岗位方向", "exact_match", 0.96), ("jd", "", "valid_rate", 0.5), ("match", "命中技能", "f1", 0.85)],
        "report string, field string, key string, value double"
    )
    got = {r.name: r for r in E.readiness(spark, long).collect()}
    assert len(got) == 22 and got["jd_direction_exact_match"].passed and not got["jd_json_valid_rate"].passed and got["match_hit_skill_f1"].passed and got["resume_skill_f1"].actual == 0
    base = E.readiness(spark, long.withColumn("value", F.col("value") + F.when(F.col("field") == "岗位方向", 0.005).otherwise(0.02)))
    worse = {r.name for r in E.regressions(E.readiness(spark, long), base).filter("not passed").collect()}
    assert worse == {"jd_json_valid_rate", "match_hit_skill_f1"}
    one = E.deltas(spark.createDataFrame([(1.0, 2)], "a double, b int"), spark.createDataFrame([(3.0, 1)], "a double, b int"))
    assert {(r.key, r.delta) for r in one.collect()} == {("a", 2.0), ("b", -1.0)}
    df = spark.createDataFrame([("a", "jd_parse", True, "{}", "{}")], "id string, task string, ok boolean, parsed string, label string")
    rows = E.scored(df, E.SPECS["jd_parse"])
    assert {
        (r.field, r.key) for r in E.long_metrics("jd", E.metrics(rows), E.rates(rows)).collect()
    } >= {("", "valid_rate"), ("核心职责", "f1"), ("岗位方向", "exact_match")}


def test_review_queue(spark):
    gold = spark.createDataFrame(
        [("a", "要求 3 年经验，本科", "5 年经验，硕士", dumped({"经验匹配": False, "学历匹配": True, "命中技能": ["Go"], "缺失技能": ["Java"], "匹配等级": "高匹配"})), ("b", "无", "无", "{}")],
        "id string, jd_text string, resume_text string, label string"
    )
    found = spark.createDataFrame(
        [("a", dumped({"命中技能": ["Java", "C"], "缺失技能": ["Go"], "匹配等级": "高匹配"}), 2), ("a", "{}", 1)], "id string, rule_result string, pos int"
    )
    a, b = E.review_queue(gold, found).collect()
    assert a.id == "a" and a.priority_score == 14 and a.label_missing_but_evidenced == ["Java"] and a.label_omitted_evidence == ["C"] and a.product_missed_gold == ["Go"]
    assert b.review_reasons == ["缺少对应预测结果"] and b.priority_score == 2


def test_gold_audit(spark):
    good = {"匹配等级": "高匹配", "岗位方向匹配": True, "学历匹配": True, "经验匹配": False, "命中技能": ["Go"], "缺失技能": []}
    labels = [dumped(good), dumped(good | {"匹配等级": "x", "学历匹配": "是", "缺失技能": ["Go"]}), "[]", None]
    got = [
        r.e for r in spark.createDataFrame(
            [(i, x) for i, x in enumerate(labels)], "i int, l string"
        ).select("i", E.label_errors(F.col("l")).alias("e")).orderBy("i").collect()
    ]
    assert got == [[], ["invalid_match_level", "invalid_bool:学历匹配", "skill_in_both_matched_and_missing"], ["label_not_object"], ["label_not_object"]]
    meta = {"annotation_status": "human_verified", "annotator_id": "x", "reviewed_at": "y", "rationale": "z", "difficulty_tags": list(E.TAGS)}
    gold = spark.createDataFrame(
        [(f"g{i}", f"s{i}", f"岗位 {i}", f"简历 {i}", dumped(good), dumped(meta)) for i in range(20)],
        "id string, source_group string, jd_text string, resume_text string, label string, meta string"
    )
    far = spark.createDataFrame([("别的", "另外")], "jd_text string, resume_text string")
    assert E.gold_report(E.gold_rows(gold, far)).first().gold_ready
    near = spark.createDataFrame([("岗位3", "简 历 4")], "jd_text string, resume_text string")
    one = E.gold_report(E.gold_rows(gold, near, spark.createDataFrame([("岗位 5",)], "raw_text string"))).first()
    assert not one.gold_ready and (
        one.in_training_count, one.jd_in_training_count, one.resume_in_training_count, one.jd_in_task_count, one.resume_in_task_count
    ) == (0, 1, 1, 1, 0)
    bad = gold.withColumn("meta", F.lit("{}")).unionByName(gold.limit(1))
    one = E.gold_report(E.gold_rows(bad, far)).first()
    assert one.repeated_ids == 1 and one.duplicate_pair_count == 1 and one.invalid_rows == 20 and one.human_verified_rows == 1
    marked = E.with_review_fields(gold.limit(1), "legacy").first()
    assert json.loads(marked.meta)["annotation_status"] == "pending_human_review"


def test_picked_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    ids = spark.createDataFrame([("b", 0), ("a", 1)], "id string, pos int")
    assert [r.x for r in E.picked(rows, ids).collect()] == [2, 1]
    with pytest.raises(KeyError, match="c"):
        E.picked(rows, spark.createDataFrame([("c", 0)], "id string, pos int"))


def test_candidate_sets(spark):
    meta = {"annotation_status": "needs_human_review", "training_eligible": False, "difficulty_tags": ["OCR词内断开", "职责与要求边界", "跨岗位方向", "项目证据"]}
    kind = "id string, jd_text string, resume_text string, meta string"
    rows = spark.createDataFrame([(f"semantic_boundary_v2_{i}", f"岗位 {i}", "R", dumped(meta)) for i in range(15)], kind)
    none = spark.createDataFrame([("x", "别 的", "R", "{}")], kind)
    assert E.candidate_report(rows, none).first().audit_ok
    one = E.candidate_report(rows.limit(3).unionByName(none), rows.limit(1)).first()
    assert one.comparison_pair_overlap == 1 and one.problems == [
        "candidate_count_must_be_15_to_20", "ids_must_be_unique_v2_ids", "all_rows_must_need_human_review", "all_rows_must_be_training_ineligible",
        "candidate_pair_overlaps_comparison_set",
    ]
