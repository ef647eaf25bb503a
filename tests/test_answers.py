"""Normalised answers, marked spans, isolated splits, audits, selections and percentiles on literal rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import answers, audits, dedup, privacy, selection, spans, statistics
from curatrix.operators.adverts import messages

VOCABULARY = {"Python": ["python"], "Java": ["java"], "MySQL": ["mysql"], "PyTorch": ["pytorch"]}


def dumped(x):
    return json.dumps(x, ensure_ascii=False)


def one(spark, said, context=""):
    row = spark.createDataFrame([(said if isinstance(said, str) else dumped(said), context)], "a string, c string").select(
        answers.normalized(F.col("a"), F.col("c"), VOCABULARY, {"沟通能力": ["沟通"], "执行": []}).alias("x")
    ).first()
    return row.x and json.loads(row.x)


def test_answers_to_adverts(spark):
    said = {
        "岗位方向": "大模型应用", "核心职责": ["写代码", "任职要求：本科及以上学历，3年以上开发经验", "加分项：熟悉 Java", "经验要求：5年以上经验"], "必备技能": "python\nmysql", "任职要求": [],
        "岗位要求": ["熟悉 Python"], "加分项": ["x", "X"]
    }
    got = one(spark, "<think>x</think>" + dumped(said) + " 完")
    assert got["核心职责"] == ["写代码"] and got["任职要求"] == ["熟悉 Python", "本科及以上学历，3年以上开发经验"] and got["加分项"] == ["x", "熟悉 Java"]
    assert got["必备技能"] == ["Python"] and got["经验要求"] == "5年以上经验" and got["学历要求"] == "本科及以上" and got["岗位方向"] == "算法工程"
    context = "岗位名称：后端开发工程师\n岗位职责：\n1.写代码\n2.做测试\n3.写文档\n任职要求：\n熟悉 Java"
    got = one(spark, {"核心职责": ["1.写代码", "2.做测试"], "岗位方向": "", "必备技能": ["Java", "Go"]}, context)
    assert got["核心职责"] == ["1.写代码", "2.做测试", "3.写文档"] and got["岗位方向"] == "后端开发" and got["必备技能"] == ["Java"]
    assert one(spark, {"核心职责": ["1.别的"]}, context)["核心职责"] == ["1.别的"]
    assert one(spark, "no json") is None and one(spark, "")is None


def test_answers_to_resumes_and_matches(spark):
    said = {
        "目标岗位": "后端 开发工程师", "教育背景": {"学校": "某大学", "学历": "本科"}, "核心技能": ["python", "Go", "PYTHON"], "实习经历": None, "项目经历": ["做了甲；做了乙。", ["丙"]],
        "优势标签": ["具备沟通能力、执行能力强和学习能力"]
    }
    got = one(spark, said)
    assert got == {"目标岗位": "后端开发", "教育背景": ["某大学，本科"], "核心技能": ["Python", "Go"], "实习经历": [], "项目经历": ["做了甲。", "做了乙。", "丙。"], "优势标签": ["沟通能力", "执行", "学习"]}
    got = one(spark, {"匹配结论": " 好  的 ", "匹配优势": "a", "主要短板": ["b", "B"], "其他": 1})
    assert got == {"匹配结论": "好 的", "匹配优势": ["a"], "主要短板": ["b"], "简历优化建议": [], "推荐投递岗位方向": []}


def test_marked_spans(spark):
    rows = [("会用 Python 编程", "会用 @@Python##K @@编程##S"), ("a", "@@a##L"), ("a", "a@@b"), ("ab", "@@a##Lc"), ("a", "@@##Ka"), ("x", "x"), ("", "x")]
    got = [
        r.s for r in spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)], "i int, t string, m string"
        ).select("i", spans.marked_spans(F.col("t"), F.col("m")).alias("s")).orderBy("i").collect()
    ]
    assert [s and [(x.start, x.end, x.label, x.text) for x in s] for s in got] == [
        [(3, 9, "K", "Python"), (10, 12, "S", "编程")], [(0, 1, "L", "a")], None, None, None, [], None
    ]


def test_prepared_sentences(spark):
    kind = "pos int, input string, output string, meta string"
    test = spark.createDataFrame([(0, "用 A", "用 @@A##K", dumped({"id": 7, "job_id": "j1"})), (1, "用  a", "用  @@a##K", "{}"), (2, "坏", "@@", "{}")], kind)
    train = spark.createDataFrame(
        [
            (0, "别的", "别的", dumped({"job_id": "j1"})), (1, "用 a", "用 @@a##K", dumped({"job_id": "j2"})),
            (2, "新 B", "新 @@B##T@@B##T", dumped({"job_id": "j3"})), (3, "好 B", "好 @@B##T", dumped({"job_id": "j3"}))
        ],
        kind
    )
    source = {"processor": "chinese_lkst", "language": "zh", "annotation": "gold", "license_status": "confirmed", "intended_usage": "training"}
    kept, bad = spans.prepared({"test": test, "train": train}, "d", source)
    assert {(r.split, r.pos): r.outcome for r in kept.collect()} == {
        ("test", 0): "kept", ("test", 1): "within_split_text", ("train", 0): "cross_split_source_group", ("train", 1): "cross_split_text",
        ("train", 3): "kept"
    }
    first = kept.filter("id = 'd_test_7'").first()
    assert first.source_group == "d:j1" and first.label["知识技能"] == ["A"] and first.label["全部技能"] == ["A"] and {(r.split, r.error) for r in bad.collect()} == {
        ("test", "malformed markup"), ("train", "malformed markup")
    }
    r = spans.dataset_report(kept, bad, source).first()
    assert (r.total_processed, r.span_count, r.isolation_drops, r.invalid_rows, r.invalid_source_rate, r.ready_for_training) == (2, 2, 3, 2, 0.2857, False)
    tokens = spark.createDataFrame(
        [(0, "p", "web", ["I", "use", "Go"], ["O", "O", "O"], ["O", "O", "B"]), (1, "p", "web", ["x"], ["I"], ["O"]), (2, "p", "web", ["y"], ["O"], ["O"])],
        "pos int, idx string, source string, tokens array<string>, tags_skill array<string>, tags_knowledge array<string>"
    )
    kept, bad = spans.prepared({"test": tokens}, "s", source | {"processor": "skillspan_bio"})
    rows = {r.id: r for r in kept.collect()}
    assert set(rows) == {"s_test_web_p_0", "s_test_web_p_2"} and rows["s_test_web_p_0"].spans[0].start == 6 and rows["s_test_web_p_0"].label["知识技能"] == ["Go"] and bad.first().error == "invalid tags"
    with pytest.raises(ValueError, match="processor"):
        spans.prepared({}, "d", {})


def test_audits_of_imports(spark):
    adverts = spark.createDataFrame(
        [("s", "标题", "10K", "学历要求：本科", dumped({"language": "zh", "training_eligible": True})), ("s", "", "", "", "{}")],
        "source string, job_title string, salary string, raw_text string, meta string"
    )
    r = audits.advert_report(adverts).first()
    assert (
        r.total_rows, r.training_eligible_rows, r.avg_title_length, r.education_coverage, r.experience_coverage, r.salary_coverage
    ) == (2, 1, 2.0, 0.5, 0.0, 0.5)
    d = {(r.name, r.value): r.n for r in audits.advert_distributions(adverts).collect()}
    assert d["source", "s"] == 2 and d["intended_usage", "unspecified"] == 2 and d["language", "zh"] == 1
    pairs = spark.createDataFrame(
        [
            ("j", "r", "x", ("good", None), "{}"),
            (" j", "r ", "x", (None, 0.5), dumped({"license_status": "confirmed", "intended_usage": "training", "provenance_status": "known"}))
        ],
        "jd_text string, resume_text string, source_type string, label struct<raw_label:string,raw_score:double>, meta string"
    )
    r = audits.pair_report(pairs).first()
    assert (r.total_rows, r.duplicate_pair_rows, r.training_eligible_rows, r.score_coverage, r.avg_jd_length, r.training_ready) == (2, 1, 1, 0.5, 1.5, True)
    assert {(r.value, r.n) for r in audits.pair_distributions(pairs).filter("name = 'raw_label'").collect()} == {("good", 1)}
    label = "struct<`目标岗位`:string,`教育背景`:array<string>,`核心技能`:array<string>,`实习经历`:array<string>,`项目经历`:array<string>>"
    people = spark.createDataFrame(
        [("resume_parse", "t", "abc", ("x", ["y"], [], [], []), None, "{}"), ("resume_ner", "t", "", None, ["B-NAME", "O"], "{}")],
        f"task string, source_type string, text string, label {label}, ner_tags array<string>, meta string"
    )
    r = audits.resume_report(people).first()
    assert (
        r.total_rows, r.avg_text_length, r.target_job_coverage, r.skills_coverage, r.rows_with_sensitive_entities, r.resume_ner_training_ready
    ) == (2, 3.0, 1.0, 0.0, 1, False)
    assert {(r.value, r.n) for r in audits.resume_distributions(people).filter("name = 'ner_tag'").collect()} == {("B-NAME", 1), ("O", 1)}


def sample(i, split, title, answer, group="g", **meta):
    return (str(i), split, "jd_parse", group, f"岗位名称：{title}\n3年以上开发经验", answer if isinstance(answer, str) else dumped(answer), dumped(meta))


def samples(spark, *rows):
    df = spark.createDataFrame(list(rows), "id string, split string, task_type string, source_group string, ask string, a string, meta string")
    return df.select(
        "id", "split", "task_type", "source_group", F.array("source_group").alias("linked_source_groups"), "meta",
        messages(F.col("ask"), F.col("a")).alias("messages"), F.lit(None).cast("string").alias("source_id")
    )


def test_audits_of_samples(spark):
    full = {"岗位方向": "前端开发", "核心职责": ["a"], "必备技能": ["x"], "学历要求": "本科", "经验要求": ""}
    df = samples(
        spark, sample(1, "train", "后端开发", full, quality_tier="quality_weak"), sample(2, "valid", "后端开发", full, quality_tier="strict"),
        sample(2, "valid", "讲师", "{", "h"), sample(3, "test", "前端开发", full, "h")
    )
    r = audits.sample_report(df).first()
    assert (r.total_samples, r.json_valid_rate, r.avg_skill_count, r.education_coverage, r.experience_coverage) == (4, 0.75, 1.0, 0.75, 0.0)
    r = audits.sample_audit(df, "jd").first()
    assert (
        r.total, r.invalid_json, r.duplicate_ids, r.cross_split_duplicates, r.cross_split_inputs, r.cross_split_linked_groups, r["empty_经验要求"],
        r.field_quality_ok, r.format_ready
    ) == (4, 1, 0, 1, 1, 1, 0.75, False, False)
    gate = audits.task_gate(audits.sample_audit(df, "jd"), df, "jd")
    assert not gate.first().ready_for_sft
    with pytest.raises(RuntimeError, match="count_ready"):
        audits.require_ready(audits.roll_up({"jd": gate}, {"jd": {"risk_ready": False}}), ["jd"])
    risks = audits.with_risks(df)
    r = audits.risk_report(risks).first()
    assert (r.total, r.risky, r.high_risk) == (4, 4, 1) and audits.risk_samples(risks, 2).count() == 2
    conflicts = audits.direction_conflicts(df)
    r = audits.conflict_report(conflicts).first()
    assert (r.signaled_rows, r.conflict_rows) == (3, 2) and {
        (g.expected, g.actual, g["count"]) for g in audits.conflict_groups(conflicts).collect()
    } == {("后端开发", "前端开发", 1)}
    r = audits.gap_report(audits.experience_gaps(df)).first()
    assert (r.empty_rows, r.recoverable_rows, r.recoverable_rate) == (3, 3, 1.0)
    assert audits.held_out(df, spark.createDataFrame([("3_jd_parse",)], "id string")).count() == 1
    mix = {(m.split, m.task): (m.rows, m.unique_source_groups) for m in audits.task_mix(df).collect()}
    assert mix["valid", "jd_parse"] == (2, 2) and not audits.multitask_gate(df).first().ready_for_sft
    r = audits.samples_profile(df).first()
    assert (r.rows, r.unique_source_groups, r.source_group_ratio) == (4, 2, 0.5)
    r = audits.resume_sample_report(df.withColumn("id", F.concat_ws("_", "source_group", "id"))).first()
    assert (r.total, r.unique_source_groups, r.expansion_ratio, r.max_source_group_size, r.profile_ready) == (4, 2, 2.0, 2, False)


def test_audits_of_pairs(spark):
    label = "struct<`学历匹配`:boolean,`经验匹配`:boolean>"
    rows = [
        ("synthetic_match_hf_job_educational_1", "synthetic_text", "本科及以上学历，3年以上开发经验", "硕士，手机 13812345678", (True, False), dumped({"entity_split": "train"})),
        ("b", "real", "本科", "大专", (True, True), dumped({"annotation_status": "human_verified"})), ("c", "x", "", "", None, "{}")
    ]
    df = spark.createDataFrame(rows, f"id string, source_type string, jd_text string, resume_text string, label {label}, meta string")
    r = audits.pair_origins(df).first()
    assert (
        r.total_rows, r.synthetic_rows, r.human_reviewed_pairs, r.unknown_pairs, r.training_origin, r.educational_source_rate,
        r.source_concentration_ready
    ) == (3, 1, 1, 1, "mixed", 0.3333, True)
    assert [(r.id, r.labelled, r.expected) for r in audits.degree_consistency(df).orderBy("id").collect()] == [("b", True, False), ("c", False, True)]
    assert {(r.split, r.required, r.matched) for r in audits.requirement_report(df, "degree").collect()} == {("train", 1, 1), ("missing", 1, 1)}
    years = audits.requirement_report(df, "years")
    assert {(r.split, r.required, r.unmatched) for r in years.collect()} == {("train", 1, 1)} and not audits.requirements_ready(years).first().ready
    assert {
        (r.level, r.n) for r in audits.requirement_levels(df, "degree").collect()
    } == {("本科", 2)} and audits.requirement_levels(df, "years").first().level == "3年"
    r = audits.privacy_report(df, "resume_text").first()
    assert (r.row_count, r.rows_with_findings, r.ready) == (3, 1, False) and audits.privacy_kinds(df, "resume_text").count() >= 1


def test_source_admission(spark):
    label = ("x", ["y"], ["z"], [], ["p"])
    kind = "struct<`目标岗位`:string,`教育背景`:array<string>,`核心技能`:array<string>,`实习经历`:array<string>,`项目经历`:array<string>>"
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
    got = {r.name: r for r in audits.source_admission(rows, manifest).collect()}
    assert got["good"].final_decision == "training_allowed" and got["flat"].final_decision == "rejected" and got["flat"].unique_content_groups == 1 and got["none"].imported_rows == 0 and not got["none"].privacy_ready
    status = audits.manifest_status(manifest.withColumn("path", F.col("name")), spark.createDataFrame([("good",)], "path string")).collect()
    assert {(r.name, r.exists, r.training_eligible) for r in status} == {("good", True, True), ("flat", False, True), ("none", False, True)}


def test_resume_rows_for_training(spark):
    df = spark.createDataFrame(
        [("张三_13812345678.pdf", "电话 13812345678", {"a": "邮箱 x@y.com"}, "k")],
        "file_name string, text string, sections map<string,string>, kept string"
    )
    r = privacy.rows_for_training(df).first()
    assert "138" not in r.text and "x@y.com" not in r.sections["a"] and r.kept == "k"


def test_selections(spark):
    df = spark.createDataFrame([(str(i),) for i in range(20)], "id string")
    count = lambda d: {r.split: r["count"] for r in d.groupBy("split").count().collect()}
    assert count(selection.split_samples(df, "id", "s", 0.8, 0.1)) == {"train": 16, "valid": 2, "test": 2}
    assert count(selection.split_samples(df.limit(2), "id", "s", 0.8, 0.1)) == {"train": 2, "valid": 1, "test": 1}
    assert count(selection.split_two(df, "id", "s", 0.1)) == {"train": 18, "valid": 2} and count(selection.split_two(df.limit(1), "id", "s", 0.1)) == {"train": 1, "valid": 1}
    assert selection.sample(df, 5, "s", "id").count() == 5 and selection.sample(df, None, "s", "id").count() == 20
    ranks = [(r.id, r["rank"]) for r in selection.ranked(df.repartition(4), [F.col("id").desc()]).collect()]
    assert sorted(ranks, key=lambda x: x[1]) == [(i, k) for k, i in enumerate(sorted((str(i) for i in range(20)), reverse=True))]
    from curatrix.sources.folders import shared_copy

    linked = spark.createDataFrame(
        [(f"r{i}", [f"g{i // 2}"], [f"h{i // 6}"] if i < 12 else []) for i in range(40)], "id string, g array<string>, h array<string>"
    )
    out = selection.split_linked(linked, ["g", "h"], "s", 0.8, 0.1, lambda d: shared_copy(d, "components")).collect()
    by = {}
    for r in out:
        for k in [*r.g, *r.h]:
            by.setdefault(k, set()).add(r.split)
    assert len(out) == 40 and all(len(v) == 1 for v in by.values()) and {r.split for r in out} == {"train", "valid", "test"}
    with pytest.raises(ValueError, match="without a split"):
        selection.preassigned(df, F.lit("x"))
    tiers = spark.createDataFrame([(str(i), "ab"[i % 2], i % 5, i % 3) for i in range(20)], "id string, tier string, quality_score int, quality_risk_score int")
    low = selection.review(tiers, "tier", 2, "s", "lowest-score").collect()
    assert {(r.tier, r.id) for r in low} == {("a", "10"), ("a", "0"), ("b", "5"), ("b", "15")} or len(low) == 4
    assert selection.review(tiers, "tier", 3, "s").count() == 6
    capped = selection.rate_cap(tiers, F.col("tier") == "a", 0.2, ["id"])
    assert capped.filter("tier = 'a'").count() == 2 and capped.count() == 12


def test_percentiles(spark):
    rng = random.Random(3)
    rows = [
        (g, float(rng.randint(0, 50 if g == "a" else 10**6))) for g in "ab" for _ in range(3000)
    ] + [("c", 1.0), ("c", 2.0), ("c", 3.0), ("c", 4.0), ("d", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in statistics.percentiles(df, "g", "v", {"p50": 0.5, "p95": 0.95}, cells=16).collect()}
    for g in "abcd":
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert (got[g].p50, got[g].p95, got[g].n) == (own[max(0, -(-len(own) * 50 // 100) - 1)], own[max(0, -(-len(own) * 95 // 100) - 1)], len(own))


def test_near_pairs_with_planted_copies(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(30)]
    rows = [(i, "x", t) for i, t in enumerate(base)] + [
        (100 + i, "x", t[:-k]) for i, t in enumerate(base[:10]) for k in (3,)
    ] + [(200 + i, "y", t) for i, t in enumerate(base[:5])] + [(300, "x", base[0])]
    got = {
        (r.left_id, r.right_id): r.jaccard for r in dedup.jaccard_pairs(
            spark.createDataFrame(rows, "id long, bucket string, t string"), "id", "bucket", "t"
        ).collect()
    }
    want = {}
    texts = {}
    for i, b, t in rows:
        texts.setdefault((b, t), i)
    for (b, t), i in texts.items():
        for (c, u), j in texts.items():
            if b == c and i < j:
                p, q = dedup.shingles(t, 5), dedup.shingles(u, 5)
                if len(p & q) / len(p | q) >= 0.9:
                    want[i, j] = len(p & q) / len(p | q)
    assert got.keys() == want.keys() and len(want) == 10 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_cleaning(spark):
    df = spark.createDataFrame([("S-1", "文本", "公司", "标题", "北京")], "s string, x string, c string, t string, p string")
    got = df.select(
        T.bucket_key(F.col("s"), F.col("x"), 32, F.col("c"), F.col("t"), F.col("p")).alias("a"),
        T.bucket_key(F.col("s"), F.col("x"), 32, F.lit(""), F.col("t"), F.col("p")).alias("b"), T.bucket_key(F.col("s"), F.col("x")).alias("d"),
        T.strip(T.normalize_space(T.strip_furniture(F.lit("<nav>m</nav><p>a<b>b</b></p><script>x</script>")))).alias("e")
    ).first()
    assert got.asDict() == {"a": "s1|公司|标题|北京", "b": "s1|标题|北京|文本", "d": "s1|文本", "e": "a\nb"}
