"""Raw adverts, résumés and pairs of public files and portals on literal rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from curatrix.sources import imports

WHEN = "2026-05-17 00:00:00"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0], json.loads(rows[0].meta)


def test_job_sites(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text(
        "job_name,job_area,job_salary,com_name,work_year,education,job_benefits\n后端开发工程师,北京·海淀·上地,20-30K,\"示例\"\"公司\",3年,本科,五险一金\n,上海,,,,,\n",
        encoding="utf-8"
    )
    entry = {
        "name": "example", "type": "bosszp_csv", "local_path": str(path), "source_url": "https://example.test/jobs.csv",
        "source_revision": "revision-1", "intended_usage": "audit_only", "training_eligible": False
    }
    row, meta = one(imports.import_sources(spark, [entry, {"enabled": False}], WHEN))
    key = json.dumps(
        {"job_title": "后端开发工程师", "company": '示例"公司', "location": "北京·海淀·上地", "salary": "20-30K", "work_year": "3年", "education": "本科"},
        ensure_ascii=False, sort_keys=True
    )
    assert row.id == "example_" + hashlib.sha1(key.encode()).hexdigest() and row.html is None
    assert row.raw_text == '岗位名称：后端开发工程师\n公司名称：示例"公司\n工作地点：北京·海淀·上地\n薪资范围：20-30K\n经验要求：3年\n学历要求：本科\n福利标签：五险一金'
    assert (meta["job_area_city"], meta["job_area_detail"]) == ("北京", "海淀 / 上地") and meta["training_eligible"] is False and meta["source_revision"] == "revision-1" and meta["sft_ready"] is False
    for bad in ([], [{"type": "x", "local_path": "y"}], [{"type": "bosszp_csv"}]):
        with pytest.raises(ValueError, match="source"):
            imports.import_sources(spark, bad, WHEN)


def test_collected_offers(spark):
    df = spark.createDataFrame(
        [("测试", "上海", "None", "1年", "大专", "国企", "IT", "站点", "词", "做事")],
        "title string, place string, salary string, experience string, education string, companytype string, industry string, provider string, keyword string, description string"
    )
    row, meta = one(imports.aggregated_rows(df, "agg", "u", WHEN))
    assert row.company == "站点" and row.salary == "" and row.raw_text.split("\n")[1:3] == ["来源站点：站点", "关键词：词"] and meta["company_type"] == "国企"


def test_degree_tasks(spark):
    user = "<岗位名称>后端开发工程师</岗位名称><岗位描述>负责 Java 服务开发，本科及以上学历。</岗位描述><学历描述>本科</学历描述>"
    df = spark.createDataFrame(
        [(123, "从岗位中提取学历", user, "本科", True), (None, "", user, "本科", None), (5, "", user, None, None)],
        "job_id long, system string, user string, assistant string, diff boolean"
    )
    rows = {r.id: json.loads(r.meta) for r in imports.degree_task_rows(df, "hf", "local.parquet", WHEN, min_chars=10).collect()}
    key = json.dumps({"job_id": "", "title": "后端开发工程师", "description": "负责 Java 服务开发，本科及以上学历。", "assistant": "本科"}, ensure_ascii=False, sort_keys=True)
    assert set(rows) == {
        "hf_123", "hf_" + hashlib.sha1(key.encode()).hexdigest()
    } and rows["hf_123"]["education_label"] == "本科" and rows["hf_123"]["diff"] is True
    assert imports.degree_task_rows(df, "hf", "u", WHEN).count() == 0


def test_open_offers(spark):
    kind = "id string, title string, department string, description_html string, locations array<string>, salary_min double, salary_max double, salary_currency string, salary_period string, remote boolean, source_slug string, apply_url string"
    rows = [
        ("1", "Backend Engineer", "R&D", "<p>a &amp; b</p>" + "x" * 600, [" Berlin ", "", "Rome"], 1.5, None, "EUR", "year", True, "acme", None),
        ("2", "Sales Engineer", "", "x" * 700, None, None, None, None, None, None, "acme", "u2")
    ]
    row, meta = one(imports.open_offer_rows(spark.createDataFrame(rows, kind), "open", "src", WHEN))
    assert row.url == "src" and row.location == "Berlin | Rome" and row.salary == "1.5 EUR/year" and "远程：是\n薪资范围：1.5 EUR/year\n职位描述：\na & b\nx" in row.raw_text and meta["remote"] is True
    assert imports.open_offer_rows(spark.createDataFrame(rows, kind), "open", "src", WHEN, include=[], exclude=[]).count() == 2


POSTS = {
    "tencent": (
        {"PostId": 7, "RecruitPostName": "后台", "LocationName": "深圳", "Responsibility": "写", "RequireWorkYearsName": "三年"}, "tencent_7",
        "岗位名称：后台\n工作地点：深圳\n岗位职责：\n写\n经验要求：三年", True
    ),
    "baidu": ({"postId": "b1", "name": " 研发 ", "workContent": "做", "serviceCondition": "会"}, "baidu_b1", "岗位名称：研发\n公司名称：百度\n岗位职责：\n做\n任职要求：\n会", True),
    "jd": ({"requirementId": 3, "positionId": 4, "positionName": "店长", "jobTypeCode": "yanfa"}, "jd_careers_3", "岗位名称：店长\n公司名称：京东\n岗位职责：\n任职要求：", True),
    "meituan": (
        {"jobUnionId": 9, "name": "产品经理", "jobFamily": "产品类", "cityList": [{"name": "北京"}, {"name": ""}, {"name": "上海"}], "jobDuty": "d"},
        "meituan_9", "岗位名称：产品经理\n公司名称：美团\n职位类别：产品类\n工作地点：北京 / 上海\n部门介绍：\n岗位职责：\nd\n任职要求：\n优先条件：\n职位亮点：", True
    ),
    "didi": ({"jdId": "d2", "jobName": "司机", "jobType": "运营"}, "didi_d2", "岗位名称：司机\n公司名称：滴滴\n职位类别：运营\n岗位职责：\n任职要求：", False),
    "ctrip": ({"id": 5, "jobTitle": "客服", "jobFamilyGroupCode": "JFG_41"}, "ctrip_5", "岗位名称：客服\n公司名称：携程\n职位类别编码：JFG_41\n职位描述：", False),
}


def test_posts_of_portals(spark):
    for name, (post, ident, text, technical) in POSTS.items():
        df = spark.createDataFrame([(json.dumps(post, ensure_ascii=False),), ("{}",), (None,)], "post string")
        row, meta = one(imports.post_rows(df, imports.PORTALS[name], WHEN, keyword=F.lit("k")))
        assert (row.id, row.raw_text, meta["sft_ready"], meta["keyword"]) == (ident, text, technical, "k"), name
    row, _ = one(imports.post_rows(spark.createDataFrame([(json.dumps(POSTS["jd"][0]),)], "post string"), imports.PORTALS["jd"], WHEN))
    assert row.url.endswith("positionId=4&requirementId=3")


def test_boards(spark):
    job = {
        "id": "x1", "title": "数据工程师", "description": "<p>负责数据平台建设与维护</p>a &lt; b",
        "locations": [{"country": "中国", "city": "杭州"}, {"country": "中国", "city": "杭州"}], "minSalary": 10, "maxSalary": 20, "minExperience": 3,
        "department": {"name": "研发部"}
    }
    row, meta = one(
        imports.board_rows(
            spark.createDataFrame([(json.dumps(job, ensure_ascii=False),), ("{}",)], "post string"), "org", "公司", "social", "moka_org", "u", WHEN,
            site=12
        )
    )
    assert row.id == "moka_org_social_x1" and row.location == "中国 / 杭州" and row.salary == "10-20K" and row.url == "https://app.mokahr.com/social-recruitment/org/12#/"
    assert "招聘模式：社招\n" in row.raw_text and "经验要求：3年以上\n" in row.raw_text and row.raw_text.endswith("负责数据平台建设与维护\na < b") and meta["sft_ready"] and meta["language"] == "zh" and meta["site_id"] == 12


def test_list_and_detail_pages(spark):
    page = '<tr> <td class="first"><a href="https://hr.xiaomi.com/job/view/42">Go &amp; C<span class="hot-tip"></span></a></td> <td>研发</td> <td>Beijing</td> <td>2026-01-01</td> </tr>'
    rows = imports.list_rows(spark.createDataFrame([(page * 1 + "<tr></tr>",)], "html string"))
    assert rows.first().asDict() == {
        "href": "https://hr.xiaomi.com/job/view/42", "job_id": "42", "title": "Go & C", "category": "研发", "location": "北京",
        "publish_date": "2026-01-01"
    }
    detail = '<td class="details-title require">工作职责：</td> <td class="job-details" colspan="3">写<br/>测</td><td class="details-title">工作地点：</td><td class="details-list">wuhan</td>'
    row, meta = one(imports.detail_rows(rows.withColumn("fields", imports.detail_fields(F.lit(detail))), WHEN, "list"))
    assert row.location == "武汉" and row.raw_text == "岗位名称：Go & C\n公司名称：小米\n工作地点：武汉\n职位类别：研发\n发布日期：2026-01-01\n岗位职责：\n写\n测\n任职要求：" and meta["sft_ready"]


def test_pages_of_adverts(spark):
    rows = [
        ("<p>", "标题", "岗位" * 60, True), ("<p>", "404", "岗位" * 60, False), ('<meta name="ROBOTS" content="noindex">', "t", "岗位" * 60, False),
        ("", "t", "岗位", False), (None, None, None, False)
    ]
    got = spark.createDataFrame(rows, "h string, t string, x string, ok boolean").select(
        "ok", imports.is_advert_page(F.col("h"), F.col("t"), F.col("x")).alias("got")
    ).collect()
    assert all(r.ok == r.got for r in got)


def test_resumes_and_pairs(spark):
    df = spark.createDataFrame(
        [(0, ("正文",), "算法", ["a", None, " b "], "x、y"), (1, ("None",), "", None, None)],
        "index int, body struct<text:string>, job string, skills array<string>, edu string"
    )
    source = {
        "name": "s", "schema": "resume_parse_rows", "path": "p",
        "mapping": {"text": "body.text", "target_job": "job", "skills": "skills", "education": "edu", "projects": "no.such"}
    }
    row = imports.convert_rows(df, source).collect()
    assert len(row) == 1 and row[0].id == "s_" + hashlib.sha1("s::0::正文".encode()).hexdigest()[:12]
    assert row[0].label["核心技能"] == ["a", "b"] and row[0].label["教育背景"] == ["x", "y"] and row[0].label["项目经历"] == [] and row[0].meta.license_status == "unconfirmed"
    tagged = spark.createDataFrame([(0, ["张", "三"], [7, 0]), (1, [], [])], "index int, tokens array<string>, tags array<int>")
    got = imports.convert_rows(
        tagged, {"name": "n", "schema": "resume_ner_rows", "mapping": {"tokens": "tokens", "tags": "tags"}, "tag_names": {7: "B-NAME"}}
    ).collect()
    assert [(r.text, r.ner_tags) for r in got] == [("张三", ["B-NAME", "0"])]
    pairs = spark.createDataFrame([(0, "j", "r", "good"), (1, "j", "", "x")], "index int, a string, b string, c string")
    got = imports.convert_rows(pairs, {"name": "m", "schema": "match_pair_rows", "mapping": {"jd_text": "a", "resume_text": "b", "label": "c"}}).collect()
    assert [(r.id, r.label.raw_label, r.label.raw_score) for r in got] == [("m_" + hashlib.sha1(b"m::0::j::r").hexdigest()[:12], "good", "")]
    with pytest.raises(ValueError, match="schema"):
        imports.convert_rows(pairs, {"schema": "x"})


def test_written_resumes(spark):
    text = "# 张三\n## 教育背景\n- **本科** 某大学\n---\n## 专业技能\nPython\nx\n## 项目经验\n" + "\n".join(f"项目 {i}" for i in range(20)) + "\n## 教育经历\n硕士"
    got = imports.written_resumes(spark.createDataFrame([(text, ("后端",)), ("  ", None)], "content string, metadata struct<position:string>"), "w").collect()
    assert len(got) == 1 and got[0].label["目标岗位"] == "后端" and got[0].label["教育背景"] == ["本科 某大学", "硕士"] and got[0].label["核心技能"] == ["Python"] and len(got[0].label["项目经历"]) == 12
