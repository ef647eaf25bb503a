"""Sections, personal data of résumés, years and tagged spans."""

from pyspark.sql import functions as F

from curatrix.operators import matching, privacy, sections


def every(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_advert_sections(spark):
    texts = [
        "前言\n岗位职责：写代码 任职要求: 本科\n熟悉 SQL",
        "职位描述\na\n\n b\n说明 【加分项】会唱歌\n<b>任职要求</b>\nc",
        "一、岗位职责 做事\n经验者优先\n任职资格要求：硕士",
        "没有标题",
        "",
        None,
        "<p>工作内容：</p>\n做事\n任职要求\n",
    ]
    got = [tuple(r) for r in every(spark, texts, sections.inline_sections)]
    assert got == [
        ("写代码", "本科\n熟悉 SQL", ""),
        ("a\n\n b\n说明", "c", "会唱歌"),
        ("做事\n经验者优先", "硕士", ""),
        ("", "", ""),
        ("", "", ""),
        ("", "", ""),
        ("</p>\n做事", "", ""),
    ]


def test_advert_sections_unswapped(spark):
    text = "岗位职责：本科学历，熟悉数据，具备经验\n任职要求：负责开发，参与设计，维护系统"
    f = lambda ok: lambda c: sections.unswapped(sections.inline_sections(c), F.lit(ok))
    (straight,), (swapped,) = every(spark, [text], f(False)), every(spark, [text], f(True))
    assert (straight[0], straight[1]) == (swapped[1], swapped[0]) and swapped[0].startswith("负责")


def test_resume_sections(spark):
    got = every(spark, ["张三\n\n教育背景：\n 某大学 \n项目经历\nA\n教育经历\nB", None, "教育背景 很好"], sections.line_sections)
    assert [(r["header"], r["education"], r["projects"]) for r in got] == [("张三", "某大学\nB", "A"), ("", "", ""), ("教育背景 很好", "", "")]


def test_sections_of_a_long_text(spark):
    text = "岗位职责：\n" + "做事\n" * 50_000 + "任职要求：本科"
    ((duties, demands, _),) = every(spark, [text], sections.inline_sections)
    assert duties.count("做事") == 50_000 and demands == "本科"


def test_tagged_spans(spark):
    rows = [
        (["a", "bc", "d", "e"], ["B", "I", "O", "B"], [0, 2, 5, 7]), (["a"], ["I"], [0]), (["a", "b"], ["B"], [0, 2]), ([], [], []),
        (["a", "b"], ["B", "B"], [0, 2])
    ]
    df = spark.createDataFrame(rows, "tokens array<string>, tags array<string>, starts array<int>").coalesce(1)
    got = [r[0] for r in df.select(sections.tagged_spans(F.col("tokens"), F.col("tags"), F.col("starts"), "skill")).collect()]
    plain = [s and [tuple(x) for x in s] for s in got]
    assert plain == [[(0, 4, "skill", "a bc"), (7, 8, "skill", "e")], None, None, [], [(0, 1, "skill", "a"), (2, 3, "skill", "b")]]


RESUME = "张三\n电话：13812345678\n邮箱: a.b@c.com\n微信：abc_def1 QQ: 1234567\n年龄：25岁\n- **籍贯**：北京\n籍贯：北京\n李四\n项目经历\n王五"


def test_findings(spark):
    (found,) = every(spark, [RESUME], privacy.findings)
    assert [tuple(f) for f in found] == [
        ("phone", "13812345678"), ("email", "a.b@c.com"), ("wechat", "abc_def1"), ("qq", "1234567"), ("age", "25"), ("name", "张三"), ("hukou", "北京"),
    ]
    (s,) = every(spark, [RESUME], lambda c: privacy.summary(privacy.findings(c)))
    assert s["has_pii"] and s["total"] == 7 and s["counts"] == {"phone": 1, "email": 1, "wechat": 1, "qq": 1, "age": 1, "name": 1, "hukou": 1}
    assert every(spark, [None, ""], privacy.findings) == [[], []]


def test_redaction(spark):
    (out,) = every(spark, [RESUME], privacy.redacted)
    assert out.split("\n") == ["[姓名]", "电话：[手机号]", "邮箱: [邮箱]", "微信：[微信] QQ: [QQ]", "年龄：[年龄]", "- **籍贯**：北京", "籍贯：北京", "李四", "项目经历", "王五"]
    (kept,) = every(spark, [RESUME], privacy.for_training)
    assert kept == "李四\n项目经历\n王五"
    assert every(spark, ["dir/张三简历.pdf", "a-李四.pdf", "个人简历.pdf", None], privacy.file_redacted) == ["dir/[姓名]简历.pdf", "a-[姓名].pdf", "个人简历.pdf", None]


def test_years(spark):
    cases = {
        "3年经验": 3, "2023年毕业": 0, "5年后毕业于某大学": 0, "25年校招": 0, "2年校招经验": 2, "十五年": 15, "二十三年": 23, "两年": 2, "零年": 0, "1年和 7 年": 7, "99999999999年": 0, "": 0, None: 0,
    }
    assert every(spark, list(cases), matching.years) == list(cases.values())
    ranges = {"3-7年": 3, "三至五年": 3, "2020-2023年": 0, "0-3年": 3, "5年以上": 5, None: 0}
    assert every(spark, list(ranges), matching.required_years) == list(ranges.values())
