"""Skills, evidence, directions, pair scores and checks of explanations."""

import pytest
from pyspark.sql import functions as F

from curatrix.operators import pairing

VOCABULARY = {
    "Python": ["Py thon"], "FastAPI": [], "RAG": ["检索增强问答"], "MySQL": ["My SOL"], "Redis": [], "Java": [], "C": ["C语言"], "C++": ["C + +"],
    "Docker": [], "Kubernetes": ["Kubernet es"], "PyTorch": []
}
SCHEMA = """id int, advert struct<direction:string, skills:array<string>, education:string, experience:string, requirements:array<string>, responsibilities:array<string>, text:string>,
resume struct<target:string, education:array<string>, skills:array<string>, projects:array<string>, internships:array<string>, text:string>"""


def every(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_known_skills(spark):
    cases = {
        "熟悉Python、FastAPI": ["Python", "FastAPI"], "Pytho-n 和 Fast API": ["Python", "FastAPI"], "JavaScript": [], "C++ 与 C#": ["C++"], "C 语言": [], "C语言": ["C"], "会 C": ["C"],
        "ＭｙＳＱＬ": ["MySQL"], "python-like": [], "Kubernet es": ["Kubernetes"], "": [], None: [],
    }
    assert every(spark, list(cases), lambda c: pairing.known_skills(c, VOCABULARY)) == list(cases.values())


def test_canonical_skills(spark):
    df = spark.createDataFrame([(["python", " Py-Thon ", "Rust", "rust", None, ""],), (None,)], "x array<string>").coalesce(1)
    assert [r[0] for r in df.select(pairing.canonical_skills(F.col("x"), VOCABULARY)).collect()] == [["Python"], []]
    assert [r[0] for r in df.select(pairing.canonical_skills(F.col("x"), VOCABULARY, True)).collect()] == [["Python", "Rust"], []]


def test_segments_carry_headings(spark):
    text = "负责平台\n熟悉 Redis\nRedis 优先\n杂项\n任职要求：会 Java 岗位职责：写 Python\n- 用 Docker\n加分项\nRAG"
    (got, empty) = every(spark, [text, None], pairing.segments)
    assert [tuple(s) for s in got] == [
        ("responsibility", "负责平台"), ("requirement", "熟悉 Redis"), ("bonus", "Redis 优先"), ("other", "杂项"), ("requirement", "会 Java"), ("responsibility", "写 Python"), ("responsibility", "用 Docker"), ("bonus", "RAG"),
    ]
    assert empty == []


def test_skill_evidence(spark):
    none = F.array().cast("array<string>")
    f = lambda c: pairing.skill_evidence(VOCABULARY, F.array(F.lit("熟悉 Python")), none, none, c, F.array(F.lit("MySQL"), F.lit("Docker")))
    (got,) = every(spark, ["岗位职责：用 Docker 和 Python\n用 Docker 和 Python"], f)
    assert [(e["skill"], e["required"], e["requirement"], e["responsibility"]) for e in got] == [
        ("Python", True, ["熟悉 Python"], ["用 Docker 和 Python"]), ("Docker", False, [], ["用 Docker 和 Python"]), ("MySQL", False, [], []),
    ]


STRONG = (
    ("AI应用开发", ["Python", "FastAPI", "RAG"], "本科及以上", "3年以上开发经验", None, None, None),
    (
        "AI应用开发工程师", ["本科，计算机科学与技术"], ["Python", "FastAPI", "RAG", "MySQL"], ["负责企业知识库问答系统开发，完成 RAG 链路、FastAPI 接口和 Python 服务开发"], ["3年后端与 AI 应用开发经验"],
        "本科，3年开发经验，技能包括 Python / FastAPI / RAG"
    ),
)
GAP = (
    ("后端开发", ["Java", "MySQL", "Redis"], "本科及以上", "5年以上开发经验", None, None, None),
    ("测试开发工程师", ["大专，软件技术"], ["Python"], ["负责自动化测试脚本开发"], ["2年测试经验"], "大专，2年测试经验，掌握 Python"),
)
EVIDENCED = (
    ("后端开发", ["Java"], "硕士优先", "", ["熟悉 Redis"], ["用 Java 写服务"], "任职要求：熟悉 Redis\n岗位职责：用 Java 写服务"),
    ("后端开发", None, ["Redis"], None, None, None),
)


def test_pair_scores(spark):
    rows = [(i, *p) for i, p in enumerate((STRONG, GAP, EVIDENCED, (None, None)))]
    got = [r.match for r in pairing.score_pairs(spark.createDataFrame(rows, SCHEMA), VOCABULARY).orderBy("id").collect()]
    strong, gap, evidenced, empty = got
    assert (strong.relation, strong.education, strong.experience, strong.matched, strong.missing) == ("exact", True, True, ["Python", "FastAPI", "RAG"], [])
    assert strong.score == 20 + 45 + 10 + 15 + 5 and strong.level == "高匹配"
    assert (gap.relation, gap.education, gap.experience, gap.matched, gap.score, gap.level) == ("mismatch", False, False, [], 0, "低匹配")
    assert (evidenced.matched, evidenced.missing, evidenced.education, evidenced.score) == (["Redis"], [], True, 90)
    assert (empty.score, empty.relation_evidence) == (45, "missing_direction")


@pytest.mark.parametrize(
    ("left", "right", "around", "shared", "want"),
    [
        ("算法平台开发", "AI 后端", "模型部署 docker", ["PyTorch", "Docker"], "ai_platform_responsibility_and_skill_overlap"),
        ("算法平台开发", "AI 后端", "模型部署 docker", ["PyTorch"], "insufficient_cross_role_evidence"),
        ("算法", "大模型应用", "RAG 落地", ["RAG", "Python"], "ai_application_responsibility_and_skill_overlap"),
        ("数据开发", "服务端", "Flink 数仓", ["Java", "Redis"], "data_platform_responsibility_and_skill_overlap"),
        ("前端", "前端开发", "", [], "same_direction_leaf"),
        ("算法工程师", "算法平台", "推理服务", [], "same_direction_leaf"),
    ],
)
def test_directions(spark, left, right, around, shared, want):
    df = spark.createDataFrame([(left, right, around, shared)], "l string, r string, c string, s array<string>")
    c = F.col("c")
    assert df.select(
        pairing.direction_relation(pairing.direction_leaf(F.col("l"), c), pairing.direction_leaf(F.col("r"), c), c, c, F.col("s"))
    ).first()[0] == want


def test_explanations(spark):
    df = spark.createDataFrame(
        [(False, True, ["Java"], ["Redis"], "高匹配", "方向一致，熟悉 Redis 和 Docker", "学历条件有差距，缺失 Java，暂无明显硬性短板", "匹配度有限")],
        "no boolean, yes boolean, has array<string>, lacks array<string>, level string, s string, g string, c string"
    )
    codes = pairing.contradictions(F.col("no"), F.col("yes"), F.col("yes"), F.col("lacks"), F.col("level"), F.col("s"), F.col("g"), F.col("c"))
    assert df.select(codes).first()[0] == [
        "岗位方向匹配:false_but_strength_positive", "学历匹配:true_but_gap_negative", "missing_skills_but_no_hard_gap", "high_level_but_negative_conclusion"
    ]
    claims = pairing.ungrounded(VOCABULARY, F.col("has"), F.col("lacks"), F.col("yes"), F.col("yes"), F.col("s"), F.col("g"), F.lit(None).cast("string"))
    assert df.select(claims).first()[0] == [
        "匹配优势:claims_missing_skill_as_strength:Redis", "匹配优势:unsupported_skill:Docker", "主要短板:claims_matched_skill_as_missing:Java"
    ]
