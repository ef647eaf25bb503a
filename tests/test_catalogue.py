"""The library's queries against their SQL, and fixture cases of its operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from curatrix.functions import text as T
from curatrix.operators import dedup, matching, selection
from curatrix.plans import catalogue
from curatrix.sources import store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, con, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, " a　 b \n\n \t\nc ", T.normalize_space) == "a b\nc"
    assert one(spark, "13800138000 x@y.cn VX: abc_123", T.mask_private) == "[手机号] [邮箱] VX：[已脱敏]"
    assert one(spark, "A b\na B\n\nc\nab", T.dedup_lines) == "A b\nc"
    assert one(spark, "岗位\n立即投递\n展开\nx", T.remove_boilerplate) == "岗位\nx"
    assert one(spark, None, T.clean) == ""
    assert one(spark, "负责数据开发与平台建设", T.language) == "zh"


def test_greedy_dedup_keeps_bucket_borders(spark):
    text = "负责推荐系统与数据平台的研发工作" * 3
    rows = [(1, "a", text), (2, "a", text + "啊"), (3, "b", text), (4, "a", "完全不同的内容在这里出现")]
    got = dedup.greedy(spark.createDataFrame(rows, "id long, bucket string, t string"), "bucket", "id", "t")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4]


def test_jaccard_pairs_match_brute_force(spark):
    base = "abcdefghijklmnopqrstuvwxyz0123456789" * 4
    texts = [base, base + "q", base[:80] + "zzzz" + base[84:], "short", "", "0" * 40]
    got = dedup.jaccard_pairs(
        spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "doc_id long, bucket string, t string"), "doc_id", "bucket", "t", 0.8
    )
    want = set()
    for i, x in enumerate(texts):
        for j in range(i):
            a, b = dedup.shingles(x, 5), dedup.shingles(texts[j], 5)
            if a and b and len(a & b) / len(a | b) >= 0.8:
                want.add((j, i))
    assert {(r.left_id, r.right_id) for r in got.collect()} == want


def test_jaccard_pairs_write_no_sets_and_lose_none(spark, monkeypatch):
    import random

    rng, made = random.Random(5), []
    copied = dedup.shared_copy

    def noted(df, name):
        out = copied(df, name)
        made.append(out.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0)
        return out

    monkeypatch.setattr(dedup, "shared_copy", noted)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(2000)) for _ in range(100)]
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "id long, bucket string, t string")
    assert dedup.jaccard_pairs(df, "id", "bucket", "t").count() == 0 and sum(made) < 400_000
    for n in (1, 4, 5, 6, 7, 12, 40, 160, 700):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 1 + n // 90)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = rng.choices("abcxyz", k=rng.randint(0, 2)) or ["q"]
            texts.append("".join(own) + "z" * rng.choice((0, 0, n // 50)))
    texts += ["aaaaa", "aaaaaa", "aaaaaaa", "bbbb", "bbbbb"]
    rows = [(i, rng.choice("xy"), t) for i, t in enumerate(texts[100:])] + [(9999, None, texts[-1])]
    least, want = {}, {}
    for i, b, t in rows[:-1]:
        least.setdefault((b, t), i)
    own = {k: dedup.shingles(k[1], 5) for k in least}
    for threshold in (0.9, 0.6, 1.0):
        want = {(i, j): len(own[k] & own[m]) / len(own[k] | own[m]) for k, i in least.items() for m, j in least.items() if k[0] == m[0] and i < j}
        want = {k: v for k, v in want.items() if v >= threshold}
        got = dedup.jaccard_pairs(spark.createDataFrame(rows, "id long, bucket string, t string"), "id", "bucket", "t", threshold).collect()
        assert {(r.left_id, r.right_id): r.jaccard for r in got} == want and len(got) == len(want) > 0


def test_policy_rounds_half_to_even(spark):
    p = matching.Policy()
    row = spark.range(1).select(p.score(F.lit(True), F.lit(2), F.lit(1), F.lit(True), F.lit(False), F.lit(3)).alias("s")).first()
    assert row.s == 20 + 22 + 10 + 0 + 10
    with pytest.raises(ValueError):
        matching.Policy(skills=50)


def test_required_years_and_degrees(spark):
    assert one(spark, "3-7年经验", matching.required_years) == 3
    assert one(spark, "5年以上", matching.required_years) == 5
    assert one(spark, "硕士优先", matching.required_degree) == 0
    assert one(spark, "本科及以上", matching.required_degree) == 3


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a long, b long")
    got = {r.node: r.root for r in selection.components(edges, lambda df: store.shared_copy(df, "t")).collect()}
    assert set(got[i] for i in range(10)) == {0} and got[21] == 20


def test_sources_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    store.write_jsonl(df, str(tmp_path / "x.jsonl"))
    assert store.read_rows(spark, str(tmp_path / "x.jsonl"), "id long, t string").count() == 2
    with pytest.raises(ValueError):
        store.read_rows(spark, "x.xml")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "id long, t string")
    assert sorted(map(tuple, store.upsert(df, new, "id", []).collect())) == [(1, "a"), (2, "b"), (3, "c")]
