"""Change logs and windows of streams, and JSON repair."""

from conftest import SMALL
from pyspark.sql import functions as F

SCHEMA = "k long, at long, v string"


def test_change_log(spark, tmp_path):
    from curatrix.streaming.changes import compact, current, follow, log_changes

    source, folder, ckpt = (str(tmp_path / n) for n in ("in", "log", "ckpt"))
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c"), (None, 1, "n")], SCHEMA).coalesce(1).write.parquet(source)
    log_changes(follow(spark, source, SCHEMA, 1), folder, ckpt, "k", ["at"]).awaitTermination()
    spark.createDataFrame([(1, 2, "later"), (2, 4, "late"), (3, 1, None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    log_changes(follow(spark, source, SCHEMA, 1), folder, ckpt, "k", ["at"]).awaitTermination()
    want = {(1, 2, "later"), (2, 5, "c"), (3, 1, None), (None, 1, "n")}
    assert {tuple(r) for r in current(spark, folder, SCHEMA, "k", ["at"]).collect()} == want
    compact(spark, folder, str(tmp_path / "new"), SCHEMA, "k", ["at"])
    assert {tuple(r) for r in current(spark, str(tmp_path / "new"), SCHEMA, "k", ["at"]).collect()} == want
    # With nothing new, another run changes nothing.
    log_changes(follow(spark, source, SCHEMA, 1), folder, ckpt, "k", ["at"]).awaitTermination()
    assert current(spark, folder, SCHEMA, "k", ["at"]).count() == 4


def test_windows_equal_a_table_up_to_the_watermark(spark, tmp_path):
    from curatrix.streaming.changes import follow, windowed, write_windows

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    how = {"width": "1 hour", "lateness": "1 hour", "values": {"worth": F.sum("value")}}
    stream = follow(spark, f"{SMALL}/events.parquet", events.schema)
    write_windows(windowed(stream, "ts", ["event_type"], **how), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    limit = events.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    want = {(r.start, r.event_type, r.n) for r in windowed(events, "ts", ["event_type"], **how).collect() if r.stop <= limit}
    assert want and {(r.start, r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_json_repair(spark):
    from curatrix.functions.json_text import parsed, unique_items, without_thinking

    rows = [
        ('<think>abc</think>{"a":1}', '{"a":1}', True),
        ('说明 {“技能”:["Python",],} 结束', '{"技能":["Python"]}', False),
        ('{"简历优化建议":["补充学历说明"],"较低。"}', '{"简历优化建议":["补充学历说明"], "匹配结论": "较低。"}', False),
        ('{"建议":["甲","乙"]}', '{"建议":["甲","乙"]}', True),
        ("no object", None, False),
        ("", None, False),
        (None, None, False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", parsed(F.col("t")).alias("p")).collect()}
    for i, (_, want, strict) in enumerate(rows):
        assert got[i].json == want and got[i].ok == (want is not None) and got[i].strict == strict, i
    assert df.select(without_thinking(F.lit(" <think>a\nb</think> c "))).first()[0] == "c"
    lists = spark.createDataFrame([(["b", " a", "a", "", None, "b"],), (None,)], "x array<string>")
    assert [r[0] for r in lists.select(unique_items(F.col("x"))).collect()] == [["b", " a"], []]
