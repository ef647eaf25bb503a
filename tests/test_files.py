"""Résumé files, keyed tables and manifests."""

import io
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from curatrix.operators.adverts import messages
from curatrix.plans import manifests
from curatrix.sources import files, folders
from curatrix.sources.tables import Tables


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(
            "word/document.xml",
            f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
        )
    return data.getvalue()


def pdf(*lines):
    shown = b"BT " + b" T* ".join(b"(" + x.encode("cp1252") + b") Tj" for x in lines) + b" ET"
    packed = zlib.compress(shown)
    return b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length " + str(len(packed)).encode() + b" /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream endobj"


def test_resume_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("a.txt", "张三\n教育背景：\n某大学".encode())
    put("b.docx", docx("项目经历", " 做事 ", ""))
    put("deep/c.pdf", pdf("A long line of text \\(one\\) " * 4, "and another"))
    put("d.pdf", pdf())
    put("e.pdf", pdf("short"))
    put("e.ocr.txt", "扫描的文本".encode())
    put("f.png", b"x")
    put("g.png", b"x")
    put("g.png.ocr.txt", b"seen")
    put("h.exe", b"x")
    put("i.docx", b"broken")
    rows = {r.file_name: r for r in files.read_resumes(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"a.txt", "b.docx", "c.pdf", "d.pdf", "e.pdf", "f.png", "g.png", "h.exe", "i.docx"}
    assert rows["a.txt"].parse_ok and rows["a.txt"].sections.education == "某大学" and rows["b.docx"].clean_text == "项目经历\n做事"
    assert rows["c.pdf"].pdf_kind == "text_pdf" and rows["c.pdf"].clean_text.startswith("A long line of text (one)") and rows["c.pdf"].parse_ok
    assert rows["d.pdf"].parse_error == "scanned_pdf_requires_ocr" and rows["d.pdf"].needs_ocr and rows["e.pdf"].pdf_kind == "weak_text_pdf" and rows["e.pdf"].clean_text == "扫描的文本" and rows["e.pdf"].ocr_used
    assert rows["f.png"].parse_error == "image_resume_requires_ocr" and rows["g.png"].clean_text == "seen" and rows["h.exe"].parse_error == "unsupported_file_type" and rows["i.docx"].parse_error.startswith("docx_unreadable")


def test_uploads(spark):
    cases = [
        ("a.pdf", b"%PDF-1", None), ("a.pdf", b"PK", "content_does_not_match_type"), ("a.docx", b"PK\x03\x04x", None), ("a.txt", "é".encode(), None),
        ("a.txt", b"\xff\xfe", "text_is_not_utf8"), ("a.exe", b"x", "unsupported_file_type"), ("a.txt", b"", "empty_file"),
        ("a.txt", b"x" * 99, "file_too_large"), ("a.webp", b"RIFF1234WEBP", None)
    ]
    df = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(cases)], "i int, n string, c binary")
    got = [r.e for r in df.select("i", files.upload_error(F.col("n"), F.col("c"), 50).alias("e")).orderBy("i").collect()]
    assert got == [e for *_, e in cases]


def test_tables(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "db"))
    t.create()
    t.create()
    assert t.read("jd_raw").count() == 0
    t.upsert("jd_raw", spark.createDataFrame([("1", "a", {"k": "v"}), ("2", "b", {})], "id string, raw_text string, meta map<string,string>"))
    t.upsert("jd_raw", spark.createDataFrame([("2", "c", {})], "id string, raw_text string, meta map<string,string>"))
    assert {(r.id, r.raw_text, r.meta_json) for r in t.read("jd_raw").collect()} == {("1", "a", '{"k":"v"}'), ("2", "c", "{}")}
    assert [len(b) for b in t.batches("jd_raw", 1)] == [1, 1]
    for bad in (lambda: t.read("x"), lambda: next(t.batches("jd_raw", 0)), lambda: Tables(spark, str(tmp_path / "no")).read("jd_raw")):
        with pytest.raises(ValueError, match="table|positive"):
            bad()


def test_manifests(spark, tmp_path):
    raw = spark.createDataFrame([("t1", "abc", "{}")], "crawl_time string, raw_text string, meta string")
    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    raw.write.json(out)
    assert manifests.verify_manifest(spark, manifest, raw, "x")["reasons"] == ["missing_manifest"]
    manifests.write_manifest(spark, raw, out, manifest, "x")
    assert manifests.verify_manifest(spark, manifest, raw, "x")["fresh"]
    more = raw.unionByName(raw)
    more.write.mode("overwrite").json(out)
    assert manifests.verify_manifest(spark, manifest, more, "y")["reasons"] == ["transform_changed", "raw_rows_changed", "output_changed"]
    code = tmp_path / "step.py"
    code.write_text("1")
    first = manifests.transform_digest([str(code)], {"a": 1})
    code.write_text("2")
    assert manifests.transform_digest([str(code)], {"a": 1}) != first
    for name, when in (("a", 100), ("b", 200), ("c", 150)):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (when, when))
    p = lambda n: str(tmp_path / n)
    found = manifests.freshness(spark, [("one", [p("a")], [p("b")]), ("two", [p("b")], [p("c")]), ("three", [p("c")], [p("b")]), ("four", [p("no")], [p("b")])])
    assert found["stale_steps"] == ["two", "three", "four"] and not found["fresh"]
    ready = spark.createDataFrame([("jd", False, ["count_ready"]), ("match", True, [])], "task string, ready_for_sft boolean, blockers array<string>")
    assert manifests.blockers(found, ready) == ["stale:two", "stale:three", "stale:four", "jd:count_ready"]


def test_multitask_and_run_manifests(spark, tmp_path):
    rows = lambda t, n: spark.createDataFrame(
        [(f"{t}{i}", f"{t}g{i // 2}", f"q{t}{i}", "{}") for i in range(n)], "id string, source_group string, q string, meta string"
    ).select("id", "source_group", messages(F.col("q"), F.lit("a")).alias("messages"), "meta")
    out = manifests.multitask(spark, {"jd": rows("j", 10), "match": rows("m", 4)}, {"jd": 5, "match": 9}, "train")
    got = out.collect()
    assert len(got) == 9 and len({r.source_group for r in got if r.id[0] == "j"}) == 5 and out.select(F.get_json_object("meta", "$.dataset_task")).distinct().count() == 2
    samples = out.withColumns({"source_id": F.lit(None).cast("string"), "task_type": F.lit("x")})
    path = str(tmp_path / "train")
    samples.write.json(path)
    made = manifests.run_manifest(spark, "sft", {"lr": 1}, {"train": (path, samples)}, str(tmp_path / "run"))
    assert made["datasets"]["train"]["rows"] == 9 and made["datasets"]["train"]["task_counts"] == {"jd": 5, "match": 4}
    assert manifests.read_json(spark, str(tmp_path / "run" / "run_manifest"))["stage"] == "sft"


def test_shared_folders(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda *_: None)})()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        folders.shared_folder(Session(), "x")
    folder = folders.shared_folder(spark, "x")
    spark.range(1).write.parquet(folder)
    folders.remove(spark, folder)
    assert not os.path.exists(folder.removeprefix("file:"))


def test_paths_and_manifests_of_sources(spark, tmp_path):
    from curatrix.functions import text as T
    from curatrix.operators.matching import Policy
    from curatrix.operators.pairing import merged
    from curatrix.sources import store

    for n in ("b_predictions.jsonl", "a_predictions.jsonl", "other.jsonl"):
        (tmp_path / n).write_text("{}")
    names = lambda paths: [p.rsplit("/", 1)[-1] for p in paths]
    assert names(store.prediction_paths(spark, [str(tmp_path), str(tmp_path / "other.jsonl"), str(tmp_path / "other.jsonl")])) == ["a_predictions.jsonl", "b_predictions.jsonl", "other.jsonl"]
    assert names(store.prediction_paths(spark, [str(tmp_path / "*_pred*")])) == ["a_predictions.jsonl", "b_predictions.jsonl"]
    (tmp_path / "m.json").write_text('{"sources": [{"name": "x"}]}')
    (tmp_path / "bad.json").write_text('{"sources": {"a": 1}}')
    assert store.manifest_sources(spark, str(tmp_path / "m.json")) == [{"name": "x"}]
    with pytest.raises(ValueError, match="list"):
        store.manifest_sources(spark, str(tmp_path / "bad.json"))
    store.write_text(spark, "报告", str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "报告"
    assert merged({"A": ["a"]}, {"B": [], "A": ["a", "x"]}) == {"A": ["a", "x"], "B": []}
    with pytest.raises(ValueError, match="strictly"):
        Policy(bands=((85, "x"), (85, "y")))
    page = "<nav>m</nav><article>" + "<p>正文 &amp; 内容</p>" * 20 + "</article><footer>f</footer>"
    got = spark.createDataFrame([(page,), ("<p>短</p>",), (None,)], "h string").select(T.main_text(F.col("h")).alias("x")).collect()
    assert [r.x for r in got] == ["正文 & 内容", "短", ""] or got[0].x.startswith("正文 & 内容")
