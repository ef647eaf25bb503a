"""Résumé files as rows: kinds by suffix, texts of plain, Word and PDF files, sidecar texts of images and scans, upload checks.

Files come through Spark's binary reader, so from any store it reads. Word files are zip archives of markup and PDF files
have compressed streams; both are opened in batches in Python. PDF texts are read from literal strings of text operators,
which covers simple fonts; files whose text can't be read that way count as scans and need a sidecar.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import strip, text_or_empty
from curatrix.operators.resumes import normalized_text
from curatrix.operators.sections import RESUME, line_sections

#: Kinds by suffix, and the least text of a PDF file in all and by page.
KINDS = {"text": ("txt", "md"), "docx": ("docx",), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "webp", "bmp")}
LEAST_CHARS, LEAST_PAGE_CHARS = 80, 40
SIDECAR = ".ocr.txt"
#: Bytes of an unpacked member or stream at most; larger ones are refused, as archives may unpack without end.
MOST_BYTES = 64 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def kind_of(name: Column) -> Column:
    """text, docx, pdf, image or unknown."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    out = F.lit("unknown")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word file, empty ones dropped."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if archive.getinfo("word/document.xml").file_size > MOST_BYTES:
            raise ValueError("the document is too large")
        root = ET.fromstring(archive.read("word/document.xml"))  # noqa: S314
    body = root.find(f"{_W}body")
    paragraphs = (
        "".join(
            (t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in p.iter()
        ) for p in (body if body is not None else root).findall(f"{_W}p")
    )
    return "\n".join(x.strip() for x in paragraphs if x.strip())


_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
_SHOW = re.compile(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|(T\*|Td|TD|ET)\b", re.S)
_LITERAL = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    plain = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _NAMED.get(m[1], m[1]), raw)
    return plain.decode("utf-16-be", "replace") if plain[:2] == b"\xfe\xff" else plain.decode("cp1252", "replace")


def pdf_text(data: bytes) -> tuple[str, int]:
    """(text, pages) of a PDF file."""
    parts = []
    for m in _STREAM.finditer(data):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body, MOST_BYTES)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        lines: list[str] = [""]
        for s in _SHOW.finditer(body):
            if s[3]:
                lines.append("")
            else:
                lines[-1] += "".join(map(_literal, _LITERAL.findall(s[1]))) if s[1] is not None else _literal(s[2])
        text = "\n".join(x.strip() for x in lines if x.strip())
        if text:
            parts.append(text)
    return "\n\n".join(parts), max(1, len(_PAGE.findall(data)))


def _opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
            text, pages, error = "", 1, None
            try:
                if kind == "docx":
                    text = docx_text(content)
                elif kind == "pdf":
                    text, pages = pdf_text(content)
            except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as e:
                error = f"{kind}_unreadable: {type(e).__name__}"
            rows.append((path, text, pages, error))
        yield pd.DataFrame(rows, columns=["path", "opened", "page_count", "open_error"])


def read_resumes(spark: SparkSession, path: str, sidecars: str | None = None) -> DataFrame:
    """One row a file below ``path``: id, file_name, file_path, source_type, pdf_kind, ocr_used, ocr_source,
    extraction_method, needs_ocr, parse_ok, parse_error, page_count, text_char_count, raw_text, clean_text, sections.

    Images and PDF files without enough text take the text of a sidecar, a file named like them with ``.ocr.txt`` after the
    whole name or after its stem, in the folder ``sidecars`` or else beside them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    every = files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "content")
    # A text that is a sidecar is no résumé.
    own = every.filter(~F.lower("file_name").endswith(SIDECAR)).withColumn("kind", kind_of(F.col("file_name")))
    packed = own.filter(F.col("kind").isin("docx", "pdf")).select("path", "kind", "content").mapInPandas(
        _opened, "path string, opened string, page_count int, open_error string"
    )
    rows = own.select("path", "file_name", "kind", F.when(F.col("kind") == "text", F.decode("content", "UTF-8")).alias("plain")).join(packed, "path", "left")
    folder = lambda c: F.regexp_replace(c, "[^/]+$", "")
    beside = every.filter(F.lower("file_name").endswith(SIDECAR)).select("path", F.decode("content", "UTF-8").alias("said"), F.lit(1).alias("far"))
    if sidecars:
        there = spark.read.format("binaryFile").load(sidecars).select("path", F.decode("content", "UTF-8").alias("said"), F.lit(0).alias("far"))
        beside = beside.unionByName(there.filter(F.lower("path").endswith(SIDECAR)))
    named = beside.select(
        folder("path").alias("folder"), F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"(?i)\.ocr\.txt$", "").alias("stem"), "said", "far"
    )
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    cand = rows.filter(F.col("kind").isin("pdf", "image")).select(
        "path",
        F.explode(
            F.array(F.struct(F.col("file_name").alias("stem"), F.lit(0).alias("order")), F.struct(stem.alias("stem"), F.lit(1).alias("order")))
        ).alias("c")
    ).select("path", "c.*")
    hits = cand.join(named, "stem").filter((F.col("far") == 0) | (folder("path") == F.col("folder")))
    best = hits.groupBy("path").agg(F.min_by("said", F.struct("far", "order")).alias("sidecar"))
    rows = rows.join(best, "path", "left").withColumn("sidecar", strip(text_or_empty(F.col("sidecar"))))
    chars = F.length(text_or_empty(F.col("opened")))
    pdf_kind = F.when(F.col("kind") != "pdf", "").when(chars == 0, "scanned_pdf").when(
        (chars < LEAST_CHARS) | (chars / F.col("page_count") < LEAST_PAGE_CHARS), "weak_text_pdf"
    ).otherwise("text_pdf")
    rows = rows.withColumn("pdf_kind", pdf_kind)
    wants = (F.col("kind") == "image") | F.col("pdf_kind").isin("scanned_pdf", "weak_text_pdf")
    used = wants & (F.col("sidecar") != "")
    raw = F.when(used, F.col("sidecar")).when(wants, "").otherwise(text_or_empty(F.coalesce("plain", "opened")))
    out = rows.withColumns({"raw_text": raw, "ocr_used": used, "needs_ocr": wants & ~used}).withColumn("clean_text", normalized_text(F.col("raw_text")))
    error = (
        F.when(F.col("kind") == "unknown", "unsupported_file_type").when(F.col("needs_ocr") & (F.col("kind") == "image"), "image_resume_requires_ocr").when(
            F.col("needs_ocr") & (F.col("pdf_kind") == "scanned_pdf"), "scanned_pdf_requires_ocr"
        )
        .when(F.col("needs_ocr"), "weak_text_pdf_requires_ocr_review").when(F.col("open_error").isNotNull(), F.col("open_error")).when(
            F.col("clean_text") == "", "empty_text_after_extraction"
        )
    )
    method = F.when(F.col("ocr_used"), "sidecar_ocr").otherwise(F.col("kind"))
    return out.select(
        F.substring(F.sha1("path"), 1, 16).alias("id"), "file_name", F.col("path").alias("file_path"), F.col("kind").alias("source_type"), "pdf_kind", "ocr_used", F.when(F.col("ocr_used"), "sidecar").otherwise("").alias("ocr_source"),
        method.alias("extraction_method"), "needs_ocr", (
            (F.col("clean_text") != "") & (F.col("kind") != "unknown")
        ).alias("parse_ok"), error.alias("parse_error"), F.coalesce("page_count", F.lit(1)).alias("page_count"),
        F.when(F.col("kind") == "pdf", chars).otherwise(F.length("clean_text")).alias("text_char_count"), "raw_text", "clean_text", line_sections(F.col("clean_text"), RESUME).alias("sections"),
    )


#: How files of a kind begin, and bytes that a file may have.
BEGINS = {"pdf": b"%PDF-", "docx": b"PK\x03\x04", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff", "bmp": b"BM"}
MOST_UPLOAD = 10 << 20


def upload_error(name: Column, content: Column, most: int = MOST_UPLOAD) -> Column:
    """Why an uploaded file is refused; null where it is taken."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    begins = lambda b: F.hex(F.substring(content, 1, len(b))) == b.hex().upper()
    wrong = F.lit(False)
    for s, b in BEGINS.items():
        wrong = F.when(suffix == s, ~begins(b)).otherwise(wrong)
    webp = (suffix == "webp") & ~(begins(b"RIFF") & (F.hex(F.substring(content, 9, 4)) == b"WEBP".hex().upper()))
    text = suffix.isin(*KINDS["text"]) & F.coalesce(F.is_valid_utf8(content) == F.lit(False), F.lit(True))
    n = F.octet_length(content)
    return F.when(
        kind_of(name) == "unknown", "unsupported_file_type"
    ).when(F.coalesce(n, F.lit(0)) == 0, "empty_file").when(n > most, "file_too_large").when(wrong | webp, "content_does_not_match_type").when(text, "text_is_not_utf8")
