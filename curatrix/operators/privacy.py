"""Personal data of résumés: found, masked, and dropped for training, as column expressions. Null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatrix.functions.text import lines, strip, text_or_empty

#: What is looked for, the group that is the value, and the mask.
PATTERNS = (
    ("phone", r"(?U)(?<!\d)1[3-9]\d(?:[-\s]?\d){8}(?!\d)", 0, "[手机号]"),
    ("email", r"(?U)[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0, "[邮箱]"),
    ("wechat", r"(?iU)\b(?:微信|wechat|vx)[:：]?\s*([A-Za-z][A-Za-z0-9_-]{5,})", 1, "[微信]"),
    ("qq", r"(?U)(?:QQ|qq)[:：]?\s*([1-9][0-9]{4,11})", 1, "[QQ]"),
    ("id_number", r"(?U)(?<!\d)(?:\d{17}[0-9Xx]|\d{15})(?!\d)", 0, "[证件号码]"),
    ("age", r"(?U)(?<!\d)([1-5]?\d)\s*岁", 1, "[年龄]"),
)
NAME_LINE = r"(?U)^(?:姓名[:：]?\s*)?([\x{4e00}-\x{9fff}]{2,4})$"
BESIDE_NAMES = r"电话|手机|邮箱|年龄|政治面貌|\[手机号\]|\[邮箱\]|\[年龄\]"
NOT_NAMES = "教育|实习|项目|技能"
BULLETS = r"(?U)^[\s#>*+\-]+"
FIELDS = {
    "姓名": "name", "年龄": "age", "性别": "gender", "婚姻状况": "marital_status", "户口地": "hukou", "籍贯": "hukou",
    "身体状况": "health_status", "残障情况": "health_status", "政治面貌": "political_status", "出生日期": "birth_date", "民族": "ethnicity",
    "地址": "address", "住址": "address", "居住地址": "address", "现居住地": "address", "通讯地址": "address",
    "身份证": "id_number", "身份证号": "id_number", "证件号码": "id_number", "个人账号": "personal_account", "社交账号": "personal_account",
}
CONTACTS = ("电话", "手机", "联系电话", "邮箱", "联系邮箱", "微信", "QQ")
MASKS_ALONE = ("[姓名]", "[手机号]", "[邮箱]")
NAMES_IN_FILES = ((r"(?<=[-_])[\x{4e00}-\x{9fff}]{2,4}(?=\.)", "[姓名]"), (r"(^|/)(?!个人)[\x{4e00}-\x{9fff}]{2,4}(?=简历)", "$1[姓名]"))
FOUND = "array<struct<kind:string,value:string>>"


def _by_line(text: Column, f) -> Column:
    """``f(line, its neighbours' text)`` for each line."""
    # The lines are bound to a variable, else each line would split the text again.
    bound = F.array(lines(text))
    return F.flatten(
        F.transform(bound, lambda every: F.transform(every, lambda x, i: f(x, F.concat_ws("\n", F.when(i > 0, F.get(every, i - 1)), F.get(every, i + 1)))))
    )


def _name(line: Column, beside: Column) -> Column:
    """The name that is all of a line, or empty: after the word for it, or next to other personal data."""
    s = strip(line)
    return F.when((s.startswith("姓名") | beside.rlike(BESIDE_NAMES)) & ~s.rlike(NOT_NAMES), F.regexp_extract(s, NAME_LINE, 1)).otherwise("")


def _plain(line: Column) -> Column:
    return F.replace(F.regexp_replace(strip(line), BULLETS, ""), F.lit("**"), F.lit(""))


def findings(text: Column) -> Column:
    """All personal data as (kind, value): by pattern in order, then names and profile fields by line, the latter only if new."""
    text = text_or_empty(text)

    def all_of(kind: str, pattern: str, group: int) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
            lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(False).alias("once"))
        )

    kinds = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))

    def of_line(x: Column, beside: Column) -> Column:
        name = _name(x, beside)
        field = r"(?U)^([^：:]+)\s*[：:]\s*(.+)$"
        kind = F.try_element_at(kinds, strip(F.regexp_extract(_plain(x), field, 1)))
        aged = (kind == "age") & strip(x).rlike(PATTERNS[5][1])
        value = strip(F.regexp_extract(_plain(x), field, 2))
        usable = kind.isNotNull() & ~aged & ~strip(x).rlike(NOT_NAMES)
        return F.array_compact(
            F.array(
                F.when(name != "", F.struct(F.lit("name").alias("kind"), name.alias("value"), F.lit(False).alias("once"))),
                F.when(usable, F.struct(kind.alias("kind"), value.alias("value"), F.lit(True).alias("once"))),
            )
        )

    every = F.flatten(F.array(*(all_of(k, p, g) for k, p, g, _ in PATTERNS), F.flatten(_by_line(text, of_line))))
    ranked = F.array_sort(F.transform(every, lambda e, i: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), i.alias("i"), e["once"].alias("once"))))
    new = F.flatten(
        F.transform(
            F.array(ranked),
            lambda s: F.filter(s, lambda e, j: ~e["once"] | (j == 0) | (F.get(s, j - 1)["kind"] != e["kind"]) | (F.get(s, j - 1)["value"] != e["value"]))
        )
    )
    in_order = F.array_sort(F.transform(new, lambda e: F.struct(e["i"].alias("i"), e["kind"].alias("kind"), e["value"].alias("value"))))
    return F.transform(in_order, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"))).cast(FOUND)


def redacted(text: Column) -> Column:
    """With masks for what the patterns find, then for names by the lines next to them."""
    out = text_or_empty(text)
    for kind, pattern, _, mask in PATTERNS:
        if kind in ("wechat", "qq"):  # the words before the value stay
            pattern, mask = pattern.replace(r"\s*(", r"\s*)(", 1).replace("(?:", "((?:", 1), f"$1{mask}"
        out = F.regexp_replace(out, pattern, mask)

    def of_line(x: Column, beside: Column) -> Column:
        name = _name(x, beside)
        return F.when(name != "", F.replace(x, name, F.lit("[姓名]"))).otherwise(x)

    # A line feed at the very end goes, as it begins no line.
    return F.regexp_replace(F.array_join(_by_line(out, of_line), "\n"), "\n\\z", "")


def for_training(text: Column) -> Column:
    """Redacted, without lines that are a mask alone or a private field."""
    fields = "|".join(f"\\Q{f}\\E" for f in (*FIELDS, *CONTACTS))
    keep = lambda x: ~_plain(x).isin(*MASKS_ALONE) & ~_plain(x).rlike(f"(?U)^(?:{fields})\\s*[：:]")
    return F.array_join(F.filter(lines(redacted(text)), keep), "\n")


def file_redacted(name: Column) -> Column:
    """A file name or path with names of persons masked."""
    for pattern, mask in NAMES_IN_FILES:
        name = F.regexp_replace(name, pattern, mask)
    return name


def summary(found: Column) -> Column:
    """A struct of ``has_pii``, ``total`` and ``counts`` by kind."""
    kinds = sorted({k for k, *_ in PATTERNS} | set(FIELDS.values()) | {"name"})

    def n(kind: str) -> Column:
        return F.size(F.filter(found, lambda e: e["kind"] == kind))

    counts = F.map_filter(F.create_map(*(c for k in kinds for c in (F.lit(k), n(k)))), lambda k, c: c > 0)
    return F.struct((F.size(found) > 0).alias("has_pii"), F.size(found).alias("total"), counts.alias("counts"))


#: The texts and file names of a résumé's row.
TEXTS, FILE_NAMES = ("raw_text", "clean_text", "normalized_text", "text"), ("file_name", "file_path")


def rows_for_training(rows: DataFrame) -> DataFrame:
    """``rows`` with private findings taken out of all their texts, sections and file names, and ``privacy``, what was found."""
    own = [c for c in TEXTS if c in rows.columns]
    found = findings(F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in own)))
    out = rows.withColumn("privacy", summary(found)).withColumns({c: for_training(F.col(c)) for c in own})
    out = out.withColumns({c: file_redacted(F.col(c)) for c in FILE_NAMES if c in rows.columns})
    if "sections" not in rows.columns:
        return out
    kind = rows.schema["sections"].dataType
    if isinstance(kind, StructType):
        return out.withColumn("sections", F.struct(*(for_training(F.col(f"sections.{n}")).alias(n) for n in kind.names)))
    return out.withColumn("sections", F.transform_values("sections", lambda _, v: for_training(v)))
