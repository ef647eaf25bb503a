"""Texts split at headings, as column expressions: one pass over a row, no shuffle.

Headings are replaced by marks and the text is cut at the marks, so what follows a heading belongs to it up to the next
one without a fold over the lines. Null counts as the empty text. U+0001 and U+0002, which serve as marks, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import lines, strip, text_or_empty

START, END = "\x01", "\x02"

#: Names of the parts of a job advertisement.
ADVERT = {
    "responsibilities": ("岗位职责", "工作职责", "职位描述", "岗位描述", "工作内容", "职位内容", "主要职责", "核心职责", "职责描述"),
    "requirements": ("任职要求", "岗位要求", "职位要求", "任职资格要求", "任职资格", "能力要求"),
    "bonus": ("加分项", "加分条件", "优先条件"),
}
#: Headings of a résumé, each alone on its line with a colon or none; text before any is the header.
RESUME = {
    "education": "教育背景|教育经历|学历背景",
    "skills": "专业技能|核心技能|技能清单|技能栈",
    "internships": "实习经历|实践经历",
    "projects": "项目经历|项目经验",
    "work": "工作经历|工作经验",
    "awards": "获奖经历|个人奖项|荣誉奖项|证书",
    "profile": "自我评价|个人优势|个人总结",
}
#: Words that speak of duties and of demands.
DUTIES = ("负责", "参与", "开发", "设计", "维护", "推动", "跟进", "搭建", "建设", "制定", "优化", "协助", "完成")
DEMANDS = ("学历", "本科", "硕士", "博士", "大专", "经验", "熟悉", "精通", "具备", "优先", "能力", "专业")


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), f"[{START}{END}]", "")


def _gather(marked: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """A struct by name: the trimmed text of all stretches whose mark holds one of the name's words."""
    cut = F.transform(
        F.split(marked, START),
        lambda s: F.struct(F.substring_index(s, END, 1).alias("word"), F.regexp_replace(s, f"(?s)^[^{END}]*{END}?", "").alias("body"))
    )
    later = F.slice(cut, F.lit(2), F.size(cut))

    def of(words: tuple[str, ...]) -> Column:
        return strip(F.array_join(F.transform(F.filter(later, lambda s: s["word"].isin(*words)), lambda s: s["body"]), ""))

    return F.struct(*(of(words).alias(name) for name, words in names.items()))


def inline_sections(text: Column, names: dict[str, tuple[str, ...]] = ADVERT) -> Column:
    """Sections whose names stand in a tag, after a Chinese number, in square brackets, before a colon, apart by blanks,
    or alone on a line. Several may share a line; what comes before a line's first belongs to the section before."""
    word = "(" + "|".join(f"\\Q{w}\\E" for w in sorted((w for ws in names.values() for w in ws), key=len, reverse=True)) + ")"
    marker = f"(?U)<[^>]+>\\s*{word}\\s*</[^>]+>|[一二三四五六七八九十]+[、.．]\\s*{word}(?=\\s)|[【\\[]\\s*{word}\\s*[】\\]]|{word}\\s*[：:]|(?<!\\S){word}(?=\\s)"

    def line(x: Column) -> Column:
        found = F.regexp_replace(x, marker, f"{START}$1$2$3$4$5{END}")
        # Parts around marks are trimmed and end in a line feed if any is left; parts begin at a line's start or mark.
        parts = F.transform(
            F.split(found, f"(?={START})"),
            lambda p: F.concat(F.regexp_extract(p, f"^({START}[^{END}]*{END})?", 0), strip(F.regexp_replace(p, f"^{START}[^{END}]*{END}", "")))
        )
        ended = F.transform(parts, lambda p: F.when((p == "") | p.endswith(END), p).otherwise(F.concat(p, F.lit("\n"))))
        bare = F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), "^[ ：:]+|[ ：:]+$", "")
        alone = F.concat(F.lit(START), bare, F.lit(END))
        return F.when(F.contains(found, F.lit(START)), F.array_join(ended, "")).when(bare.rlike(f"^{word}$"), alone).otherwise(F.concat(x, F.lit("\n")))

    return _gather(F.array_join(F.transform(lines(_unmarked(text)), line), ""), names)


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """How often the words occur in total, each counted by itself."""
    return sum((F.regexp_count(text, F.lit(f"\\Q{w}\\E")) for w in words), F.lit(0))


def unswapped(sections: Column, applies: Column) -> Column:
    """Advert sections with duties and demands exchanged where ``applies`` and both speak clearly of the other."""
    duties, demands = sections["responsibilities"], sections["requirements"]
    swapped = mentions(duties, DEMANDS) + mentions(demands, DUTIES)
    straight = mentions(duties, DUTIES) + mentions(demands, DEMANDS)
    wrong = applies & (duties != "") & (demands != "") & (swapped >= straight + 3) & (mentions(duties, DEMANDS) >= 2) & (mentions(demands, DUTIES) >= 2)
    return F.when(
        F.coalesce(wrong, F.lit(False)), F.struct(demands.alias("responsibilities"), duties.alias("requirements"), sections["bonus"].alias("bonus"))
    ).otherwise(sections)


def line_sections(text: Column, headings: dict[str, str] = RESUME, first: str = "header") -> Column:
    """Sections by headings that fill a line, given as patterns in order; lines are trimmed and empty ones dropped."""

    def line(x: Column) -> Column:
        out = F.concat(x, F.lit("\n"))
        for name, pattern in reversed(headings.items()):
            out = F.when(x.rlike(f"(?i)^(?:{pattern})[：:]?$"), F.lit(f"{START}{name}{END}")).otherwise(out)
        return out

    kept = F.filter(F.transform(lines(_unmarked(text)), strip), lambda x: x != "")
    marked = F.concat(F.lit(f"{START}{first}{END}"), F.array_join(F.transform(kept, line), ""))
    return _gather(marked, {n: (n,) for n in (first, *headings)})


def tagged_spans(tokens: Column, tags: Column, starts: Column, label: str) -> Column:
    """Spans of B I I runs with their offsets, null where the tags aren't as many or an I follows no B or I."""
    run = F.array_join(tags, "")
    begins = F.filter(F.transform(tags, lambda t, i: F.when(t == "B", i)), lambda i: i.isNotNull())
    sizes = F.transform(F.regexp_extract_all(run, F.lit("BI*"), F.lit(0)), F.length)

    def span(b: Column, n: Column) -> Column:
        last = b + n - 1
        return F.struct(
            F.get(starts, b).alias("start"), (F.get(starts, last) + F.length(F.get(tokens, last))).alias("end"), F.lit(label).alias("label"),
            F.array_join(F.slice(tokens, b + 1, n), " ").alias("text")
        )

    good = (F.size(tokens) == F.size(tags)) & F.forall(tags, lambda t: t.isin("B", "I", "O")) & ~run.rlike("(^|O)I")
    return F.when(good, F.zip_with(begins, sizes, span))
