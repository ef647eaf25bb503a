"""Scalar text functions as column expressions. Nulls count as empty texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's line ends and Unicode blanks; fixed values.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANKS = r"(?U)\s+"
#: Lines with one of these phrases, or that are one of the toggles, are page furniture; fixed values.
BUTTONS = ("立即沟通", "立即投递", "投递简历", "申请职位", "收藏职位", "查看地图", "分享职位")
TOGGLES = ("展开", "收起", "更多")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lines(c: Column) -> Column:
    """The lines of a text by every line end that Python knows."""
    return F.split(text_or_empty(c), LINE_ENDS)


def strip(c: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_space(c: Column) -> Column:
    """Blanks squeezed, lines trimmed, empty lines dropped."""
    plain = F.regexp_replace(F.translate(text_or_empty(c), "　", " "), "[ \t\r\f\x0b]+", " ")
    return F.array_join(F.filter(F.transform(lines(plain), strip), lambda x: x != ""), "\n")


def mask_private(c: Column) -> Column:
    """Mobile numbers, e-mail addresses and messenger ids masked."""
    c = F.regexp_replace(text_or_empty(c), r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)", "[手机号]")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[邮箱]")
    return F.regexp_replace(c, r"(?i)(微信|VX|WeChat)[:：]?\s*[A-Za-z0-9_-]{5,}", "$1：[已脱敏]")


def strip_html(c: Column) -> Column:
    """Scripts, styles and tags replaced by a blank."""
    c = F.regexp_replace(text_or_empty(c), r"(?is)<script.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style.*?</style>", " ")
    return F.regexp_replace(c, r"<[^>]+>", " ")


def remove_boilerplate(c: Column, phrases: tuple[str, ...] = BUTTONS, toggles: tuple[str, ...] = TOGGLES) -> Column:
    """Lines with a phrase, and lines that are a toggle, dropped."""
    def keep(x: Column) -> Column:
        ok = ~x.isin(*toggles) if toggles else F.lit(True)
        for p in phrases:
            ok = ok & ~F.contains(x, F.lit(p))
        return ok

    return F.array_join(F.filter(lines(c), keep), "\n")


def compact(c: Column) -> Column:
    """Lower case without blanks."""
    return F.regexp_replace(F.lower(text_or_empty(c)), BLANKS, "")


def dedup_lines(c: Column) -> Column:
    """The first line of each compact form, in order; lines without one dropped. Sorts, so long texts stay cheap."""
    marked = F.array_sort(F.transform(lines(c), lambda x, i: F.struct(compact(x).alias("k"), i.alias("i"), x.alias("x"))))
    bound = F.transform(F.array(marked), lambda s: F.filter(s, lambda e, j: (e["k"] != "") & ((j == 0) | (F.get(s, j - 1)["k"] != e["k"]))))
    firsts = F.sort_array(F.transform(F.get(bound, 0), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.array_join(F.transform(firsts, lambda e: e["x"]), "\n")


def similarity_text(c: Column) -> Column:
    """Only digits, a-z and CJK characters of the compact form."""
    return F.regexp_replace(compact(c), r"[^0-9a-z一-鿿]+", "")


def title_key(c: Column) -> Column:
    """Compact and without punctuation."""
    return F.regexp_replace(compact(c), r"[（）()\[\]【】\-_/·,.，。:：;；]+", "")


def fingerprint(c: Column) -> Column:
    return F.sha1(compact(c))


def bucket_key(
    source: Column, text: Column, prefix: int = 32, company: Column | None = None, title: Column | None = None, place: Column | None = None
) -> Column:
    """The blocking key of a row: source, company, title and place; without a company source, title, place and the first
    characters of the similarity text; without a title source and these characters."""
    head = F.substring(similarity_text(text), 1, prefix)
    part = lambda c: title_key(c) if c is not None else F.lit("")
    s, c, t, p = title_key(source), part(company), part(title), part(place)
    return F.when((t != "") & (c != ""), F.concat_ws("|", s, c, t, p)).when(t != "", F.concat_ws("|", s, t, p, head)).otherwise(F.concat_ws("|", s, head))


def clean(c: Column, markup: bool = False) -> Column:
    """The whole cleaning chain; of a page with ``markup`` its text without furniture. Character references are decoded in
    Python, in one batch a row before all other steps."""
    from curatrix.functions.values import unescaped_once

    plain = unescaped_once(strip_furniture(c) if markup else c)
    return normalize_space(dedup_lines(remove_boilerplate(normalize_space(mask_private(plain)))))


#: Characters from which the main element of a page is taken for its text.
LEAST_MAIN = 80


def main_text(page: Column) -> Column:
    """The cleaned text of a page's first article or main element where it is long enough, else that of the whole page."""
    inner = F.regexp_extract(text_or_empty(page), r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
    both = F.struct(clean(inner, True).alias("inner"), clean(page, True).alias("whole"))
    return F.get(F.transform(F.array(both), lambda s: F.when(F.length(s["inner"]) >= LEAST_MAIN, s["inner"]).otherwise(s["whole"])), 0)


def strip_furniture(c: Column) -> Column:
    """The text of a page without scripts, styles, menus, headers and footers, a line a tag's text."""
    c = F.regexp_replace(text_or_empty(c), r"(?is)<(script|style|noscript|nav|footer|header)\b.*?</\1\s*>", "\n")
    return F.regexp_replace(c, r"<[^>]+>", "\n")


def compact_hash(*texts: Column) -> Column:
    """SHA-256 of lower-cased texts without blanks, one after the other."""
    return F.sha2(F.regexp_replace(F.lower(F.concat_ws("\n", *(text_or_empty(t) for t in texts))), BLANKS, ""), 256)


def language(c: Column) -> Column:
    """zh, en or empty, by counts of CJK and ASCII letters."""
    cjk = F.regexp_count(text_or_empty(c), F.lit(r"[一-鿿]"))
    ascii_letters = F.regexp_count(text_or_empty(c), F.lit("[A-Za-z]"))
    return F.when(cjk >= F.greatest(F.lit(8), F.floor(ascii_letters / 2)), "zh").when(ascii_letters > cjk, "en").otherwise("")


def host(c: Column) -> Column:
    """The authority of a url in lower case, or public_web."""
    found = F.lower(F.regexp_extract(text_or_empty(c), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(found == "", "public_web").otherwise(found)


def stable_id(c: Column) -> Column:
    return F.concat(F.lit("jd_"), F.substring(F.sha1(text_or_empty(c)), 1, 12))
