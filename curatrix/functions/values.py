"""Values of imported rows as column expressions: markup, tags, lists, keywords, hashes. Nulls count as empty texts."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curatrix.functions.text import lines, strip, text_or_empty

#: JSON-LD blocks, the type of an advert, and what ends a line of markup.
LINKED_DATA = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
POSTING = "JobPosting"
BREAK, BLOCK_END = r"(?i)<br\s*/?>", r"(?i)</(p|div|li|ul|ol|h\d)>"


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape)


#: Called once a row and never moved: rules over a cleaned text refer to it many times, and filters over it would be
#: evaluated below it again.
_unescaped_once = F.pandas_udf(lambda s: s.map(html.unescape), StringType()).asNondeterministic()


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x))


def unescaped(c: Column) -> Column:
    """With character references decoded; HTML has over two thousand, so this is a batched Python function."""
    return _unescaped(text_or_empty(c))


def unescaped_once(c: Column) -> Column:
    """As :func:`unescaped`, for texts that much is built upon."""
    return _unescaped_once(text_or_empty(c))


def compatible(c: Column) -> Column:
    """In Unicode's compatibility form NFKC, which Spark lacks."""
    return _compatible(text_or_empty(c))


def markup_text(c: Column) -> Column:
    """Decoded, with line feeds for breaks and ends of blocks, without tags, at most one empty line in a row."""
    broken = F.regexp_replace(F.regexp_replace(unescaped(c), BREAK, "\n"), BLOCK_END, "\n")
    return strip(F.regexp_replace(F.regexp_replace(broken, "<[^>]+>", ""), "\n{3,}", "\n\n"))


def value(c: Column) -> Column:
    """Trimmed; empty for null and for the word none."""
    return F.when(F.lower(strip(text_or_empty(c))) == "none", "").otherwise(strip(text_or_empty(c)))


def tagged(c: Column, tag: str) -> Column:
    """What the first pair of tags encloses, as a value."""
    return value(F.regexp_extract(text_or_empty(c), f"(?s)<\\Q{tag}\\E>(.*?)</\\Q{tag}\\E>", 1))


def listed(c: Column) -> Column:
    """The values of a list written in a text, parted by the first of 、 , and line ends that occurs in it."""
    v = value(c)
    parts = F.when(F.contains(v, F.lit("、")), F.split(v, "、")).when(F.contains(v, F.lit(",")), F.split(v, ",")).otherwise(lines(v))
    return F.filter(F.transform(parts, value), lambda x: x != "")


def wanted(c: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether none of the excluded words and, if there are included ones, one of these is in the padded text."""
    padded = F.concat(F.lit(" "), F.lower(text_or_empty(c)), F.lit(" "))
    has = lambda words: padded.rlike("|".join(f"\\Q{w.lower()}\\E" for w in words)) if words else F.lit(False)
    return ~has(exclude) & (has(include) if include else F.lit(True))


def job_posting(page: Column) -> Column:
    """The first advert among a page's JSON-LD objects, or those of its lists, as JSON; null if none."""
    blocks = F.filter(F.regexp_extract_all(text_or_empty(page), F.lit(LINKED_DATA), F.lit(1)), lambda b: F.try_parse_json(b).isNotNull())
    items = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(F.when(b.rlike(r"^\s*\["), b), "array<string>"), F.array(b))))
    return F.get(F.filter(items, lambda x: F.get_json_object(x, "$['@type']") == POSTING), 0)


def normalized_hash(c: Column) -> Column:
    """SHA-1 of the letters and numbers of the lower-cased compatibility form."""
    return F.sha1(F.regexp_replace(F.lower(compatible(c)), r"[^\p{L}\p{N}]", ""))
