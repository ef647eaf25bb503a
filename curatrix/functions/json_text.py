"""JSON answers of language models as column expressions: found, repaired and parsed. Nulls count as empty texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import strip, text_or_empty

#: Think blocks, the span of an object, typographic quotes and their plain forms, a trailing comma,
#: a bare text after a list at the end, and the key that such a text gets.
THINKING = "(?s)<think>.*?</think>"
SPAN = r"(?s)\{.*\}"
QUOTES, PLAIN = "“”‘’", "\"\"''"
TRAILING_COMMA = r"(?U),\s*([}\]])"
BARE_LAST = r'(?U)(?<=\])\s*,\s*"([^"]+)"\s*\]?\s*\}$'
LAST_KEY = "匹配结论"


def without_thinking(c: Column) -> Column:
    """Without think blocks, trimmed."""
    return strip(F.regexp_replace(text_or_empty(c), THINKING, ""))


def json_span(c: Column) -> Column:
    """From the first opening to the last closing brace; the trimmed text where there is no such span."""
    found = F.regexp_extract(without_thinking(c), SPAN, 0)
    return F.when(found != "", found).otherwise(without_thinking(c))


def repaired(c: Column, last_key: str = LAST_KEY) -> Column:
    """The span with plain quotes, without trailing commas, and with a key for a last text that follows a list bare."""
    plain = F.regexp_replace(F.translate(json_span(c), QUOTES, PLAIN), TRAILING_COMMA, "$1")
    return F.regexp_replace(plain, BARE_LAST, f', "{last_key}": "$1"}}')


def parsed(c: Column, last_key: str = LAST_KEY) -> Column:
    """A struct of ``strict`` (the span parses as it is), ``ok`` (it does so repaired) and the repaired ``json``, null if not ok."""
    good = F.try_parse_json(repaired(c, last_key)).isNotNull()
    return F.struct(F.try_parse_json(json_span(c)).isNotNull().alias("strict"), good.alias("ok"), F.when(good, repaired(c, last_key)).alias("json"))


def unique_items(c: Column) -> Column:
    """The first of equal texts of an array, compared trimmed; empty ones dropped, null gives an empty array."""
    marked = F.array_sort(
        F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(strip(text_or_empty(x)).alias("k"), i.alias("i"), x.alias("x")))
    )
    bound = F.transform(F.array(marked), lambda s: F.filter(s, lambda e, j: (e["k"] != "") & ((j == 0) | (F.get(s, j - 1)["k"] != e["k"]))))
    firsts = F.sort_array(F.transform(F.get(bound, 0), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(firsts, lambda e: e["x"])
