"""Main text of web pages by site style trees.

All pages of a host are merged into one tree: elements are the same node where
their paths of tag names and classes are the same. A node's presentation styles
are the sequences of child tags it was seen with, its content are the texts of
the blocks directly in it. With N sightings, of which a share p_i shows style or
text i, the entropy ``-sum p_i log_N p_i`` is 1 where every page differs and 0
where all agree; a block's importance is that of its content and, by a small
weight, of its parent's presentation, shrunk towards 1 where it rests on few
sightings. Blocks of nodes with an importance near 0 are the site's furniture
and are removed, and so is a branch all of whose blocks are. Nodes whose tag, role or class names them as
menus, headers, footers, sidebars, notices, adverts, forms or reader comments
have importance 0 by rule, as have scripts and styles; but a form, a role, a
class or an id decides nothing on an element that holds an article or main
element or over half of the page's text outside furniture known by its tag.
Names say nothing on headings, and on articles and inline elements only where a
whole class is one of a comment or an advert. What
remains inside article or main elements is the text, or all that remains where
there are none.

Pages of a host with equal html count once. Counts are sums by (host, node,
feature), so a host with a third of all pages is pre-aggregated like any other.

Defined results: null and empty html give an empty text; repeated rows are
extracted one by one; null urls form one host; an empty table gives no rows;
columns besides page_id, url and html are kept unless named text or n_chars.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import bound_batches, materialize, pieces

#: Sightings, as if all differed, that every node has besides its own; a node seen nine times with one text is low.
PRIOR = 1.5
#: Blocks of less importance are removed.
LEAST_IMPORTANCE = 0.15
#: Weight of the content against the parent's presentation.
CONTENT_WEIGHT = 0.9

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside menu button select label fieldset dialog head option object".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLASSES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo|promotion|cookies?|consent|gdpr|notice|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|disqus|replies|related|recommended|share|sharing|social|subscribe|newsletter|popup|modal|login|signup|widget|pagination|pager|toolbar|copyright)(?:$|[\s_-])",
    re.I
)
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
#: What a start tag closes first, if it is open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Whole classes that tell articles of readers and inline adverts.
REMARKS = frozenset("comment comments comment-body reply replies".split())
ADVERTS = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
KEEPERS = frozenset(("ul", "ol", "dl", "table", "html", "body", "article", "main"))

#: An attribute. A quote opens a value only after an equals sign; one that's never closed is part of a name, so its tag ends at the next ">".
_NAMED = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|{_NAMED})*+)>"
    r"|<[!?/][^>]*+>"
    r"|</?[a-zA-Z][^<>]*+\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
_SPACES = re.compile(r"\s+")

Block = tuple[int, int, str, bool]  # node, parent node, text, inside an article


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


_NODES: dict[tuple[int, str, str], tuple[int, int]] = {}


def _node(parent: int, tag: str, attrs: str) -> tuple[int, int]:
    """(node, rule) of a child element; rule 0: content, 1: furniture, 2: furniture outside articles, 3 and 4: the same by name alone."""
    key = (parent, tag, attrs)
    found = _NODES.get(key)
    if found is None:
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
        names = f"{named.get('class', '')} {named.get('id', '')}"
        classes = set(named.get("class", "").lower().split())
        rule = 0
        if tag in FURNITURE:
            rule = 1
        elif tag == "form":
            rule = 3
        elif tag == "header":
            rule = 3 if CLASSES.search(names) else 2
        elif tag in ("html", "body", "main") or tag in HEADINGS:
            rule = 0
        elif tag == "article":
            rule = 3 if classes & (REMARKS | ADVERTS) else 0
        elif tag not in BLOCK:
            rule = 3 if classes & ADVERTS else 0
        elif CLASSES.search(names) or named.get("role", "").lower() in ROLES:
            rule = 3
        elif HEADERS.search(names):
            rule = 4
        found = (_hash(parent, tag, " ".join(sorted(classes))), rule)
        if len(_NODES) > 100_000:
            _NODES.clear()
        if len(attrs) < 200:
            _NODES[key] = found
    return found


def parse(page: str | None) -> tuple[list[Block], set[tuple[int, int]]]:
    """(blocks, styles): the page's blocks outside furniture, in order, and (node, hash of its child tags)."""
    page = page or ""
    # Texts come as pieces (innermost element named as furniture or -1, text): what the names mean is known at the end.
    found: list[tuple[int, int, list[tuple[int, str]], bool]] = []
    # Of the elements named as furniture: the one around it or -1, characters, whether it holds an article.
    named: list[list] = []
    styles: set[tuple[int, int]] = set()
    # tag, node, furniture, in an article, child tags, innermost named element
    stack: list[tuple[str, int, bool, bool, list[str], int]] = [("", 0, False, False, [], -1)]
    buffer: list[tuple[int, str]] = []
    depth: dict[str, int] = {}

    def flush() -> None:
        if buffer:
            k = len(stack) - 1
            while k and stack[k][0] not in BLOCK:
                k -= 1
            found.append((stack[k][1], stack[k - 1][1] if k else 0, buffer.copy(), stack[-1][3]))
            buffer.clear()

    def pop(n: int) -> None:
        while len(stack) > n:
            tag, node, _, _, children, _ = stack.pop()
            depth[tag] -= 1
            if children:
                styles.add((node, _hash(*children)))

    def close(tags: tuple[str, ...]) -> None:
        k = len(stack) - 1
        while k and stack[k][0] not in tags and stack[k][0] not in KEEPERS:
            k -= 1
        if k and stack[k][0] in tags:
            pop(k)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not stack[-1][2]:
            buffer.append((stack[-1][5], page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append((-1, " "))
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            if depth.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
            continue
        if tag in BLOCK and depth.get("p"):
            close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag])
        parent = stack[-1]
        parent[4].append(tag)
        if tag in VOID:
            continue
        node, rule = _node(parent[1], tag, m["attrs"])
        inside = parent[3] or tag in ("article", "main")
        furniture = parent[2] or rule == 1 or (rule == 2 and not inside)
        mark = parent[5]
        if not furniture and (rule == 3 or (rule == 4 and not inside)):
            named.append([mark, 0, False])
            mark = len(named) - 1
        elif not furniture and tag in ("article", "main"):
            k = mark
            while k >= 0 and not named[k][2]:
                named[k][2] = True
                k = named[k][0]
        stack.append((tag, node, furniture, inside, [], mark))
        depth[tag] = depth.get(tag, 0) + 1
    if at < len(page) and not stack[-1][2]:
        buffer.append((stack[-1][5], page[at:]))
    flush()
    pop(1)
    if stack[0][4]:
        styles.add((0, _hash(*stack[0][4])))
    total = 0
    for *_, pieces, _ in found:
        for mark, text in pieces:
            n = len(text.strip())
            total += n
            if mark >= 0:
                named[mark][1] += n
    for outer, n, _ in reversed(named):  # outer ones come before those in them
        if outer >= 0:
            named[outer][1] += n
    low: list[bool] = []
    for outer, n, holds in named:
        low.append((outer >= 0 and low[outer]) or (not holds and 2 * n <= total))
    blocks: list[Block] = []
    for node, parent_node, pieces, inside in found:
        text = _SPACES.sub(" ", html_lib.unescape("".join(t for mark, t in pieces if mark < 0 or not low[mark]))).strip()
        if text:
            blocks.append((node, parent_node, text, inside))
    return blocks, styles


def text_of(page: str | None, low: set[int] | None = None) -> str:
    """The blocks that remain, joined by empty lines."""
    blocks = [b for b in parse(page)[0] if not low or b[0] not in low]
    return "\n\n".join(b[2] for b in ([b for b in blocks if b[3]] or blocks))


def host(url: Column) -> Column:
    """The authority of a url in lower case; null and odd urls give an empty one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def style_tree(pages: DataFrame, content_weight: float = CONTENT_WEIGHT, prior: float = PRIOR) -> DataFrame:
    """(host, node, pages, importance) of every node with blocks of its own."""
    bound_batches(pages.sparkSession)
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    names = ["host", "page", "node", "parent", "content", "feature"]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            for h, page, key in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "h")), strict=True):
                blocks, styles = parse(page)
                rows += {(h, key, node, parent, True, _hash(text)) for node, parent, text, _ in blocks}
                rows += {(h, key, node, 0, False, style) for node, style in styles}
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    # Equal pages of a host give equal rows, which count once.
    keyed = pages.select(host(F.col("url")).alias("host"), "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("h"))
    features = keyed.mapInArrow(seen, "host string, page long, node long, parent long, content boolean, feature long")
    once = features.distinct()
    # Written, since both branches read it and each would parse all pages again.
    counts = materialize(once.groupBy("host", "node", "parent", "content", "feature").agg(F.count(F.lit(1)).alias("c")), "features")
    nodes = counts.groupBy("host", "node", "parent", "content").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.max("c").alias("most")
    )
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("clogc") / F.col("n")) / F.log("n")).otherwise(1.0)
    nodes = nodes.withColumn("entropy", entropy)
    styles = nodes.filter("not content").select("host", F.col("node").alias("parent"), F.col("entropy").alias("style"))
    found = nodes.filter("content").join(styles, ["host", "parent"], "left")
    importance = content_weight * F.col("entropy") + (1 - content_weight) * F.coalesce("style", F.lit(0.0))
    return found.select("host", "node", F.col("n").alias("pages"), ((F.col("n") * importance + prior) / (F.col("n") + prior)).alias("importance"))


def main_text(pages: DataFrame, *, least_importance: float = LEAST_IMPORTANCE, prior: float = PRIOR) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    low = style_tree(pages, prior=prior).filter(F.col("importance") < least_importance)
    # Written first, so that its size is known and the join broadcasts it only where it is small.
    low = materialize(low.groupBy("host").agg(F.collect_set("node").alias("low")), "furniture")
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(F.struct(*kept).alias("row"), "html", host(F.col("url")).alias("host")).join(low, "host", "left").select("row", "html", "low")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [text_of(h, set(x) if x else None) for h, x in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    out = rows.mapInArrow(extract, schema)
    return out.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
