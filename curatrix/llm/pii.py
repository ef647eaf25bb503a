"""Personal data by candidate gradient boosting (native).

Generators of high recall propose spans, which may overlap: e-mail addresses,
dotted quads, chains of digits and international phone numbers, which have base
rules, and e-mail addresses that are spelled out, local phone numbers and long
hexadecimal strings, which have none. Spans that pass their base rule always
stay and those that fail it go. The others are scored by boosted regression
trees over small integers of format and context.

The trees learn from two halves of equal weight. The first are examples made by
rule from :data:`EXAMPLES`, in which the same forms stand for personal data and
for what looks like it (order numbers, dates, versions, checksums), so labels
disagree with the generators. The second are the corpus's own base spans, masked:
a phone number without its country code and an address spelled out are positive
in the context where they stand. Every second example, by a hash of what fills
it, is held out from the trees and calibrates the threshold of its shape: the
lowest score from which on :data:`PRECISION` of the held-out examples are
personal data. Of chosen spans that overlap, the highest score stays.

Defined results: null and empty texts have no spans; repeated rows get equal
spans; base spans depend on the text alone, further ones on the contexts of the
corpus's base spans as well; an empty table trains on the examples and gives no
rows; columns besides ``text`` are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: kind, shape, and pattern of each generator. Loops are possessive, so long texts need no deep stack.
GENERATORS = (
    ("email", "address", BASE),
    ("ip", "quad", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", "chain", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "plus", r"\+[0-9][\x20().0-9-]+[0-9]"),
    (
        "email", "spelled",
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}"
    ),
    ("phone", "local", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("secret", "hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"),
)
#: The shapes without a base rule, which the trees judge.
JUDGED = ("spelled", "local", "hex")
CONTEXT = 24
#: Words right before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|reach|address)[^A-Za-z]*(?:(?:me|us|to|is|at)[^A-Za-z]*){0,2}$",
    "phone": r"(?i)(?:tel|telephone|phone|mobile|cell|call|fax|contact|dial|reach|text|whatsapp)[^A-Za-z]*(?:(?:me|us|number|no|is|at|on)[^A-Za-z]*){0,2}$",
    "secret": r"(?i)(?:token|key|secret|passwd|password|bearer|credentials?|auth|authorization)[^A-Za-z]*(?:is[^A-Za-z]*)?$",
}
AGAINST = r"(?i)(?:order|invoice|part|item|sku|ref|reference|version|build|release|isbn|issn|page|pages|row|serial|id|no|nr|number|code|lot|batch|case|commit|sha|sha-?1|sha-?256|md5|checksum|rev|revision|hash|digest|etag|blob|tree|object|section|fig|figure|sum|total|from|date)[^A-Za-z]*$"
FEATURES = {"shape": len(JUDGED), "form": 7, "digits": 5, "left": 3, "right": 3, "cue": 3, "given": 2}
MOST_CELLS = 2 * math.prod(FEATURES.values())
#: Features without an order: trees ask whether they equal a value.
NOMINAL = ("shape", "form", "left", "right", "cue")
TREES = 40
RATE = 0.4
PRECISION = 0.9

#: Examples by shape: texts around a span (x), whether it is personal data there, and the forms that it takes.
EXAMPLES = (
    ("spelled", 1, ("mail {x} soon", "{x}", "reach me at {x}.", "I am {x}, thanks", "contact: {x}", "by {x} (author)"), ("named", "mixed")),
    ("spelled", 0, ("see {x} for it", "price {x} there", "we met {x}", "look {x}, please"), ("numbered", "spaced")),
    (
        "local", 1, ("call {x} now", "phone: {x}", "tel. {x}", "fax {x}", "my number is {x}", "reach me at {x}!", "Contact us on {x}"),
        ("dashes", "dots", "blanks", "bracket", "trunk")
    ),
    ("local", 1, ("{x}", "and {x} is hers", "J. Doe, {x}, Main St", "she wrote {x}."), ("dashes", "bracket", "trunk")),
    (
        "local", 0,
        (
            "order {x} x", "invoice no. {x}", "part {x} fits", "ref {x}", "version {x} is out", "SKU: {x}", "item {x}", "isbn {x}", "pages {x}",
            "id={x}", "serial {x}"
        ),
        ("dashes", "dots", "blanks", "trunk")
    ),
    ("local", 0, ("the values {x} and more", "{x}", "5 {x} 7", "sums of {x},", "run {x} again"), ("blanks", "dots")),
    (
        "hex", 1, ("token = \"{x}\"", "api_key: {x}", "secret={x}", "password '{x}'", "Authorization: Bearer {x}", "the key is {x}", "auth {x} ok"),
        ("hex32", "hex40", "hex64")
    ),
    (
        "hex", 0,
        (
            "commit {x}", "sha1 {x}", "sha256: {x}", "md5 = {x}", "checksum \"{x}\"", "revision {x}", "hash={x}", "etag: \"{x}\"", "{x}",
            "see {x} there", "blob {x} a", "digest {x}", "({x})"
        ),
        ("hex32", "hex40", "hex64")
    ),
    ("hex", 0, ("number {x}", "{x}", "total {x} of", "see {x}"), ("numeral",)),
)
#: What fills each form, made from numbers 0 .. FILLS - 1.
FILLS = 12


def filled(form: str, i: int) -> str:
    """The i-th text of a form."""
    import hashlib

    name, host, end = (
        "bob", "ann.lee", "j_doe", "info", "m.mueller", "sales+x"
    )[i % 6], ("mail", "example", "post-x", "uni")[i % 4], ("com", "org", "de", "co.uk", "net")[i % 5]
    at, dot = ("[at]", "(at)", " [at] ", " (at) ", "[ AT ]")[i % 5], ("[dot]", " (dot) ", " [dot] ", "(DOT)")[i % 4]
    area, mid, last = 201 + 61 * i, 220 + 47 * i, 1000 + 733 * i
    digest = hashlib.sha256(f"{form}{i}".encode()).hexdigest()
    return {
        "named": lambda: f"{name}{at}{host}{dot}{end.replace('.', dot)}",
        "mixed": lambda: f"{name}{at}{host}.{end}",
        "numbered": lambda: f"{('up', 'it', 'look')[i % 3]} (at) {('fig', 'sec', '10', 'p')[i % 4]}.{i + 2}",
        "spaced": lambda: f"{('down', 'sold', 'them')[i % 3]} (at) {('approx', 'ca', 'min')[i % 3]}. {('cost', 'price', 'five')[i % 3]}",
        "dashes": lambda: f"{area}-{mid}-{last}", "dots": lambda: f"{area}.{mid}.{last}", "blanks": lambda: f"{area} {mid} {last}",
        "bracket": lambda: f"({area}){' -'[i % 2]}{mid}-{last}", "trunk": lambda: f"0{20 + i}-{mid}-{last}",
        "hex32": lambda: digest[:32], "hex40": lambda: digest[:40], "hex64": lambda: digest,
        "numeral": lambda: str(int(digest, 16))[: 32 + i],
    }[form]()


def proposed(text: Column, kind: str, shape: str, pattern: str) -> Column:
    """All matches as structs of kind, shape, start, stop, the match, and what stands left and right of it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,match:string,before:string,after:string>>").alias("all"))

    def add(acc: Column, i: Column, ms: Column, gs: Column) -> Column:
        start = acc["at"] + F.length(F.get(gs, i))
        stop = start + F.length(F.get(ms, i))
        span = F.struct(
            start.alias("start"), stop.alias("stop"), F.get(ms, i).alias("match"), F.right(F.get(gs, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(gs, i + 1), F.lit(2)).alias("after")
        )
        return F.struct(stop.alias("at"), F.concat(acc["all"], F.array(span)).alias("all"))

    # The matches and gaps are bound once, as the elements of a one-element array.
    bound = F.transform(
        F.array(F.struct(found.alias("ms"), gaps.alias("gs"))),
        lambda b: F.aggregate(F.sequence(F.lit(0), F.size(b["ms"]) - 1), begin, lambda acc, i: add(acc, i, b["ms"], b["gs"]), lambda acc: acc["all"])
    )
    spans = F.when(text.rlike(pattern), F.get(bound, 0)).otherwise(F.array().cast("array<struct<start:int,stop:int,match:string,before:string,after:string>>"))
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(kind).alias("kind"), F.lit(shape).alias("shape"), s["start"].alias("start"), s["stop"].alias("stop"), s["match"].alias("match"),
            s["before"].alias("before"), s["after"].alias("after")
        )
    )


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of 10."""
    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def strict(c: Column) -> Column:
    """The strict test of a candidate; null where its shape has none."""
    digits = digits_of(c["match"])
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(c["shape"] == "address", F.lit(True))
        .when(c["shape"] == "quad", c["match"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(c["shape"] == "chain", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .when(c["shape"] == "plus", n.between(9, 15))
    )


def features(c: Column) -> dict[str, Column]:
    """Small integers of format and context."""
    m, before = c["match"], c["before"]
    n = F.length(digits_of(m))
    edge = lambda s, p: F.when(s.rlike(p), 0).when(s.rlike("[\\p{L}0-9]"), 1).otherwise(2)
    shape = F.lit(len(JUDGED) - 1)
    for i, name in reversed(list(enumerate(JUDGED))):
        shape = F.when(c["shape"] == name, i).otherwise(shape)
    spelled = F.when(m.rlike("(?i)[\\])]\\x20?[A-Za-z0-9-]+.*\\.\\x20"), 0).when(
        m.rlike("[\\x20.\\])][A-Za-z]{2,}$"), F.when(m.rlike("(?i)[\\[(]\\x20?dot"), 1).otherwise(2)
    ).otherwise(3)
    local = F.when(m.startswith("("), 0).when(m.rlike("^0"), 1).when(m.rlike("^[0-9]+-[0-9]+-"), 2).when(m.rlike("^[0-9]+\\.[0-9]+\\."), 3).when(m.rlike("^[0-9]+\\x20[0-9]+\\x20"), 4).otherwise(5)
    hexed = F.when(m.rlike("^[0-9]+$"), 0).when(m.rlike("^[A-Fa-f]+$"), 1).when(F.length(m) == 32, 2).when(F.length(m) == 40, 3).when(F.length(m) == 64, 4).otherwise(5)
    cue = F.lit(0)
    for kind, pattern in FOR.items():
        cue = F.when((c["kind"] == kind) & before.rlike(pattern), 1).otherwise(cue)
    return {
        "shape": shape,
        "form": F.when(c["shape"] == "spelled", spelled).when(c["shape"] == "local", local).otherwise(hexed),
        "digits": F.when(n == 0, 0).when(n < 9, 1).when(n < 11, 2).when(n < 16, 3).otherwise(4),
        "left": edge(F.right(before, F.lit(1)), "^\\s?$"),
        "right": edge(F.left(c["after"], F.lit(1)), "^\\s?$"),
        "cue": F.when(before.rlike(AGAINST), 2).otherwise(cue),
        "given": before.rlike("[=:]\\s*[\"']?$").cast("int"),
    }


def masked(c: Column) -> Column:
    """A base span as the judged shape that is left when what its rule relies on is taken away; null where there is none."""
    like = lambda kind, shape, match: F.struct(
        F.lit(kind).alias("kind"), F.lit(shape).alias("shape"), match.alias("match"), c["before"].alias("before"), c["after"].alias("after")
    )
    local = F.regexp_replace(c["match"], "^\\+[0-9]{1,3}[\\x20.-]?", "")
    spelled = F.regexp_replace(F.regexp_replace(c["match"], "@", " [at] "), "\\.([A-Za-z]+)$", " [dot] $1")
    pattern = {g[1]: g[2] for g in GENERATORS}
    of_phone = (c["shape"] == "plus") & local.rlike(f"^{pattern['local']}$")
    of_mail = (c["shape"] == "address") & spelled.rlike(f"^{pattern['spelled']}$")
    return F.when(of_phone, like("phone", "local", local)).when(of_mail, like("email", "spelled", spelled))


def _cells(c: Column) -> Column:
    return F.struct(*[v.cast("int").alias(k) for k, v in features(c).items()])


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``sure``, the spans that pass their base rule, with their masked features, and ``found``, those that
    have no base rule, with theirs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ruled, judged = (F.concat(*[proposed(text, *g) for g in GENERATORS if (g[1] in JUDGED) == j]) for j in (False, True))
    place = lambda c: (c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))
    fold = lambda c: F.pmod(F.xxhash64(c["match"]), F.lit(2)).cast("int").alias("fold")
    learn = lambda c: F.get(F.transform(F.filter(F.array(masked(c)), lambda m: m.isNotNull()), _cells), 0)
    sure = F.transform(F.filter(ruled, strict), lambda c: F.struct(*place(c), fold(c), learn(c).alias("f")))
    found = F.transform(judged, lambda c: F.struct(*place(c), fold(c), c["shape"].alias("shape"), _cells(c).alias("f")))
    return docs.withColumn("sure", sure).withColumn("found", found)


def examples(spark: SparkSession) -> DataFrame:
    """Cells (features, fold, pos, neg) of the examples; the fold is by what fills the example."""
    rows = [
        (shape, good, around.replace("{x}", filled(form, i)), around.index("{x}")) for shape, good, arounds,
        forms in EXAMPLES for around in arounds for form in forms for i in range(FILLS)
    ]
    listed = F.array(*[F.struct(F.lit(s).alias("want"), F.lit(g).alias("good"), F.lit(t).alias("text"), F.lit(at).alias("at")) for s, g, t, at in rows])
    found = candidates(spark.range(1).select(F.inline(listed))).select("want", "good", "at", F.explode("found").alias("c"))
    mine = found.filter((F.col("c.shape") == F.col("want")) & (F.col("c.start") <= F.col("at") + 6) & (F.col("c.stop") > F.col("at")))
    return _counted(mine.select("c.f.*", "c.fold", F.col("good").alias("good")))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FEATURES, "fold").agg(F.sum("good").cast("double").alias("pos"), F.sum(1 - F.col("good")).cast("double").alias("neg"))


def grow(cells: list[dict], trees: int = TREES, rate: float = RATE) -> list[tuple]:
    """Boosted trees of depth 2 with logistic loss over labelled cells {features, pos, neg}.

    A tree is ((feature, limit), left, right); a side is ((feature, limit), low, high) or a number. Rows with
    feature <= limit go left; with a nominal feature, those where it equals the limit.
    """
    data = [c for c in cells if c["pos"] + c["neg"] > 0]
    if not data:
        return []
    tests = [(f, v) for f, n in FEATURES.items() for v in range(n if f in NOMINAL else n - 1)]
    score = [0.0] * len(data)
    out = []

    def value(rows: list[int]) -> tuple[float, float]:
        g = h = 0.0
        for i in rows:
            p = 1 / (1 + math.exp(-score[i]))
            n = data[i]["pos"] + data[i]["neg"]
            g += data[i]["pos"] - n * p
            h += n * p * (1 - p)
        return g / (h + 1), g * g / (h + 1)

    def best(rows: list[int]):
        found = None
        for f, v in tests:
            low = [i for i in rows if goes_left(data[i], f, v)]
            if low and len(low) < len(rows):
                high = [i for i in rows if not goes_left(data[i], f, v)]
                gain = value(low)[1] + value(high)[1]
                if found is None or gain > found[0] + 1e-9:
                    found = (gain, (f, v), low, high)
        return found

    def side(rows: list[int]):
        cut = best(rows)
        if cut is None:
            return rate * value(rows)[0]
        return (cut[1], rate * value(cut[2])[0], rate * value(cut[3])[0])

    for _ in range(trees):
        cut = best(list(range(len(data))))
        if cut is None:
            out.append((("digits", FEATURES["digits"]), rate * value(list(range(len(data))))[0], 0.0))
        else:
            out.append((cut[1], side(cut[2]), side(cut[3])))
        score = [s + leaf(out[-1], c) for s, c in zip(score, data, strict=True)]
    return out


def goes_left(cell: dict, f: str, v: int) -> bool:
    return cell[f] == v if f in NOMINAL else cell[f] <= v


def leaf(tree, cell: dict) -> float:
    while isinstance(tree, tuple):
        (f, v), low, high = tree
        tree = low if goes_left(cell, f, v) else high
    return tree


def scored(trees: list[tuple], f: Column) -> Column:
    """The trees' sum as one expression."""
    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        (name, v), low, high = tree
        return F.when(f[name] == v if name in NOMINAL else f[name] <= v, walk(low)).otherwise(walk(high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + walk(tree)
    return total


def train(found: DataFrame, precision: float = PRECISION) -> tuple[list[tuple], dict[str, float]]:
    """(trees, threshold by shape) from ``found`` (with ``sure``). What reaches the driver are at most MOST_CELLS cells."""
    order = [*FEATURES, "fold"]
    made = [r.asDict() for r in examples(found.sparkSession).orderBy(*order).collect()]
    own = found.select(F.explode("sure").alias("c")).filter("c.f is not null").select("c.f.*", "c.fold", F.lit(1).alias("good"))
    own = [r.asDict() for r in _counted(own).orderBy(*order).collect()]
    # The corpus's cells weigh as much in all as the positive examples, whatever its size.
    weight = sum(c["pos"] for c in made) / max(1.0, sum(c["pos"] for c in own))
    fitted = [c for c in made if c["fold"] == 0] + [c | {"pos": c["pos"] * weight} for c in own if c["fold"] == 0]
    trees = grow(fitted)

    def threshold(rows: list) -> float:
        pos = neg = 0
        lowest = math.inf
        rows = sorted(rows, key=lambda x: -x[0])
        for k, (s, c) in enumerate(rows):
            pos, neg = pos + c["pos"], neg + c["neg"]
            if (k + 1 == len(rows) or rows[k + 1][0] < s) and pos >= precision * (pos + neg):
                lowest = s
        return lowest

    marks = [(sum(leaf(t, c) for t in trees), c) for c in made if c["fold"] == 1]
    return trees, {shape: threshold([x for x in marks if x[1]["shape"] == i]) for i, shape in enumerate(JUDGED)}


def find_pii(docs: DataFrame, *, precision: float = PRECISION, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans``: structs (start, rank, kind, stop, base), sorted; code points, stop exclusive.

    ``base`` marks the spans of the base rules; the others are those the trees select that touch no base span and no
    other of a higher score. Columns of ``docs`` named ``spans``, ``found`` or ``sure`` are replaced; without
    ``keep_text``, ``text`` is dropped. The candidates are written once, since the trees learn from all of them before
    they judge each.
    """
    out = candidates(docs)
    out = materialize(out if keep_text else out.drop("text"), "candidates")
    trees, limits = train(out, precision)

    def span(c: Column, base: bool) -> Column:
        r = F.lit(len(KINDS))
        for i, k in reversed(list(enumerate(KINDS))):
            r = F.when(c["kind"] == k, i).otherwise(r)
        return F.struct(c["start"].alias("start"), r.cast("int").alias("rank"), c["kind"].alias("kind"), c["stop"].alias("stop"), F.lit(base).alias("base"))

    limit = lambda c: F.when(c["shape"] == "spelled", limits["spelled"]).when(c["shape"] == "local", limits["local"]).otherwise(limits["hex"])
    apart = lambda c, others: ~F.exists(others, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    marked = F.transform(
        "found",
        lambda c: F.struct(
            (-scored(trees, c["f"])).alias("cost"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"),
            c["shape"].alias("shape")
        )
    )
    chosen = F.array_sort(F.filter(marked, lambda c: (-c["cost"] >= limit(c)) & apart(c, F.col("sure"))))
    none = F.array().cast("array<struct<cost:double,start:int,stop:int,kind:string,shape:string>>")
    more = F.aggregate(chosen, none, lambda acc, c: F.when(apart(c, acc), F.concat(acc, F.array(c))).otherwise(acc))
    both = F.concat(F.transform("sure", lambda c: span(c, True)), F.transform(more, lambda c: span(c, False)))
    spans = F.when((F.size("sure") > 0) | (F.size("found") > 0), F.sort_array(F.array_distinct(both)))
    return out.withColumn(
        "spans", F.coalesce(spans, F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int,base:boolean>>"))
    ).drop("found", "sure")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans by document."""
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans the first names the whole."""
    # Other columns get plain names on the way, so none clashes with those added here.
    found = find_pii(docs.toDF(*[n if n == "text" else f"c{i}" for i, n in enumerate(docs.columns)]), **params)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.when(
            s["start"] >= acc["at"],
            F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        ).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["parts"], F.array(piece)).alias("parts"))

    clean = F.aggregate("spans", begin, add, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).drop("spans").toDF(*docs.columns)
