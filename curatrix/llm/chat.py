"""Chat formatting by a compiler of a small, sandboxed template language.

A template is text with ``{{ expression }}`` and the blocks ``{% for x in
list %}``, ``{% if %}``/``{% elif %}``/``{% else %}``, ``{% set x = expression
%}`` and ``{% generation %}``, whose output is the assistant's and goes under the
loss mask. Expressions have literals, names, ``.field`` and ``[index]`` of given
data, comparisons, ``in``, ``and``/``or``/``not``, ``+``, and the named filters
of :data:`FILTERS`; there are no calls and no Python attributes. The syntax tree
is folded (constant expressions, dead branches, neighbouring texts) and becomes
Python closures, generators of (text, under the mask) that take the messages one
by one, so the longest conversation passes through in pieces.

Inside texts, ``escape`` puts a backslash after the first character of each
control string and doubles backslashes, which :func:`unescape` undoes.

Defined results: null texts and roles are empty; rows go by turn (nulls first),
equal turns by role, then text, and repeated rows each count; an empty table
gives no rows; columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import bound_batches, pieces

#: Strings that mean something to the format; fixed values.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}{{ '<|' + (m.role | escape) + '|>\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|end|>' + '\\n' }}{% endfor %}"
)
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


class TemplateError(ValueError):
    """A template that can't be compiled, or asks for something it may not have."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower(), "length": len}
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+|.()\[\]=,]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m or m.end() == at:
            raise TemplateError(f"unexpected {source[at : at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """A recursive-descent parser of one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def take(self, *values: str) -> str | None:
        if self.tokens[self.at][1] in values and self.tokens[self.at][0] in ("op", "name"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        node = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("compare", op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("add", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            name = self.tokens[self.at][1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            node: tuple = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        elif kind == "num":
            node = ("const", int(value))
        elif kind == "name":
            node = ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        elif value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("')' is missing")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                kind, value = self.tokens[self.at]
                if kind != "name" or value.startswith("_"):
                    raise TemplateError(f"no field {value!r}")
                self.at += 1
                node = ("item", node, ("const", value))
            else:
                node = ("item", node, self.either())
                if not self.take("]"):
                    raise TemplateError("']' is missing")
        return node


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("put", e), ("set", name, e), ("for", name, e, body), ("if", [(e, body)...]), ("generation", body)."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    root: list[tuple] = []
    stack: list[tuple[str, list, object]] = [("", root, None)]
    for part in parts:
        body = stack[-1][1]
        if part.startswith("{{"):
            body.append(("put", _Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad for: {rest!r}")
                inner: list[tuple] = []
                body.append(("for", m[1], _Expression(m[2]).whole(), inner))
                stack.append(("for", inner, None))
            elif word == "if":
                inner, arms = [], []
                arms.append((_Expression(rest).whole(), inner))
                body.append(("if", arms))
                stack.append(("if", inner, arms))
            elif word in ("elif", "else"):
                if stack[-1][0] != "if":
                    raise TemplateError(f"{word} without if")
                arms, inner = stack.pop()[2], []
                arms.append((_Expression(rest).whole() if word == "elif" else ("const", True), inner))
                stack.append(("if", inner, arms))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"bad set: {rest!r}")
                body.append(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                inner = []
                body.append(("generation", inner))
                stack.append(("generation", inner, None))
            elif word in ("endfor", "endif", "endgeneration"):
                if stack[-1][0] != word[3:]:
                    raise TemplateError(f"{word} without {word[3:]}")
                stack.pop()
            else:
                raise TemplateError(f"no block {word!r}")
        elif part:
            body.append(("text", part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return root


def _compute(node: tuple, names: dict):
    """The value of an expression."""
    kind = node[0]
    if kind == "const":
        return node[1]
    if kind == "name":
        if node[1] not in names:
            raise TemplateError(f"no name {node[1]!r}")
        return names[node[1]]
    if kind == "item":
        of, key = _compute(node[1], names), _compute(node[2], names)
        if isinstance(of, dict) or (isinstance(of, (list, tuple, str)) and isinstance(key, int)):
            return of[key]
        raise TemplateError(f"nothing to look up {key!r} in")
    if kind == "filter":
        return FILTERS[node[1]](_compute(node[2], names))
    if kind == "add":
        return _compute(node[1], names) + _compute(node[2], names)
    if kind == "not":
        return not _compute(node[1], names)
    if kind in ("and", "or"):
        left = _compute(node[1], names)
        return _compute(node[2], names) if bool(left) == (kind == "and") else left
    a, b = _compute(node[2], names), _compute(node[3], names)
    return {
        "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
        "in": lambda: a in b
    }[node[1]]()


def fold_expression(node: tuple) -> tuple:
    """Constant parts computed."""
    if node[0] in ("const", "name"):
        return node
    node = tuple(fold_expression(x) if isinstance(x, tuple) else x for x in node)
    inner = [x for x in node if isinstance(x, tuple)]
    if node[0] == "add" and node[2][0] == "const" and node[1][0] == "add" and node[1][2][0] == "const":
        return ("add", node[1][1], ("const", node[1][2][1] + node[2][1]))
    return ("const", _compute(node, {})) if all(x[0] == "const" for x in inner) else node


def fold(body: list[tuple]) -> list[tuple]:
    """Constant expressions computed, dead branches dropped, neighbouring texts joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "put":
            stack = [fold_expression(node[1])]
            while stack:  # sums of strings become separate puts
                e = stack.pop()
                if e[0] == "add" and any(x[0] == "const" and isinstance(x[1], str) for x in e[1:]):
                    stack += [e[2], e[1]]
                else:
                    add(("text", str(e[1])) if e[0] == "const" else ("put", e))
        elif node[0] == "if":
            arms = []
            for e, inner in node[1]:
                e = fold_expression(e)
                if e[0] != "const" or e[1]:
                    arms.append((e, fold(inner)))
                if e[0] == "const" and e[1]:
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                out.append(("if", arms))
        elif node[0] == "for":
            out.append(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            out.append(("set", node[1], fold_expression(node[2])))
        elif node[0] == "generation":
            out.append(("generation", fold(node[1])))
        else:
            add(node)
    return out


Piece = tuple[str, bool]


def _closure(e: tuple) -> Callable[[dict], object]:
    """An expression as nested closures."""
    if e[0] == "const":
        return lambda names, v=e[1]: v
    if e[0] == "item" and e[1][0] == "name" and e[2][0] == "const":
        def item(names, a=e[1], k=e[2][1]):
            of = _compute(a, names)
            return of[k] if isinstance(of, dict) else _compute(("item", a, ("const", k)), names)
        return item
    if e[0] == "filter":
        return lambda names, f=FILTERS[e[1]], inner=_closure(e[2]): f(inner(names))
    return lambda names, e=e: _compute(e, names)


def _generator(body: list[tuple], masked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps: list[Callable[[dict], Iterable[Piece]]] = []
    for node in body:
        if node[0] == "text":
            steps.append(lambda names, p=((node[1], masked),): p)
        elif node[0] == "put":
            steps.append(lambda names, f=_closure(node[1]): ((str(f(names)), masked),))
        elif node[0] == "set":
            def put(names, key=node[1], f=_closure(node[2])):
                names[key] = f(names)
                return ()
            steps.append(put)
        elif node[0] == "generation":
            steps.append(_generator(node[1], True))
        elif node[0] == "if":
            def choose(names, arms=[(_closure(e), _generator(inner, masked)) for e, inner in node[1]]):
                for test, run in arms:
                    if test(names):
                        return run(names)
                return ()
            steps.append(choose)
        else:
            def loop(names, key=node[1], f=_closure(node[2]), run=_generator(node[3], masked)):
                for x in f(names):
                    yield from run({**names, key: x})
            steps.append(loop)

    def run(names: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(names)

    return run


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of ``messages`` and other data that yields (text, under the loss mask)."""
    run = _generator(fold(parse(source)), False)
    return lambda messages, **data: run({**data, "messages": messages})


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, Iterator[dict]]]:
    """(conv_id, its rows) of sorted rows; rows are read as they are asked for."""
    rows = (dict(zip(names, r, strict=True)) for b in pieces(batches) for r in zip(*(b.column(n).to_pylist() for n in names), strict=True))
    row = next(rows, None)
    while row is not None:
        conv = row["conv_id"]

        def own() -> Iterator[dict]:
            nonlocal row
            while row is not None and row["conv_id"] == conv:
                now = row
                row = next(rows, None)
                yield now

        it = own()
        yield conv, it
        for _ in it:
            pass


def format_chats(rows: DataFrame, template: str = TEMPLATE, piece_chars: int = 1 << 16) -> DataFrame:
    """(conv_id, part, formatted, loss): each conversation's output in parts of about ``piece_chars`` code points, in order.

    ``loss`` has [start, stop) pairs of code points of the part. Parts of a conversation come in one task, one after
    the other, so a conversation of any length needs the memory of its longest text.
    """
    bound_batches(rows.sparkSession)
    run = compile_template(template)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], []]
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal columns, held
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                    pa.array(columns[3], pa.list_(pa.list_(pa.int64())))
                ],
                ["conv_id", "part", "formatted", "loss"]
            )
            columns, held = [[], [], [], []], 0
            return out

        for conv, own in _grouped(batches, ["conv_id", "turn", "role", "text"]):
            part, texts, loss, length = 0, [], [], 0

            def close() -> None:
                nonlocal part, texts, loss, length, held
                for column, v in zip(columns, (conv, part, "".join(texts), loss), strict=True):
                    column.append(v)
                held += length + 100
                part, texts, loss, length = part + 1, [], [], 0

            messages = ({"role": m["role"] or "", "text": m["text"] or "", "turn": m["turn"]} for m in own)
            for text, masked in run(messages):
                if masked and text:
                    if loss and loss[-1][1] == length:
                        loss[-1][1] += len(text)
                    else:
                        loss.append([length, length + len(text)])
                texts.append(text)
                length += len(text)
                if length >= piece_chars:
                    close()
                    if held > 1 << 22:
                        yield flush()
            close()
            if held > 1 << 22:
                yield flush()
        if columns[0]:
            yield flush()

    sorted_rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.mapInArrow(render, "conv_id long, part long, formatted string, loss array<array<long>>")


class _Reader:
    """Reads turns back from parts of output of :data:`TEMPLATE`."""

    _MARK = re.compile(r"<\|(?!end\|>)(.*?)\|>\n(.*?)<\|end\|>\n", re.S)

    def __init__(self) -> None:
        self.rest = ""
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.loss_rest = ""

    def feed(self, text: str, loss: list[list[int]]) -> None:
        self.chars += len(text)
        for a, b in loss:
            self.loss(self.loss_rest + text[a:b])
        self.rest += text
        at = 0
        # An unescaped mark can't stand inside a text, so a turn is whole as soon as its end mark is.
        for m in self._MARK.finditer(self.rest):
            if m.start() != at:
                break
            self.turns += 1
            self.hash.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            at = m.end()
        self.rest = self.rest[at:]

    def loss(self, text: str) -> None:
        """Text under the mask; an odd number of last backslashes waits for what follows."""
        tail = len(text) - len(text.rstrip("\\"))
        self.loss_rest = "\\" if tail % 2 else ""
        plain = unescape(text[: len(text) - tail % 2])
        self.loss_chars += len(plain)
        self.loss_hash.update(plain.encode("utf-8", "surrogatepass"))

    def row(self, conv: int | None) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv}: unread output {self.rest[:80]!r}")
        return conv, self.turns, self.hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """Digests by conversation, read from the output of :func:`format_chats` with the default template."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for conv, own in _grouped(batches, ["conv_id", "part", "formatted", "loss"]):
            reader = _Reader()
            for p in own:
                reader.feed(p["formatted"], p["loss"])
            rows.append(reader.row(conv))
            if len(rows) >= 1000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return parts.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: DuckDB SQL of the digests; fixed values of CONTROLS stand in _ESCAPED.
def oracle() -> str:
    esc = lambda c: "replace(" + c + ", '\\', '\\\\')"

    def escaped(c: str) -> str:
        out = esc(c)
        for x in CONTROLS:
            out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
        return out

    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), loss as (
  select conv_id, string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text) as loss,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns, count(*) as n_turns,
    cast(sum(length({escaped("role")}) + length({escaped("text")}) + 13) as bigint) as formatted_chars
  from rows group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from loss
"""
