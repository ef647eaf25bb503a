"""SentencePiece BPE encoding and decoding, exact, by backtracking.

A sequence of tokens is the one that merging yields just if each token merges
back to itself and so does each two neighbours' text. The encoder therefore
takes, at each position, the longest token that an Aho-Corasick automaton has
found there, checks by re-merging that it is compatible with the token before,
falls back to shorter tokens, and steps back where none is left; a bitfield
keeps positions that have failed, so each is left once. Pieces never hold a
space mark after another character, and characters without a piece never merge,
so texts are cut there and frequent stretches are looked up.

Defined results: null is encoded as the empty text, which has the end id only;
repeated rows are encoded one by one; an empty table gives no rows; columns of
the input besides the text are kept unless they have the name of an added one,
which replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import bound_batches, pieces

SPACE = "▁"
#: Stretches and token pairs of one generation of a worker's memory, which has two.
REMEMBERED = 250_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> bytes:
    """The bytes of the public 32k model."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one BPE model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or any(p.type == USER for p in proto.pieces):
            raise ValueError("only BPE models with identity normalisation and no user-defined pieces are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.eos = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        self.unk = proto.trainer_spec.unk_id
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, UNUSED)}
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, UNUSED)}
        self.bytes = [0] * 256 if proto.trainer_spec.byte_fallback else []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.known = {p for p in self.ids if len(p) == 1}
        for p in self.ids:
            if re.search(f"[^{SPACE}]{SPACE}", p):
                raise ValueError("a piece crosses a word's start")
        self.cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        if "\n" in self.known:
            self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # What an id is decoded to: plain text, or None for bytes.
        self.surface = [
            proto.trainer_spec.unk_surface if t == UNKNOWN else "" if t == CONTROL else None if t == BYTE else p.replace(SPACE, " ") for p,
            t in zip(self.pieces, self.types, strict=True)
        ]
        self.value = {i: v for v, i in enumerate(self.bytes)}
        self.stretches = _Memory(self.encode_stretch)
        self.pairs = _Memory(self._compatible)
        self._build()

    def _build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.reachable: dict[str, int] = {}
        # By id: when a token's last merge comes, lower is earlier, with 0 for a character; and that merge's two sides.
        order = {p: k for k, p in enumerate(sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p]), 1)}
        self.turn = [0] * len(self.pieces)
        self.left: list[int] = [-1] * len(self.pieces)
        self.right: list[int] = [-1] * len(self.pieces)
        for p, i in self.ids.items():
            sides = self.merge(p, 2)
            if len(sides) <= 2:
                self.reachable[p] = i
            if len(sides) == 2:
                self.turn[i], self.left[i], self.right[i] = order[p], self.ids[sides[0]], self.ids[sides[1]]
        # By id: whether each merge inside a token comes after those it builds on.
        self.in_turn = [True] * len(self.pieces)
        for p in sorted(self.reachable, key=len):
            i = self.ids[p]
            if len(p) > 1:
                self.in_turn[i] = all(self.in_turn[k] and self.turn[k] <= self.turn[i] for k in (self.left[i], self.right[i]))
        for p in self.reachable:
            self.automaton.add_word(p, (self.ids[p], len(p) - 1))
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in self.pieces]
        # By id: the id of the longest token that begins the token, or -1.
        self.shorter = [-1] * len(self.pieces)
        for p in self.reachable:
            self.shorter[self.ids[p]] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.reachable), -1)

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The pieces, or the last ``least`` parts before, of a short text of known characters by plain merging: highest score first, then leftmost."""
        parts = list(text)
        while True:
            if len(parts) <= least:
                return parts
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, pair: int) -> bool:
        """Whether merging two tokens' text gives the two again.

        It goes through the merges backwards from both tokens: at each moment only the parts that touch matter, and
        they must not have a merge that comes before the one that used one of them up. Where a token's merges are not
        in the order of their scores, the text is merged anew.
        """
        a, b = pair >> 24, pair & 0xFFFFFF
        if not (self.in_turn[a] and self.in_turn[b]):
            return self.merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        pieces, ids, turn = self.pieces, self.reachable, self.turn
        until, last_left = len(pieces) + 1, True  # the merge that made the later of the two parts' successors
        while True:
            both = ids.get(pieces[a] + pieces[b])
            # Of equal pieces the leftmost merges first: the pair goes before a part to its right, not to its left.
            if both is not None and (turn[both] < until or turn[both] == until and not last_left):
                return False
            if not turn[a] and not turn[b]:
                return True
            if turn[a] > turn[b]:
                until, last_left, a = turn[a], True, self.right[a]
            else:
                until, last_left, b = turn[b], False, self.left[b]

    def tokens(self, text: str) -> list[int]:
        """The ids of a text of known characters, by backtracking."""
        n = len(text)
        longest = [-1] * (n + 1)
        for end, (token, before) in self.automaton.iter(text):
            longest[end - before] = token
        failed = 0  # a bit for each position that no tokens lead on from
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        pairs, shorter, lengths = self.pairs, self.shorter, self.lengths
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if not failed >> end & 1 and (last < 0 or pairs[last << 24 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = end, token, longest[end]
            else:
                failed |= 1 << at
                token = shorter[out.pop()]
                at -= lengths[last]
                last = out[-1] if out else -1
        return out

    def encode_stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch between cuts."""
        if self.known.issuperset(text):
            return tuple(self.long_tokens(text))
        out: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.known:
                out += self.long_tokens(text[start:i])
                out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]
                start = i + 1
        out += self.long_tokens(text[start:])
        return tuple(out)

    def long_tokens(self, text: str) -> list[int]:
        """As :meth:`tokens`, over windows of bounded length.

        A window's tokens are kept up to a border that the next window's tokens, begun there, meet compatibly; so all
        neighbours are compatible, which only the right tokens are.
        """
        size, tail = 4096, 1024
        if len(text) <= size:
            return self.tokens(text) if text else []
        out: list[int] = []
        at = 0
        while len(text) - at > size:
            found = self.tokens(text[at : at + size])
            kept, length = 0, 0
            while length + self.lengths[found[kept]] <= size - tail:
                length += self.lengths[found[kept]]
                kept += 1
            more = self.tokens(text[at + length : at + length + size])
            while kept > 1 and not self.pairs[found[kept - 1] << 24 | more[0]]:
                kept -= 1
                length -= self.lengths[found[kept]]
                more = self.tokens(text[at + length : at + length + size])
            out += found[:kept]
            at += length
        return out + self.tokens(text[at:])

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        """All ids of a whole text, with the end id last."""
        out: list[int] = []
        if text:
            marked = ((SPACE if self.prefix else "") + text).replace(" ", SPACE)
            out = list(chain.from_iterable(map(self.stretches.__getitem__, self.cut.findall(marked))))
        if end:
            out.append(self.eos)
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids: bytes are joined as UTF-8, with U+FFFD for each byte of a bad sequence."""
        ids = ids or []
        surface = self.surface
        parts = [surface[i] for i in ids]
        if None in parts:
            k = 0
            while k < len(parts):
                if parts[k] is None:
                    stop = k
                    while stop < len(parts) and parts[stop] is None:
                        stop += 1
                    raw = bytes(self.value[i] for i in ids[k:stop])
                    parts[k:stop] = [_utf8(raw)] + [""] * (stop - k - 1)
                    k = stop
                else:
                    k += 1
        text = "".join(parts)
        if self.prefix:
            # The mark of the first piece that yields text goes.
            for i, p in zip(ids, parts, strict=True):
                if p or self.pieces[i] == SPACE:
                    if self.types[i] not in (BYTE, UNKNOWN, CONTROL) and self.pieces[i].startswith(SPACE):
                        return text[1:]
                    break
        return text


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode("utf-8"))
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


class _Memory(dict):
    """Values of a function. When full it begins anew, but takes over what the last generation still has."""

    def __init__(self, f):
        super().__init__()
        self.f = f
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if isinstance(key, int) or len(key) <= 48:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_CODECS: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per process and model."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _with(df: DataFrame, name: str, kind: T.DataType, source: str, f) -> DataFrame:
    """``df`` with the column ``name`` made from ``source`` by ``f``, which takes and gives an Arrow array."""
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), f(batch.column(source))], [*kept, name])

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))))).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """``docs`` with the array column ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        c = codec(shared.value)
        return _lists([c.encode(t, end) for t in column.to_pylist()])

    return _with(docs, ids, T.ArrayType(T.IntegerType()), text, run)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the string column ``text`` made from ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        c = codec(shared.value)
        return pa.array([c.decode(x) for x in column.to_pylist()], pa.string())

    return _with(docs, text, T.StringType(), ids, run)


def round_trip(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded", end: bool = True) -> DataFrame:
    """``docs`` without ``text`` but with its ids and the text these decode to, in one pass through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (text, ids, decoded)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in pieces(batches):
            rows = [c.encode(t, end) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), _lists(rows), pa.array(map(c.decode, rows), pa.string())], [*kept, ids, decoded]
            )

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Number of ids and digests of ids and decoded text, by document."""
    both = round_trip(docs.select("doc_id", "text"), model)
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256")
    )
