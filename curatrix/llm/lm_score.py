"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of pairs of neighbours are summed over all training
documents, and every one of them, whatever its count and the corpus size, goes
into a Bloom filter: an n-gram of count c is entered once for each level
1 .. 1 + floor(log_b c), so its count is found again, up to a factor, by probing
for level after level until one is missing. The filter grows with the input, so
it is cut into shards by hashes of n-grams, and nothing is broadcast.

Documents are dealt to blocks by hashes. A block sends each shard its distinct
n-grams with their counts in training documents; the shard sums them, builds its
part of the filter and answers each block with the levels found, in the order
asked, and with the exact counts of words. Blocks and shards grow in number with
the input, so neither outgrows a task.

The probability of a word after another interpolates both orders:
``L * c(hw) / c(h) + (1 - L * share(h)) * (c(w) + 1) / (N + V + 1)``,
with all counts from probes, h the end token before the first word, and share(h)
1 for known words, which are always followed by an entered pair, and 0 for
others. Beside it stands the exact base score.

Words are told apart by 64-bit hashes. Defined results: null and empty texts
have the end token only; documents without an id count as training; repeated
rows are scored, and counted, one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import bound_batches, materialize

#: Counts of neighbouring levels differ by this factor.
LEVEL_BASE = 1.5
BITS_PER_ENTRY = 10
PROBES = 7
LAMBDA = 0.8
#: Characters of text to a block and to a shard, and the least number of either.
BLOCK_CHARS, SHARD_CHARS, LEAST_PARTS = 1 << 24, 1 << 25, 32
BLANKS = " \t\n\v\f\r"
#: Salts of words, of pairs, of steps between probes and of shards.
WORD, PAIR, STEP, SHARD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


END = 0xEF46DB3751D8E999  # the hash of the empty word


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct words, the place there of each token, tokens of each text): the words of each text and the end."""
    import xxhash

    none, blank = pa.scalar("", texts.type), pa.scalar(" ", texts.type)
    split = []
    for chunk in texts.chunks:  # one at a time, for memory
        lower = pc.ascii_trim(pc.ascii_lower(pc.fill_null(chunk, none)), BLANKS)
        # The blank behind a text makes an empty word, the end; an empty text is one already.
        split.append(pc.ascii_split_whitespace(pc.if_else(pc.equal(lower, none), lower, pc.binary_join_element_wise(lower, none, blank))))
    sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in split]).astype(np.int64)
    found = pa.chunked_array([x.flatten() for x in split]).dictionary_encode().combine_chunks()
    del split
    words = found.dictionary.cast(pa.large_binary())
    edges, data = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1).tolist(), words.buffers()[2].to_pybytes()
    hashes = np.fromiter((xxhash.xxh64_intdigest(data[i:j]) for i, j in zip(edges, edges[1:], strict=False)), np.uint64, len(words))
    at = found.indices.to_numpy().copy()
    del found, words
    pa.default_memory_pool().release_unused()
    return hashes, at, sizes


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique`` with the inverse. Numbers sort many times faster than positions, so each position replaces the lowest bits of its key."""
    bits = np.uint64(max(len(keys) - 1, 0).bit_length())
    packed = keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= (np.uint64(1) << bits) - np.uint64(1)
    order = packed.view(np.int64)
    ranked = keys[order]
    wrong = ranked[1:] < ranked[:-1]
    if wrong.any():  # among keys that differ in the lowest bits only
        upper = ranked >> bits
        tied = np.flatnonzero(np.isin(upper, upper[1:][wrong]))
        order[tied] = order[tied][np.argsort(ranked[tied])]
        ranked = keys[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(keys), dtype=np.min_scalar_type(-len(keys)))
    at[order] = np.cumsum(first, dtype=at.dtype) - 1
    return ranked[first], at


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(3) + mixed(b ^ np.uint64(PAIR)))


class Filter:
    """A shard of the Bloom filter."""

    def __init__(self, entries: int):
        self.size = max(1024, entries * BITS_PER_ENTRY)
        self.bits = np.zeros(self.size // 8 + 1, dtype=np.uint8)

    def starts(self, key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, step to the next), both before the size is taken off."""
        h = mixed(key + np.uint64(level * 0x9FB21C651E98DF25 % (1 << 64)))
        return h, mixed(h ^ np.uint64(STEP)) | np.uint64(1)

    def enter(self, key: np.ndarray, levels: np.ndarray) -> None:
        """Enter each key under levels 1 .. levels."""
        entered = np.zeros(len(self.bits) * 8, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            h, step = self.starts(key[levels >= level], level)
            for i in range(PROBES):
                at = (h + np.uint64(i) * step) % np.uint64(self.size)
                at.sort()  # memory is written faster in order
                entered[at] = True
        self.bits |= np.packbits(entered, bitorder="little")

    def level(self, key: np.ndarray) -> np.ndarray:
        """The highest level under which each key is found, by probing until one is missing."""
        out = np.zeros(len(key), dtype=np.int64)
        alive, level = np.arange(len(key)), 0
        while len(alive):
            level += 1
            h, step = self.starts(key[alive], level)
            for i in range(PROBES):
                at = (h + np.uint64(i) * step) % np.uint64(self.size)
                there = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                alive, h, step = alive[there], h[there], step[there]
            out[alive] = level
        return out


def count_of(level: np.ndarray) -> np.ndarray:
    """Counts by level: the middle of the level's range, 0 where there is none."""
    level = level.astype(np.float64)
    return np.where(level > 0, (LEVEL_BASE ** (level - 1) + np.maximum(LEVEL_BASE ** (level - 1), LEVEL_BASE**level - 1)) / 2, 0.0)


def levels_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def logs(single: np.ndarray, joint: np.ndarray, history: np.ndarray, norm: float) -> np.ndarray:
    """log10 probabilities of tokens from the counts found of words, of pairs with the words before and of those words."""
    joint = np.minimum(joint, history) / np.maximum(history, 1)
    # Quantised counts may contradict each other: no probability is over 1.
    one = np.minimum(1.0, (single + 1) / norm)
    return np.log10(LAMBDA * joint + (1 - LAMBDA * (history > 0)) * one)


class Block:
    """The tokens of a block of texts and its distinct words and pairs, in the order in which shards are asked."""

    def __init__(self, texts: pa.ChunkedArray, shards: int):
        hashes, at, self.sizes = tokens(texts)
        self.heads = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        after = hashes[at]
        before = np.concatenate(([END], after[:-1])).astype(np.uint64)
        before[self.heads] = END
        words, same = distinct_of(hashes)
        #: Of words and of pairs: (distinct keys, the place there of each token).
        self.words, self.pairs = (words, same[at]), distinct_of(pair_hash(before, after))
        self.shards = shards

    def order(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard of each key, order by shards and then by keys) of sorted keys."""
        # A stable order of short numbers takes no comparisons.
        shard = (mixed(distinct ^ np.uint64(SHARD)) % np.uint64(self.shards)).astype(np.min_scalar_type(self.shards))
        return shard, np.argsort(shard, kind="stable")

    def asked(self, keys: tuple[np.ndarray, np.ndarray], train: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(shard, keys, counts in training documents)."""
        distinct, at = keys
        count = np.bincount(at[train], minlength=len(distinct)).astype(np.uint32)
        shard, order = self.order(distinct)
        distinct, count = distinct[order], count[order]
        edges = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=self.shards))))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            yield k, distinct[edges[k] : edges[k + 1]].tobytes(), count[edges[k] : edges[k + 1]].tobytes()

    def answered(self, keys: tuple[np.ndarray, np.ndarray], answers: np.ndarray) -> np.ndarray:
        """The answer to each token's key from the shards' answers in their order."""
        distinct, at = keys
        if len(answers) != len(distinct):
            raise ValueError(f"{len(answers)} answers to {len(distinct)} n-grams")
        out = np.empty(len(distinct), dtype=answers.dtype)
        out[self.order(distinct)[1]] = answers
        return out[at]


def runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, pa.Table]]:
    """(values of the columns ``by``, the rows that have them) of batches sorted by these."""
    last, held = None, []
    for batch in batches:
        at = 0
        for key, rows in groupby(zip(*(batch.column(c).to_pylist() for c in by), strict=True)):
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            n = sum(1 for _ in rows)
            last, at = key, at + n
            held.append(batch.slice(at - n, n))
    if held:
        yield last, pa.Table.from_batches(held)


ASKED = "block int, shard int, kind int, keys binary, counts binary"
ANSWERED = "block int, shard int, kind int, levels binary, exact binary, n long, v long"


def ask(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """What the blocks of rows (block, held_out, text) sorted by block ask the shards; kind 1: words, 2: pairs."""
    for (number,), rows in runs(batches, "block"):
        block = Block(rows["text"], shards)
        train = np.repeat(~rows["held_out"].to_numpy(), block.sizes)
        out = [(number, shard, kind, k, c) for kind, keys in ((1, block.words), (2, block.pairs)) for shard, k, c in block.asked(keys, train)]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["block", "shard", "kind", "keys", "counts"]
        )


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers to rows sorted by shard and kind; the first of a shard's has its number of training tokens and of words."""
    for (shard, kind), rows in runs(batches, "shard", "kind"):
        of = lambda name, kind, rows=rows: [np.frombuffer(x.as_buffer(), kind) for x in rows[name]]
        rows = list(zip(rows["block"].to_pylist(), of("keys", np.uint64), of("counts", np.uint32), strict=True))
        keys, at = distinct_of(np.concatenate([r[1] for r in rows]))
        count = np.bincount(at, weights=np.concatenate([r[2] for r in rows])).astype(np.int64)
        salted = keys ^ np.uint64(WORD) if kind == 1 else keys
        levels = levels_of(count[count > 0])
        model = Filter(int(levels.sum()))
        model.enter(salted[count > 0], levels)
        level = model.level(salted).astype(np.uint8)
        ends = np.cumsum([len(r[1]) for r in rows])
        parts = [at[e - len(r[1]) : e] for e, r in zip(ends, rows, strict=True)]
        rest = [0] * (len(rows) - 1)
        n, v = ((int(count.sum()), int((count > 0).sum())) if kind == 1 else (0, 0))
        columns = [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([shard] * len(rows), pa.int32()),
            pa.array([kind] * len(rows), pa.int32()),
            pa.array([level[p].tobytes() for p in parts], pa.binary()),
            pa.array([count[p].tobytes() if kind == 1 else None for p in parts], pa.binary()),
            pa.array([n, *rest], pa.int64()),
            pa.array([v, *rest], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "kind", "levels", "exact", "n", "v"])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(batches: Iterator[pa.RecordBatch], shards: int, n: int, v: int) -> Iterator[pa.RecordBatch]:
    """The scores of blocks from their documents (kind 0) and answers, sorted by block, kind and shard."""
    norm = float(n + v + 1)
    counts = count_of(np.arange(256))
    for _, parts in groupby(runs(batches, "block", "kind"), lambda x: x[0][0]):
        docs, words, pairs = (rows for _, rows in parts)
        block = Block(docs["text"], shards)
        whole = lambda rows, name, kind: np.frombuffer(b"".join(x.as_buffer() for x in rows[name]), kind)
        exact = block.answered(block.words, whole(words, "exact", np.int64))
        single = counts[block.answered(block.words, whole(words, "levels", np.uint8))]
        joint = counts[block.answered(block.pairs, whole(pairs, "levels", np.uint8))]
        history = np.concatenate(([0.0], single[:-1]))
        # Every text ends with the end token, which also stands before its first word.
        history[block.heads] = single[block.heads + block.sizes - 1]
        joint[single == 0] = 0
        total = lambda x: np.add.reduceat(x, block.heads)
        columns = [
            docs["doc_id"].combine_chunks(),
            docs["held_out"].combine_chunks(),
            pa.array(block.sizes),
            pa.array(total((exact > 0).astype(np.int64))),
            pa.array(np.full(len(docs), n, dtype=np.int64)),
            pa.array(total(np.log10((exact + 1) / norm))),
            pa.array(total(logs(single, joint, history, norm))),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks, shards = (max(LEAST_PARTS, -(-chars // size)) for size in (BLOCK_CHARS, SHARD_CHARS))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = docs.select("block", "held_out", "text").repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(lambda it: ask(it, shards), ASKED)
    asked = asked.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    answers = materialize(asked.mapInArrow(answer, ANSWERED), "answers")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    rows = docs.withColumns({"kind": F.lit(0), "shard": F.lit(0)}).unionByName(answers.drop("n", "v"), allowMissingColumns=True)
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "kind", "shard")
    return rows.mapInArrow(lambda it: scored(it, shards, int(n), int(v)), SCORED)
