"""Near duplicates by 64-bit SimHash, found through Golay codewords.

Fingerprints link at :data:`MAX_BITS` or fewer differing bits. A fingerprint is
cut into three segments of 22, 21 and 21 bits, each taken as a word of the
perfect binary Golay code of length 23. Two words at distance 2 or less have
some word in the middle at distance 1 or less from both, and the codeword
nearest to that one is at most 4 from each; so the codewords within distance 4
(one or six of them) are the keys of a segment. Of four differing bits over
three segments, the best two segments hold two at most, so any linked pair
shares a composite key (segment pair, codeword, codeword). Pairs of one key are
verified on all 64 bits.

Copies count once: everything past the fingerprints works on distinct
fingerprints. A key's distinct fingerprints are compared in blocks inside the
task and only a spanning forest of their links leaves it, so the rows emitted
stay linear in the input. Keys with more than :data:`RUN_ROWS` fingerprints take
another exact way: every fingerprint is dealt to all words within 2 bits; two
fingerprints share such a word just if they link, and at most 2,081 can share
one.

:func:`similar` asks for more: texts link at a Jaccard similarity of
:data:`SIMILARITY` or more of their sets of :data:`WIDE_SHINGLE`-word shingles.
SimHash can't promise to find such pairs, so they are found exactly. Sets that
share a MinHash are compared with the first that has it, and what links makes
groups. Then each set goes under the shingles of its prefix, rare ones first,
of which two sets that link share one at least; sets under one shingle and in
different groups are compared on their whole sets. A shingle with more such
pairs than :data:`PAIRS` a set deals :data:`PIVOTS` sets at a time against all
others and drops them, until none is left. What is left of such shingles goes
on with the parities of its sets, so only pairs that may link leave a task. Of
too many such pairs a tree of the closest goes first, and of many pairs one for
each set is compared on whole sets first: those that are in one group by then
need no comparison. So a step's rows and the sets that move stay linear where
sets are alike, rounds are few, and no link is lost.

Defined results: null and empty texts have the fingerprint zero and link like
any other; texts under four words are one shingle; repeated rows come back as
often as they went in; rows without an id link like any other but name a
component only by null, where none in it has an id; an empty table gives no
rows; columns besides ``doc_id`` and ``text`` are kept by :func:`keep_one` and
ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import bound_batches, materialize, pieces, written
from curatrix.sources.store import remove

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Segment offsets and widths.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Most distinct fingerprints of a key that are compared with each other.
RUN_ROWS = 4096
#: Words of a shingle and least similarity of :func:`similar`; MinHashes of a set by which groups begin.
WIDE_SHINGLE, SIMILARITY, ROUNDS = 5, 0.8, 4
#: Most pairs that a set of a crowded shingle gives at once, and the sets of such a shingle that are compared with all others.
PAIRS, PIVOTS = 4, 2
#: Times as many such sets in each next round, as long as they give no more pairs of a shingle at once than these.
MORE_PIVOTS, CROWD_PAIRS = 4, 4_000_000
#: Sets of a shingle that are compared with all its others at a time.
BLOCK_ROWS = 64
#: Texts whose shingles are counted for the order of all (any order gives the same links), and cells of that count.
ORDER_TEXTS, ORDER_CELLS = 2048, 1 << 20
#: Least bits of a set that hold the parity of its hashes in as many cells: sets differ in at least as many hashes as bits. Larger
#: sets have the first power of two above three fifths of their size, as few cells would be about half odd whatever the sets.
PARITY_BITS = 1024
#: Bytes of parities that are compared at a time.
PARITY_BYTES = 1 << 21
#: Most links of which one task makes the groups; each round of :func:`components` is a dozen shuffles, however few they are.
GRAPH_ROWS = 500_000
#: Most named sets that are broadcast to the texts.
NAMED_ROWS = 100_000
#: Odd numbers that make further hashes from one hash of a shingle.
ROUND_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Narrow rows of a file of an intermediate table.
FILE_ROWS = 500_000
#: Tasks to which the rows of one key of a join are dealt.
SALTS = 8
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of the shingles of one text, repeats included; of the whole sequence where it has fewer words."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        block = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.nonzero(2 * counts > len(hashes))[0])


def fingerprint(text: str | None) -> int:
    """The SimHash of one text, unsigned."""
    return majority(shingle_hashes(text, SHINGLE))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): h hashes the text, fp is the fingerprint; both are signed 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def salted(large: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """``large`` joined with the one row of ``small`` for its key; rows of a key are dealt to SALTS tasks by a hash of ``by``."""
    many = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(many, [key, "salt"]).drop("salt")


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = word.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def near_errors() -> np.ndarray:
    """For each of the 2,048 syndromes the one or six error words of weight 4 or less, padded with -1."""
    table = np.full((2048, 6), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], dtype=np.int64)
        for s, e in zip(syndrome(errors).tolist(), errors.tolist(), strict=True):
            if weight <= 3 or filled[s]:
                if not (weight == 4 and np.bitwise_count(table[s, 0]) <= 2):
                    table[s, filled[s]] = e
                    filled[s] += 1
    return table


_ERRORS: list[np.ndarray] = []


def errors_table() -> np.ndarray:
    if not _ERRORS:
        _ERRORS.append(near_errors())
    return _ERRORS[0]


def composite_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): the composite keys of unsigned fingerprints and the row each belongs to."""
    lists = []
    for offset, width in SEGMENTS:
        word = (fp >> np.uint64(offset)).astype(np.int64) & ((1 << width) - 1)
        errors = errors_table()[syndrome(word)]
        lists.append(np.where(errors >= 0, (word[:, None] ^ errors) >> 11, -1))
    keys, rows = [], []
    at = np.arange(len(fp))
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        for a in range(6):
            for b in range(6):
                ok = (lists[i][:, a] >= 0) & (lists[j][:, b] >= 0)
                keys.append((pair << 24) | (lists[i][ok, a] << 12) | lists[j][ok, b])
                rows.append(at[ok])
    return np.concatenate(keys), np.concatenate(rows)


def forest(fp: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links that span each component among the distinct fingerprints of one key, compared in blocks."""
    n, step = len(fp), 512
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for s in range(0, n, step):
        near = np.bitwise_count(fp[s : s + step, None] ^ fp[None, :]) <= max_bits
        for x, y in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
            if s + x < y:
                a, b = root(s + x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    left.append(s + x)
                    right.append(y)
    return left, right


def link_sorted(batches: Iterator[pa.RecordBatch], max_bits: int, run_rows: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within the runs of equal keys of rows sorted by (key, fp); a row (fp, null) for each one of a run over ``run_rows``."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], ["a", "b"])

    def closed(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole runs."""
        if len(key) < 2:
            return
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(heads, len(key)))
        size = np.repeat(sizes, sizes)
        left, right = [], []
        for k in range(1, 32):
            at = np.flatnonzero((key[k:] == key[:-k]) & (size[k:] <= 32))
            if not len(at):
                break
            at = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= max_bits]
            left.append(fp[at])
            right.append(fp[at + k])
        for h, n in zip(heads[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
            a, b = forest(fp[h : h + n], max_bits)
            left.append(fp[h : h + n][a])
            right.append(fp[h : h + n][b])
        if left and sum(map(len, left)):
            yield out(np.concatenate(left), np.concatenate(right))

    key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    over: int | None = None  # the key whose run has grown past run_rows
    for batch in batches:
        k = batch.column("key").to_numpy()
        f = batch.column("fp").to_numpy().view(np.uint64)
        if over is not None:
            n = int(np.searchsorted(k, over, side="right"))
            if n:
                yield out(f[:n], None)
            k, f = k[n:], f[n:]
            if not len(k):
                continue
            over = None
        key, fp = np.concatenate((key, k)), np.concatenate((fp, f))
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], side="left"))
        yield from closed(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
        if len(key) > run_rows:
            over = int(key[-1])
            yield out(fp, None)
            key, fp = key[:0], fp[:0]
    yield from closed(key, fp)


def flips(bits: int) -> list[int]:
    """All 64-bit masks with at most ``bits`` bits set, as signed numbers."""
    masks = [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int = MAX_BITS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Links (a, b) that connect just the distinct fingerprints ``fps`` (fp) whose graph of at most ``max_bits`` differing bits connects them."""
    if max_bits > 4:
        raise ValueError("three Golay segments find pairs of up to four differing bits")
    dealt = keyed_rows(fps)
    found = materialize(dealt.mapInArrow(lambda it: link_sorted(it, max_bits, run_rows), "a long, b long").distinct(), "links")
    crowded = found.filter("b is null").select(F.col("a").alias("fp"))
    masks = F.array(*[F.lit(m).cast("long") for m in flips(max_bits // 2)])
    middle = crowded.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("middle"))
    least = middle.groupBy("middle").agg(F.min("fp").alias("first"))
    dense = middle.join(least, "middle").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
    return found.filter("b is not null").unionByName(dense)


def keyed_rows(fps: DataFrame) -> DataFrame:
    """Fingerprints (fp) under their composite keys, sorted within the tasks that hold a key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for s in range(0, len(fp), 2000):
                key, row = composite_keys(fp[s : s + 2000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[s : s + 2000][row])], ["key", "fp"])

    return fps.select("fp").mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")


def parts_for(rows: int) -> int:
    """Files for a number of narrow rows, so that small tables aren't written in as many files as shuffles have partitions."""
    return max(1, -(-rows // FILE_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, roots included, root the least node reachable: alternating large and small stars."""
    edges, folder = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    state, parts = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted(both.filter("b > a"), least, "a", "b").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = salted(large, low, "b", "a")
        small = joined.filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(
            low.select(F.col("m").alias("x"), F.col("b").alias("y"))
        )
        old = folder
        new = small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()
        edges, folder = written(new if parts is None else new.coalesce(parts), "edges")
        remove(edges.sparkSession, old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        state, parts = now, parts_for(now[0])


def spanned(edges: DataFrame, rows: int) -> DataFrame:
    """As :func:`components`, of ``rows`` links: in one task, if they are few."""
    if rows > GRAPH_ROWS:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (list(parent), [root(x) for x in list(parent)])], ["node", "root"])

    return materialize(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "groups")


def _grouped(docs: DataFrame, max_bits: int) -> DataFrame:
    """(doc_id, h, fp, component_id, lead) of every row; lead is the component's first (no id, doc_id, h)."""
    marked = materialize(fingerprints(docs), "fingerprints")
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(lead).alias("lead")), "distinct")
    roots = components(links(firsts, max_bits))
    rooted = materialize(firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", "lead", "root"), "rooted")
    linked = rooted.filter("root is not null")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.min("lead").alias("least"))
    by_fp = salted(linked, lowest, "root", "fp").select("fp", "component_id", F.col("least").alias("lead"))
    by_fp = by_fp.unionByName(rooted.filter("root is null").select("fp", F.col("first").alias("component_id"), "lead"))
    return marked.join(by_fp, "fp").select("doc_id", "h", "fp", "component_id", "lead")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row; the component's id is the smallest doc_id in it."""
    return _grouped(docs, max_bits).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_sets(docs: DataFrame, counts: np.ndarray, size: int, similarity: float) -> DataFrame:
    """(doc_id, h, set, mins, n, parity, prefix): set hashes the set of n shingles, mins are its MinHashes (none of an empty set),
    parity whether an odd number of its hashes falls into each cell, prefix its rarest shingles by ``counts``, of
    which sets that link share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches):
            sets, mins, sizes, parity, prefix = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                own = np.unique(shingle_hashes(t, size))
                sets.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                parity.append(parity_of(own))
                mixed = [own * np.uint64(salt) for salt in ROUND_SALTS[:ROUNDS]] if len(own) else []
                mins.append(np.array([(m ^ (m >> np.uint64(32))).min() for m in mixed], dtype=np.uint64).view(np.int64).tolist())
                most = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
                prefix.append(own[np.lexsort((own, counts[own & np.uint64(ORDER_CELLS - 1)]))[:most]].view(np.int64))
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(np.array(sets, dtype=np.uint64).view(np.int64)), pa.array(mins, pa.list_(pa.int64()))]
            columns += [pa.array(sizes, pa.int32()), pa.array(parity, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "set", "mins", "n", "parity", "prefix"])

    bound_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text"
    ).mapInArrow(run, "doc_id long, h long, set long, mins array<long>, n int, parity binary, prefix array<long>")


def first_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (set, mins): a is the least set that has one of b's MinHashes."""
    rows = nodes.select("set", F.posexplode("mins").alias("band", "low")).select("set", F.xxhash64("band", "low").alias("key"))
    least = rows.groupBy("key").agg(F.min("set").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    return salted(rows, least, "key", "set").filter("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b")).distinct()


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How often shingles fall into each cell, counted over about ORDER_TEXTS texts. It only orders shingles."""
    share = min(1.0, ORDER_TEXTS / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [np.unique(shingle_hashes(t, size)) & np.uint64(ORDER_CELLS - 1) for t in batch.column("text").to_pylist()]
            cells, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.int32).tobytes()], pa.binary()) for v in (cells, n)], ["cells", "n"])

    counts = np.zeros(ORDER_CELLS, dtype=np.int32)
    for row in docs.filter(F.rand(SEED) < share).select("text").mapInArrow(run, "cells binary, n binary").collect():
        counts[np.frombuffer(row["cells"], dtype=np.int32)] += np.frombuffer(row["n"], dtype=np.int32)
    return counts


def prefixes(marked: DataFrame, named: DataFrame) -> DataFrame:
    """(key, set, grp, n, at) of the sets ``named`` (set, grp, n), a row for each shingle of their prefixes in ``marked``; ``at`` is
    the place of the shingle in the order."""
    own = marked.groupBy("set").agg(F.first("prefix").alias("prefix"))  # rows of a set have the same
    return own.join(named, "set").select(F.posexplode("prefix").alias("at", "key"), "set", "grp", "n").select("key", "set", "grp", "n", "at")


def crossing(batches: Iterator[pa.RecordBatch], similarity: float, pivots: int = PIVOTS, closest: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of sets under one key in different groups that may link, of rows (key, set, grp, n, at) sorted by key and set.
    Of a key with too many, the pairs of ``pivots`` sets of different groups, and a row without b for each other set. Rows with a
    ``parity`` give only pairs whose parities let them link; with ``closest``, of a key with too many a tree of the closest, and all
    its sets come back."""
    names = ["key", "set", "grp", "n", "at"]

    def may_link(run: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether the sets ``x`` of a run may link with each. A pair is seen at the first shingle that both have, where what
        follows must be enough; so the test loses no pair."""
        _, _, grp, n, at = (v[x][:, None] for v in run)
        least = similarity / (1 + similarity) * (n + run[3]) - 1e-6
        return (grp != run[2]) & (np.minimum(n - at, run[3] - run[4]) >= least) & (np.minimum(n, run[3]) >= similarity * np.maximum(n, run[3]) - 1e-6)

    def out(run: np.ndarray, x: np.ndarray, y: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        a, b = np.minimum(run[1][x], run[1][y]), np.maximum(run[1][x], run[1][y])
        some = lambda left, more: pa.array(np.concatenate((left, more[rest])))
        none = np.zeros(len(a), dtype=np.int64)
        second = pa.concat_arrays([pa.array(b), pa.nulls(len(rest), pa.int64())])
        return pa.RecordBatch.from_arrays([some(none, run[0]), some(a, run[1]), second, some(none, run[3]), some(none, run[4])], ["key", "a", "b", "n", "at"])

    def closed(rows: np.ndarray, parity: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, grp = rows[0], rows[2]
        if len(key) < 2:
            return
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        mixed = np.minimum.reduceat(grp, heads) != np.maximum.reduceat(grp, heads)
        for s, e in zip(heads[mixed].tolist(), np.append(heads[1:], len(key))[mixed].tolist(), strict=True):
            run = rows[:, s:e]
            once = np.concatenate(([True], run[1, 1:] != run[1, :-1]))  # rows may repeat a set
            run = run[:, once]
            bits = Parities(list(compress(parity[s:e], once)), run[3], similarity) if parity else None
            m, none = run.shape[1], np.zeros(0, dtype=np.int64)
            found, n = [], 0
            for k in range(0, m if m <= RUN_ROWS else 0, BLOCK_ROWS):
                own = np.arange(k, min(k + BLOCK_ROWS, m))
                x, y = np.nonzero(may_link(run, own) & (own[:, None] < np.arange(m)))
                x, y = (own[x], y) if bits is None else bits.may_link(own[x], y)
                found.append((x, y))
                n += len(x)
                if n > PAIRS * m:
                    break
            if m <= RUN_ROWS and n <= PAIRS * m:
                if n:
                    yield out(run, *(np.concatenate(v) for v in zip(*found, strict=True)), none)
                continue
            if closest and bits is not None and m <= RUN_ROWS:
                yield out(run, *bits.tree(run[2]), np.arange(m))
                continue
            first = np.sort(np.unique(run[2], return_index=True)[1][: min(pivots, max(PIVOTS, CROWD_PAIRS // m))])
            for k in range(0, len(first), step := max(1, CROWD_PAIRS // 16 // m)):
                own = first[k : k + step]
                x, y = np.nonzero(may_link(run, own) & ~np.isin(np.arange(m), first[:k]))
                yield out(run, *((own[x], y) if bits is None else bits.may_link(own[x], y)), none)
            yield out(run, none, none, np.setdiff1d(np.arange(m), first))

    held, parity = np.zeros((5, 0), dtype=np.int64), []
    for batch in batches:
        held = np.concatenate((held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])), axis=1)
        parity += batch.column("parity").to_pylist() if "parity" in batch.schema.names else []
        last = int(np.searchsorted(held[0], held[0, -1], side="left")) if held.shape[1] else 0
        yield from closed(held[:, :last], parity[:last])
        held, parity = held[:, last:], parity[last:]
    yield from closed(held, parity)


def parity_of(own: np.ndarray) -> bytes:
    """The parity of a set's hashes in each cell. Half as many cells have the exclusive or of both halves."""
    width = max(PARITY_BITS, 1 << (3 * len(own) // 5).bit_length())
    cells = np.bincount(((own >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


class Parities:
    """Parities of sets of ``n`` shingles, which tell of most pairs that their sets can't have the similarity."""

    def __init__(self, parity: list[bytes], n: np.ndarray, similarity: float) -> None:
        self.parity, self.n, self.share = parity, n, (1 - similarity) / (1 + similarity)
        self.width = np.array([len(v) for v in parity], dtype=np.int64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, place): parities of at least so many bytes folded to them, and the row of each set."""
        if width not in self.levels:
            at = np.flatnonzero(self.width >= width)
            place = np.zeros(len(self.width), dtype=np.int64)
            place[at] = np.arange(len(at))
            rows = [np.bitwise_xor.reduce(np.frombuffer(self.parity[k], dtype=np.uint64).reshape(-1, width // 8), axis=0) for k in at.tolist()]
            self.levels[width] = np.stack(rows), place
        return self.levels[width]

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the sets x and y differ."""
        width, out = np.minimum(self.width[x], self.width[y]), np.zeros(len(x), dtype=np.int64)
        for w in np.unique(width).tolist():
            rows, place = self.level(w)
            which, step = np.flatnonzero(width == w), max(1, PARITY_BYTES // w)
            for k in range(0, len(which), step):
                at = which[k : k + step]
                out[at] = np.bitwise_count(rows[place[x[at]]] ^ rows[place[y[at]]]).sum(axis=1)
        return out

    def test(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the sets x and y differ in no more bits than the similarity lets them differ in shingles; it loses no link."""
        most = self.share * (self.n[x] + self.n[y]) + 1e-6
        return (self.differ(x, y) <= most) & (np.abs(self.n[x] - self.n[y]) <= most)

    def tree(self, grp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that may link, a spanning forest of those that differ least for their size; pairs of a group cost nothing
        and are left out."""
        rest, left, right = np.arange(len(grp)), [], []
        cost, near = np.full(len(grp), np.inf), np.zeros(len(grp), dtype=np.int64)
        while len(rest):
            k = int(np.argmin(cost[rest]))
            x = int(rest[k])
            if 0 <= cost[x] < np.inf:
                left.append(near[x])
                right.append(x)
            rest = np.delete(rest, k)
            own = np.full(len(rest), x)
            most = self.share * (self.n[own] + self.n[rest]) + 1e-6
            now = np.maximum(self.differ(own, rest), np.abs(self.n[own] - self.n[rest])) / most
            now = np.where(grp[rest] == grp[x], -1, np.where(now <= 1, now, np.inf))
            less = now < cost[rest]
            cost[rest[less]], near[rest[less]] = now[less], x
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)

    def may_link(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = self.test(x, y)
        return x[good], y[good]


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose parities differ in no more bits than the similarity lets their sets differ in; it loses no link."""
    one, two = (nodes.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}")) for x in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            parity, n = ([v for c in "ab" for v in batch.column(f"{name}_{c}").to_pylist()] for name in ("parity", "n"))
            at = np.arange(batch.num_rows)
            kept = pa.array(Parities(parity, np.array(n, dtype=np.int64), similarity).test(at, at + batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("a", "b")], ["a", "b"])

    joined = pairs.join(one, "a").join(two, "b")
    return joined.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``named`` (id, h and more) with the texts of the rows of ``docs`` that they name."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash().alias("h"), "text")
    same = F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.h") == F.col("w.h"))
    return rows.alias("r").join(named.alias("w"), same).select("w.*", "text")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets in different groups of ``roots`` (node, root)."""
    group = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(group("a"), "a", "left").join(group("b"), "b", "left")
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def verified(
    roots: DataFrame | None, pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, similarity: float, files: int, tested: bool
) -> DataFrame | None:
    """The groups ``roots`` (node, root; None if there are none yet), joined by those pairs (a, b) of sets whose shingles have at
    least the similarity in common. Only texts in a pair are read again, one for each set; the tables in between are removed.
    ``tested``: the parities let all the pairs link."""
    pairs, pairs_folder = (pairs, None) if tested else written(possible(pairs, nodes, similarity), "possible")
    named = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    wanted, named_folder = written(nodes.join(named, "set").select("set", F.col("lead.doc_id").alias("id"), F.col("lead.h").alias("h")), "named")
    n = wanted.count()
    texts = texts_of(docs, F.broadcast(wanted) if n <= NAMED_ROWS else wanted).select("set", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [np.unique(shingle_hashes(t, size)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(own, pa.binary())], ["set", "own"])

    # Rows that repeat the id and the text give one set several times.
    sets, sets_folder = written(texts.mapInArrow(hashed, "set long, own binary").groupBy("set").agg(F.min("own").alias("own")), "shingles")
    one, two = (sets.select(F.col("set").alias(x), F.col("own").alias(f"own_{x}")) for x in ("a", "b"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            good = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                p, q = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(shared >= similarity * (len(p) + len(q) - shared))
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    def joined(roots: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "own_a", "own_b")
        found = materialize(both.mapInArrow(compared, "a long, b long").repartition(files), "links")
        n = found.count()
        if not n or roots is None:
            return spanned(found, n) if n else roots
        return spanned(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found), n + roots.count())

    if pairs.count() > PAIRS * n:
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        roots = joined(roots, first)
        rest = pairs.join(first, ["a", "b"], "left_anti")
        pairs = rest if roots is None else apart(rest, roots)
    roots = joined(roots, pairs)
    for folder in filter(None, (pairs_folder, named_folder, sets_folder)):
        remove(docs.sparkSession, folder)
    return roots


def set_links(docs: DataFrame, marked: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, root) of every set of ``nodes`` (set, lead, mins, n, parity) with a link, root the least set that links connect it with;
    ``marked`` has their prefixes."""
    files = parts_for(nodes.count())

    def check(roots: DataFrame | None, pairs: DataFrame, name: str, tested: bool = False) -> DataFrame | None:
        pairs, folder = written(pairs.coalesce(files), name)
        out = roots if pairs.isEmpty() else verified(roots, pairs, docs, nodes, size, similarity, files, tested)
        remove(docs.sparkSession, folder)
        return out

    roots = check(None, first_pairs(nodes), "first")
    roots = docs.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots
    grouped = lambda df: df.join(roots, df["set"] == roots["node"], "left").withColumn("grp", F.coalesce("root", "set"))
    rows = prefixes(marked, grouped(nodes).select("set", "grp", "n"))
    folder, pivots = None, PIVOTS
    for turn in count():
        dealt = rows.repartition("key").sortWithinPartitions("key", "set")
        shape = "key long, a long, b long, n long, at long"
        seen, new = written(dealt.mapInArrow(lambda it, n=pivots, first=turn == 1: crossing(it, similarity, n, first), shape), "crossing")
        if folder:
            remove(docs.sparkSession, folder)
        folder = new
        roots = check(roots, seen.filter("b is not null").select("a", "b").distinct(), "pairs", tested=turn > 0)
        rest = seen.filter("b is null").select("key", F.col("a").alias("set"), "n", "at")
        if rest.isEmpty():
            return roots
        rows, pivots = grouped(rest).join(nodes.select("set", "parity"), "set").select("key", "set", "grp", "n", "at", "parity"), pivots * MORE_PIVOTS


def similar(docs: DataFrame, *, size: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, lead) of every row: lead is the first (no_id, doc_id, h) of its group, texts that similarities connect."""
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    marked = materialize(wide_sets(docs, shingle_counts(docs, size), size, similarity), "sets")
    nodes = materialize(marked.groupBy("set").agg(F.min(lead).alias("lead"), F.min("mins").alias("mins"), F.min("n").alias("n"), F.min("parity").alias("parity")), "nodes")
    files = parts_for(nodes.count())
    roots = set_links(docs, marked, nodes, size, similarity)
    rooted = materialize(nodes.join(roots, nodes["set"] == roots["node"], "left").select("set", "lead", "root").coalesce(files), "rooted")
    linked = rooted.filter("root is not null")
    lowest = linked.groupBy("root").agg(F.min("lead").alias("least"))
    by_set = salted(linked, lowest, "root", "set").select("set", F.col("least").alias("lead")).unionByName(rooted.filter("root is null").select("set", "lead"))
    return marked.join(by_set, "set").select("doc_id", "h", "lead")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with the columns of ``docs``: that of the smallest id, or without
    any id of the text that hashes lowest.

    Rows are told apart by id and text, so rows with one id and different texts are kept or dropped each by its own
    component, and rows that repeat both count once.
    """
    return _leading(docs, _grouped(docs, max_bits))


def keep_one_similar(docs: DataFrame, **params) -> DataFrame:
    """As :func:`keep_one`, of the groups of :func:`similar`."""
    return _leading(docs, similar(docs, **params))


def _leading(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead a group, once each."""
    # Ids as texts, so that rows without one join like any other and the last step needs no further shuffle.
    key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("id")
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("h") == F.col("lead.h"))
    kept = groups.filter(leads).select(key(F.col("doc_id")), "h").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), key(F.col("doc_id").cast("long")), text_hash().alias("h"))
    return rows.join(kept, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
