"""N-gram Jaccard join by token-combination prefixes (operator 10).

A document's set holds hashes (64 bits) of its distinct word shingles. Two documents link when the Jaccard
similarity of their sets reaches the threshold; components are what links connect. The nodes of the join are
distinct sets (named by 64 bits of their digest), so exact copies, however many, are one node.

Candidates. All tokens (shingles) get one global order: rare ones, then common ones, then those that stand
out, by counts of hashed buckets over all documents (a fixed number of buckets, so the table may be
broadcast). If two sets reach the threshold, their first shared token lies in the first n - ceil(t * n) + 1
tokens of each. If it is rare, they meet at that single token. If not, they share no rare token, and of the
tokens of its class they differ in at most h, the largest symmetric difference that the threshold allows. So
the prefix is extended to all tokens of the class and cut into G > h ranges of the order: a key is the
combination of all tokens of a set in one range. At least G - h ranges agree, and one of them isn't empty
unless the class has few tokens in both sets, which then also index single tokens. Tokens that collisions
make look common only become part of a combination, so a full table costs selectivity nowhere. Keys carry
the size class (steps of the square root of 2); a set is indexed in its own class and in the next one if a
partner within the threshold could lie there.

Links. Buckets (nodes of one key) of up to SMALL nodes become pairs. In a larger one all nodes are compared
with one pivot, the node that is most central (shares most with others). That connects groups of near
copies. Buckets of up to LATER nodes that aren't in one component by then are compared inside a task, by parity bits (an exact
bound of the difference of two sets, a few dozen bytes a set): only pairs that these leave open, first so many as could connect
them, become rows and are confirmed. What is left of a bucket of more nodes is indexed anew relative to the pivot: with D = set xor
pivot, two sets differ by as much as their Ds do, and what the whole bucket shares is gone from the Ds. Prefixes of the Ds, tokens
outside the pivot first, are the keys of the next level, and so on; after level LAST a task compares what is left of a bucket, however large. Pairs of small buckets are ruled out in the same way before sets are read. Components come from alternating
large-star and small-star steps over Spark tables.

Defined results: null text or text without words: no set, linked with nothing, its own component. Texts of
fewer words than a shingle: one shingle of the whole sequence. Rows with a null doc_id take part by their text;
the component_id of a group is its smallest doc_id that is not null, else null. Repeated doc_ids are rows of
their own. Extra columns are ignored by components and carried along by keep_first.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare, work_folder
from .textvec import batches, mix

#: The operator's defaults; op10_ngram_jaccard passes those of its contract.
WORDS, PERCENT = 5, 80
BUCKETS, CHUNKS = 1 << 20, 64
#: Bits of the table of documents whose sets are read, and rows of it that a task packs.
BITS, PARTS = 1 << 26, 256
#: Occurrences in a bucket of tokens that count as rare; standard deviations above the mean of those that stand out.
RARE, OUT = 8, 6
#: Size classes: powers of this.
STEP_UP = 2**0.5
TOPS = np.unique(np.floor(STEP_UP ** np.arange(2, 90) + 1e-9).astype(np.int64))
#: Nodes of a bucket up to which its pairs become rows at the first level, and up to which they are compared inside a task at later ones; the level after which that is done with buckets of any size.
SMALL, LATER, LAST = 6, 4096, 12
#: Nodes that may be met by a broadcast: each has at least one in HOT of all rows.
HOT = 4096
#: Bytes of text whose shingles a task computes at once.
VECTOR = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = 0x5851F42D4C957F2D


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(b):
        return [np.zeros(0, np.uint64)] * len(column)
    inside = ~SPACE[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(b)]
    first[begins] |= inside[begins]
    at = np.flatnonzero(inside)
    start = np.flatnonzero(first)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(column)
    rank = np.searchsorted(at, start)
    size = np.diff(np.append(rank, len(at)))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), STEP, np.uint64))
        place = np.arange(len(at)) - np.repeat(rank, size)
        word = mix(np.add.reduceat(BYTE[LOWER[b[at]]] * power[place], rank) + size.astype(np.uint64))
        bounds = np.searchsorted(start, offsets)
        h = np.zeros(len(word), np.uint64)
        for k in range(words):
            h[: len(word) - k] += word[k:] * np.uint64(STEP * (2 * k + 1) & (1 << 64) - 1)
        h = mix(h)
        out = []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if z - a >= words:
                s = h[a : z - words + 1].copy()
                s.sort()
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif z > a:
                few = word[a:z] * (np.uint64(STEP) * (2 * np.arange(z - a, dtype=np.uint64) + np.uint64(1)))
                out.append(mix(np.array([few.sum(dtype=np.uint64) + np.uint64(0x51ED270B * (z - a))], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def texts_of(iterator):
    """Tables of at most VECTOR bytes of text (but for one long text), with the texts as one array."""
    for held in batches(lambda b: b.column("text"), iterator, VECTOR):
        t = pa.Table.from_batches(held).combine_chunks()
        text = t.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        yield t, text


def node_of(s: np.ndarray) -> int:
    """64 bits of the set's digest, as a signed number."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens falls into bucket i; about as many buckets as tokens."""
    size = 1 << min(16, max(8, (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of how many tokens only one of two sets has: the buckets whose parity differs."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def survey(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One pass: a row for each document (doc_id, mark, n, node, parity bits) and, of each task, CHUNKS rows of token counts by bucket."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(iterator):
        total = np.zeros(BUCKETS, np.int64)
        for t, text in texts_of(iterator):
            sets = shingle_sets(text, words)
            if len(sets):
                total += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
            columns = [[None] * len(sets), t.column("doc_id"), t.column("mark"), [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets], [parity(s) if len(s) else None for s in sets]]
            yield pa.record_batch([c.combine_chunks().cast(k) if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "doc_id", "mark", "n", "node", "bits"])
        if total.any():
            yield chunk_rows(total)

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "chunk int, doc_id long, mark long, n long, node long, bits binary")


def chunk_rows(total: np.ndarray) -> pa.RecordBatch:
    packed = [zlib.compress(c.astype("<i8").tobytes(), 1) for c in np.split(total, CHUNKS)]
    none = pa.nulls(CHUNKS, pa.int64())
    return pa.record_batch([pa.array(np.arange(CHUNKS, dtype=np.int32)), none, none, none, none, pa.array(packed, pa.binary())], ["chunk", "doc_id", "mark", "n", "node", "bits"])


def token_classes(surveyed: DataFrame) -> np.ndarray:
    """Class of each bucket: 0 rare, 2 if its count stands out from the mean, else 1.

    Counts of tasks are summed within partitions, then by chunk; what the driver gets has a fixed size.
    """

    def within(iterator):
        total = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.int64)
        for b in iterator:
            for k, data in zip(b.column("chunk").to_pylist(), b.column("bits").to_pylist(), strict=True):
                total[k] += np.frombuffer(zlib.decompress(data), "<i8")
        if total.any():
            yield chunk_rows(total.ravel())

    def across(key, frame):
        total = sum(np.frombuffer(zlib.decompress(d.as_py()), "<i8") for d in frame.column("bits"))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = surveyed.where("chunk is not null").mapInArrow(within, surveyed.schema).groupBy("chunk").applyInArrow(across, "chunk int, bits binary").collect()
    total = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.int64)
    for r in rows:
        total[r.chunk] = np.frombuffer(zlib.decompress(r.bits), "<i8")
    total = total.ravel()
    mean = float(np.median(total))
    return np.where(total <= RARE, 0, np.where(total > mean + OUT * np.sqrt(mean) + 4, 2, 1)).astype(np.uint8)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(TOPS, n)


def keys_of(v: np.ndarray, n: np.ndarray, classes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of sets (their tokens one after the other, their sizes): key, set, and whether of tokens that stand out."""
    n = n.astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    least = (percent * n + 99) // 100  # overlap with the smallest partner
    partner = n * 100 // np.maximum(1, percent)
    kind = classes[(v >> np.uint64(44)).astype(np.int64)]
    rare, common = (np.bincount(doc[kind == k], minlength=len(n)) for k in (0, 1))
    out = []
    with np.errstate(over="ignore"):
        for slot in range(int((size_class(partner) - size_class(n)).max(initial=0)) + 1):
            z = size_class(n) + slot
            here = (n * 100 >= percent * (n + 1)) & (z <= size_class(partner))  # else only an equal set reaches the threshold
            most = (100 - percent) * 2 * TOPS[z] // (100 + percent)
            ranges = most + 2 + most // 16
            mark = mix(z.astype(np.uint64) + np.uint64(11))
            for k, use, before in ((0, here & (rare > 0), 0), (1, here & (rare <= n - least), rare), (2, here & (n - rare - common >= least), rare + common)):
                at = np.flatnonzero((kind == k) & use[doc])
                d, x = doc[at], v[at]
                has = np.bincount(d, minlength=len(n))
                single = np.arange(len(at)) - (np.cumsum(has) - has)[d] < (n - least + 1 - before)[d]  # in the first prefix
                if k:
                    at_range = ((x >> np.uint64(32)) * ranges[d].astype(np.uint64)) >> np.uint64(32)
                    edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (at_range[1:] != at_range[:-1])])) if len(at) else at
                    if len(edge):
                        out.append((mix(np.add.reduceat(mix(x), edge) + mix(at_range[edge] + mark[d[edge]]) + np.uint64(k)), d[edge], np.full(len(edge), k == 2)))
                    filled = np.bincount(d[edge], minlength=len(n))
                    single &= (filled <= most)[d]  # too few ranges with tokens to be sure of a meeting
                out.append((mix(x[single] + mark[d[single]]), d[single], np.full(int(single.sum()), k == 2)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def index(docs: DataFrame, classes: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (key, node, hot), of each set once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(iterator):
        seen = set()
        for _, text in texts_of(iterator):
            sets, nodes = [], []
            for s in shingle_sets(text, words):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    sets.append(s)
                    nodes.append(node)
            if sets:
                key, at, hot = keys_of(np.concatenate(sets), np.array([len(s) for s in sets]), shared.value, percent)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.array(nodes, np.int64)[at]), pa.array(hot)], ["key", "node", "hot"])

    return docs.select("text").mapInArrow(run, "key long, node long, hot boolean")


def shared_keys(keys: DataFrame) -> DataFrame:
    """Rows (key, node), once each, of keys that several nodes have. They are met in sorted order, row by row; those of tokens that stand out, which may be many of one key, combine before they are shuffled and are counted later."""

    def run(iterator):
        held, last, open_key = None, None, None  # a first row of its key; the last row; the key of rows given out
        for b in iterator:
            k, node = b.column("key").to_numpy(), b.column("node").to_numpy()
            if not len(k):
                continue
            if held:
                k, node = np.append(held[0], k), np.append(held[1], node)
            fresh = np.append(held is not None or (k[0], node[0]) != last, (k[1:] != k[:-1]) | (node[1:] != node[:-1]))
            last = (k[-1], node[-1])
            k, node, held = k[fresh], node[fresh], None
            if not len(k):
                continue
            same = k[1:] == k[:-1]
            many = np.append(k[0] == open_key, same) | np.append(same, False)
            if many[-1]:
                open_key = k[-1]
            else:
                held = (k[-1], node[-1])
            yield pa.record_batch([pa.array(k[many]), pa.array(node[many])], ["key", "node"])

    found = keys.where("not hot").select("key", "node").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")
    return found.unionByName(keys.where("hot").select("key", "node").distinct())


def connected(edges: DataFrame, folder: str, limit: int = 40) -> DataFrame:
    """(node, root): the smallest node of each component; edges (a, b). Nodes without edges are left out.

    Alternates large-star and small-star until only stars are left; hubs are grouped by a combining min.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    for k in range(1, limit):
        # Large star: every neighbour above a node goes to the node's smallest neighbour (or itself).
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = keep(small, f"{folder}/{k}")
        now = after
        # Done when every node has one root and no root has a root.
        if now.groupBy("a").count().where("count > 1").isEmpty() and now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components didn't settle in {limit} rounds")


def possible(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that sizes and the bound of apart() don't rule out: a few hundred bytes a set tell most apart."""

    def run(iterator):
        for t in iterator:
            ok = [(100 + percent) * apart(x, y) <= (100 - percent) * n for x, y, n in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), t.column("n").to_pylist(), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("na")), "a")
    full = left.join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("nb")), "b")
    full = full.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return full.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(run, "a long, b long")


def bucket_pairs(n: np.ndarray, bits: list[bytes], root: np.ndarray, hub: np.ndarray, most: int | None, percent: int) -> tuple[np.ndarray, bool]:
    """Pairs of a bucket's nodes, sorted by n, of different roots and hubs that sizes and parity bits don't rule out, and whether these are all: if there are more
    than `most`, only a forest that connects what they connect."""
    width = np.array([len(x) for x in bits])
    folded = {}
    for w in np.unique(width).tolist():
        wide = np.flatnonzero(width >= w)
        rows = [np.frombuffer(bits[i], np.uint8).reshape(-1, w) for i in wide]
        folded[w] = wide, np.array([np.bitwise_xor.reduce(x, axis=0) for x in rows])
    last = np.searchsorted(n, n * 100 // percent, side="right")
    group, forest = np.arange(len(n)), False
    out, many = [np.zeros((0, 2), np.int64)], 0
    for i in range(len(n) - 1):
        index, m = folded[int(width[i])]
        at = int(np.searchsorted(index, i))
        k = np.arange(at + 1, int(np.searchsorted(index, last[i])))
        j = index[k]
        ok = (root[j] != root[i]) & (hub[j] != hub[i])
        if forest:
            ok &= group[j] != group[i]
        j, k = j[ok], k[ok]
        if len(j):
            least = np.bitwise_count(m[k] ^ m[at]).sum(1, dtype=np.int64)
            j = j[(100 + percent) * least <= (100 - percent) * (n[i] + n[j])]
            if len(j):
                if forest:
                    j = j[np.unique(group[j], return_index=True)[1]]
                out.append(np.stack([np.full(len(j), i), j], 1))
                many += len(j)
                group[np.isin(group, group[j])] = group[i]
                forest = most is not None and many > most  # from here on only what connects groups of pairs so far
    return np.concatenate(out).T, not forest


def within_buckets(few: DataFrame, all_pairs: bool, percent: int = PERCENT, bits_from: int = 0) -> DataFrame:
    """Pairs (key, a, b) of buckets (key, node, n, bits, root, hub), compared by parity bits inside a task: only pairs that these leave open become rows.

    Of a bucket with more than 8 of them a node, unless all_pairs, just so many as connect it, and a row without a and b.
    """

    def compare(key, t):
        t = t.sort_by([("n", "ascending"), ("node", "ascending")])
        node, n, root, hub = (t.column(c).to_numpy() for c in ("node", "n", "root", "hub"))
        (i, j), whole = bucket_pairs(n, [x[bits_from:] for x in t.column("bits").to_pylist()], root, hub, None if all_pairs else 8 * len(n), percent)
        a, b = np.minimum(node[i], node[j]).tolist(), np.maximum(node[i], node[j]).tolist()
        if not whole:
            a, b = [*a, None], [*b, None]
        return pa.table({"key": pa.array([key[0].as_py()] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    mixed = few.join(few.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "key", "left_semi")
    return mixed.groupBy("key").applyInArrow(compare, "key long, a long, b long")


def _overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which tokens of x are in y; both sorted."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


def relative_keys(x: np.ndarray, p: np.ndarray, pivot: int, percent: int = PERCENT) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether x links with the pivot p, and the keys of x relative to it: those for two sets that don't link with p, and those for one that does and one that doesn't.

    D is x xor p, the added tokens (outside p) first. c = (1 - t) / (1 + t), so that sets link if they differ by at most c
    times the sum of their sizes. Two sets that both don't link with p share more than (|D| + c * (|p| - |x|)) / 2 tokens of
    their Ds, and at least |D| - h; a set that does (with the D of size d) and one that doesn't share more than
    d * (1 - c) / 2 and at least |D| - h, where h is c times the largest sum of sizes. If such two share no added token,
    they differ by all of these and by at least as much as their numbers of removed tokens do; with the other set not
    linked with p, that is too much unless a set has more removed tokens than added ones. So only such a set meets
    others by removed tokens, whose number in a group of copies may be large.
    """
    common = _overlap(x, p)
    both = int(common.sum())
    link = 100 * both >= percent * (len(x) + len(p) - both)
    d = np.concatenate([x[~common], p[~_overlap(p, x)]])
    n, added, below, above = len(d), len(x) - both, 100 - percent, 100 + percent
    shrunk = n > 2 * added
    mark = [mix(mix(np.array([pivot], np.int64).view(np.uint64)) + np.uint64(k)) for k in (1, 2)]
    with np.errstate(over="ignore"):
        if link:
            return True, np.zeros(0, np.uint64), mix(d[: min(n - n * percent // above, n if shrunk else added)] + mark[1])
        far = max(1, n - below * len(x) // percent)
        near = max(far, (n * above + below * (len(p) - len(x))) // (2 * above) + 1)
        return False, mix(d[: min(n - near + 1, n if shrunk else added)] + mark[0]), mix(d[: n - far + 1] + mark[1])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, x, y: first the sets of b (the pivots), which few rows are shuffled for, then those of a."""
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")
    return left.join(sets.select(F.col("node").alias("a"), F.col("data").alias("x")), "a").select("a", "b", "x", "y")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""

    def run(iterator):
        for t in iterator:
            ok = []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                x, y = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                both = int(_overlap(x, y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def against_pivots(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each pair (a, its pivot b): link, and the keys of a relative to b."""

    def lists(arrays):
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))

    def run(iterator):
        for t in iterator:
            got = [relative_keys(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), b, percent) for x, y, b in zip(t.column("x"), t.column("y"), t.column("b").to_pylist(), strict=True)]
            yield pa.record_batch([t.column("a"), t.column("b"), pa.array([g[0] for g in got], pa.bool_()), lists([g[1] for g in got]), lists([g[2] for g in got])], ["a", "b", "link", "alike", "across"])

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long, link boolean, alike array<long>, across array<long>")


def bit_table(ids: DataFrame) -> np.ndarray:
    """A packed table of BITS bits with those of the hashes of doc_id set. Tasks pack parts of it; the driver gets BITS / 8 bytes at most."""
    width = BITS // PARTS

    def pack(key, frame):
        part = np.zeros(width, np.uint8)
        part[frame.column("h").to_numpy() % width] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())})

    hashed = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("h")).distinct()  # at most as many of a part as it has bits
    table = np.zeros((PARTS, width // 8), np.uint8)
    for r in hashed.select((F.col("h") / width).cast("int").alias("part"), "h").groupBy("part").applyInArrow(pack, "part int, data binary").collect():
        table[r.part] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return table.ravel()


def set_rows(docs: DataFrame, table: np.ndarray, words: int = WORDS) -> DataFrame:
    """node and set of the documents in the bit table, so that texts needn't be shuffled; of each set once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(iterator):
        seen = set()
        for b in iterator:
            h = b.column("h").to_numpy()
            t = b.filter(pa.array((shared.value[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1))
            if t.num_rows:
                for _, text in texts_of([t]):
                    new = {node: s for s in shingle_sets(text, words) if len(s) and (node := node_of(s)) not in seen}
                    seen.update(new)
                    yield pa.record_batch([pa.array(list(new), pa.int64()), pa.array([s.tobytes() for s in new.values()], pa.binary())], ["node", "data"])

    return docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("h")).mapInArrow(run, "node long, data binary")


def merged(roots: DataFrame | None, new: DataFrame, folder: str) -> DataFrame:
    """roots (node, root) after the links (a, b) of new: only components that links touch are connected anew."""
    if roots is None:
        return connected(new, folder)
    root_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    root_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    lifted = new.join(root_a, "a", "left").join(root_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = connected(lifted, folder)
    out = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = moved.join(roots, "node", "left_anti")
    return keep(out.unionByName(alone), f"{folder}/all")


def placed(rows: DataFrame, roots: DataFrame | None, name: str = "node", root: str = "root") -> DataFrame:
    """rows with the root of the node in column name; a node without links is its own."""
    if roots is None:
        return rows.withColumn(root, F.col(name))
    return rows.join(roots.select(F.col("node").alias(name), F.col("root").alias("_r")), name, "left").withColumn(root, F.coalesce("_r", name)).drop("_r")


def node_rows(seen: DataFrame) -> DataFrame:
    """node, n, bits and a doc_id of each distinct set."""
    return seen.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), F.min("doc_id").alias("doc_id"))


def node_roots(docs: DataFrame, nodes: DataFrame, keys: DataFrame, folder: str, words: int, percent: int, say, rule_out=possible, bits_from: int = 0, again: int = LATER) -> DataFrame | None:
    """(node, root) of all nodes that have links; None if there are none. keys: (key, node) rows in which partners meet; rule_out: the filter of pairs of small buckets;
    bits_from: where the parity bits begin in bits; again: nodes of all large buckets of one pivot up to which they are met again at once after the first level, and beyond which
    by keys relative to the pivot (0: always so)."""
    members = keep(keys, f"{folder}/members")
    roots = sets = None
    level = 0

    def linked(roots, pairs, new, name):
        """roots after the links among pairs and those of new."""
        close = keep(pairs, f"{folder}/close-{name}")
        if not close.isEmpty():
            links = keep(verified(close, sets, percent), f"{folder}/links-{name}")
            say("close pairs", close.count, "links", links.count)
            new = links if new is None else new.unionByName(links)
        return roots if new is None or new.isEmpty() else keep(merged(roots, new, f"{folder}/merge-{name}"), f"{folder}/roots-{name}")

    while True:
        level += 1
        size = placed(members, roots).groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
        alive = keep(members.join(size, "key"), f"{folder}/alive-{level}")
        if alive.isEmpty():
            return roots
        if sets is None:
            need = nodes.join(alive.select("node").distinct(), "node")
            need = keep(need, f"{folder}/need")
            sets = keep(set_rows(docs, bit_table(need), words).join(need.select("node"), "node", "left_semi").dropDuplicates(["node"]), f"{folder}/sets")
            nodes = need
        small = F.lit(True) if level > LAST else F.col("size") <= (SMALL if level == 1 else LATER)
        large, members = alive.where(~small), None
        say("level", level, "rows", alive.count, "of large buckets", large.count)
        new = got = near = None
        if not large.isEmpty():
            # The pivot of a bucket shares most with others: the sizes of all its buckets add up to the largest sum.
            score = large.groupBy("node").agg(F.sum("size").alias("score"))
            pivot = large.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("b"))
            pairs = keep(large.join(pivot, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), f"{folder}/pivots-{level}")
            huge = pairs
            if again:
                # At most one pivot in `again` pairs has too many others.
                over = F.broadcast(keep(pairs.groupBy("b").agg(F.count("*").alias("others")).where(F.col("others") >= again).select("b"), f"{folder}/over-{level}"))
                near, huge = pairs.join(over, "b", "left_anti"), pairs.join(over, "b", "left_semi")
                new = keep(verified(near.select("a", "b"), sets, percent), f"{folder}/pivot-links-{level}")
            if not huge.isEmpty():
                got = keep(against_pivots(huge.select("a", "b"), sets, percent), f"{folder}/relative-{level}")
                linking = got.where("link").select("a", "b")
                new = linking if new is None else new.unionByName(linking)
            say("pivot pairs", pairs.count, "links", new.count)
        # Two nodes that link with one pivot needn't be compared.
        hub = None if new is None else new.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        few = alive.where(small).select("key", "node")
        if level == 1:
            few = placed(placed(few, roots), hub, root="hub")
            left, right = (few.select("key", F.col("node").alias(x), F.col("root").alias(f"r{x}"), F.col("hub").alias(f"h{x}")) for x in "ab")
            pairs = left.join(right, "key").where("a < b and ra <> rb and ha <> hb").select("a", "b").distinct()
            roots = linked(roots, rule_out(pairs, nodes, percent), new, f"{level}")
        else:
            # Crowded buckets first give so many pairs as could connect what parity bits leave open, then all that are still of different components.
            bits = keep(few.join(nodes.select("node", "n", "bits"), "node"), f"{folder}/few-{level}")
            open_pairs = keep(within_buckets(placed(placed(bits, roots), hub, root="hub"), False, percent, bits_from), f"{folder}/open-{level}")
            roots = linked(roots, open_pairs.where("a is not null").select("a", "b").distinct(), new, f"{level}-first")
            crowded = open_pairs.where("a is null").select("key").distinct()
            if not crowded.isEmpty():
                rest = placed(bits.join(crowded, "key", "left_semi"), roots).withColumn("hub", F.col("root"))
                roots = linked(roots, within_buckets(rest, True, percent, bits_from).select("a", "b").distinct(), None, f"{level}-rest")
        if level == 1 and near is not None:
            # The nodes of all buckets of a pivot are met again at once, so that two of them meet once and not in each bucket that they share.
            members = near.select(F.col("b").alias("key"), F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("key"), F.col("b").alias("node")).distinct())
        if got is not None:
            # Groups of one pivot that are in one component by now are done.
            ends = placed(placed(got.select("a", "b"), roots, "a", "ra"), roots, "b", "rb")
            open_groups = ends.groupBy("b").agg(F.min(F.least("ra", "rb")).alias("lo"), F.max(F.greatest("ra", "rb")).alias("hi")).where("lo < hi").select("b")
            left = got.join(open_groups, "b", "left_semi")
            alike = left.select(F.col("a").alias("node"), F.explode("alike").alias("key"), F.lit(None).cast("boolean").alias("link"))
            keys = alike.unionByName(left.select(F.col("a").alias("node"), F.explode("across").alias("key"), "link"))
            met = keys.groupBy("key").agg(F.count("*").alias("k"), F.min("link").alias("lo"), F.max("link").alias("hi")).where("k > 1 and (lo is null or lo <> hi)").select("key")
            more = keep(keys.join(met, "key").select("key", "node").distinct(), f"{folder}/members-{level}")
            members = more if members is None else members.unionByName(more)
        if members is None:
            return roots


def _grouped(docs: DataFrame, words: int, percent: int, trace=None) -> DataFrame:
    """doc_id, mark (hash of the text), n and the first (doc_id, mark) of its component, of every row of docs."""
    spark = prepare(docs.sparkSession)
    folder = work_folder(spark, "jaccard")
    seen = keep(survey(docs, words), f"{folder}/survey")
    keys = shared_keys(index(docs, token_classes(seen), words, percent))
    roots = node_roots(docs, node_rows(seen), keys, folder, words, percent, trace or (lambda *a: None))
    return rooted(seen.where("chunk is null").select("doc_id", "mark", "n", "node"), roots, folder)


def rooted(rows: DataFrame, roots: DataFrame | None, folder: str) -> DataFrame:
    """rows (doc_id, mark, n, node) with the first (doc_id, mark) of their component."""
    # One row for each node, whose first document is found by a combining minimum; then one for each root.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    each = placed(rows.where("n > 0").groupBy("node").agg(first.alias("f"), F.count("*").alias("k")), roots)
    each = keep(each, f"{folder}/nodes")
    top = each.groupBy("root").agg(F.min("f").alias("f"))
    table = keep(each.select("node", "root", "k").join(top, "root").select("node", "k", F.col("f.doc_id").alias("top_id"), F.col("f.mark").alias("top_mark")), f"{folder}/top")
    # Nodes of so many rows that there can't be more than HOT of them are met by a broadcast, the others by a shuffle.
    bound = max(1000, rows.count() // HOT)
    hot = F.broadcast(table.where(F.col("k") >= bound).drop("k"))
    cold = table.where(F.col("k") < bound).drop("k")
    flagged = rows.where("n > 0").join(hot.withColumn("is_hot", F.lit(True)), "node", "left")
    columns = ["doc_id", "mark", "n", "top_id", "top_mark"]
    met = flagged.where("is_hot").select(columns)
    rest = flagged.where("is_hot is null").select("doc_id", "mark", "n", "node").join(cold, "node").select(columns)
    alone = rows.where("n = 0").select("doc_id", "mark", "n", F.col("doc_id").alias("top_id"), F.col("mark").alias("top_mark"))
    return met.unionByName(rest).unionByName(alone)


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trace=None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return _grouped(docs, words, percent, trace).select("doc_id", F.col("n").alias("n_shingles"), F.col("top_id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the row with the smallest doc_id (of rows that share it,
    the one whose text has the smaller hash, once), and all rows without words.

    Rows that go are few and named by (doc_id, hash of the text), so rows of one id with different texts are told apart.
    """
    got = keep(_grouped(docs, words, percent), work_folder(docs.sparkSession, "jaccard-groups"))
    same = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("mark") == F.col("top_mark"))
    names = [F.col("doc_id").alias("_d"), F.col("mark").alias("_m")]
    drop = got.where((F.col("n") > 0) & ~same).select(*names).distinct()
    again = got.where((F.col("n") > 0) & same).groupBy(*names).agg(F.count("*").alias("k")).where("k > 1").select("_d", "_m")
    marked = docs.withColumn("mark of it", F.xxhash64("text"))

    def on(right: DataFrame):
        return marked["doc_id"].eqNullSafe(right["_d"]) & (marked["mark of it"] == right["_m"])

    if again.isEmpty():
        return marked.join(drop, on(drop), "left_anti").select(docs.columns)
    both = drop.unionByName(again)
    out = marked.join(both, on(both), "left_anti").select(docs.columns)
    once = marked.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "mark of it"]).select(docs.columns)
    return out.unionByName(once)
