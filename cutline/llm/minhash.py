"""MinHash near-duplicate detection by a multi-index Hamming join (operator 13).

A signature has SYMBOLS symbols of BITS bits: for each of as many multiplicative hash functions, BITS bits of the least hash of the
document's shingles. Two sets of Jaccard similarity s differ in each symbol with a probability of 1 - s (a bit less, as
two symbols may agree by chance), so the number of symbols in which they differ, the distance of signatures, is binomial.

Join. Signatures are split into CHUNKS chunks of WIDTH symbols. By the pigeonhole principle two signatures at a
distance of at most LIMIT = CHUNKS * (ERRORS + 1) - 1 have a chunk in which at most ERRORS symbols differ. The allowed errors of a
chunk are enumerated as the places that may differ: a key is a chunk, a choice of ERRORS places and the other symbols as they
are, 48 bits of them. So all pairs within LIMIT meet, whatever their sets; a pair of similarity 0.8 lies beyond LIMIT with
a probability of 8e-8, and as pairs that meet are only ruled out beyond FAR, one in 10^11 of such pairs isn't
compared. Those that are left are confirmed on the full sets.

Nodes of the join are distinct sets. What happens inside buckets (nodes of one key) is what the n-gram join does: small buckets become
pairs, in larger ones all nodes are compared with one central pivot, and nodes that don't get into the pivot's component
are indexed relative to it by tokens, which loses no link. Components come from star steps over Spark tables.

Defined results: null text or text without words: no set, linked with nothing, its own component. Texts of fewer words than
a shingle: one shingle of the whole sequence. Rows with a null doc_id take part by their text; the component_id of a
group is its smallest doc_id that is not null, else null; they are kept only in a group without other ids. Repeated doc_ids are rows of their own. No rows: no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare, work_folder
from .jaccard import apart, node_of, node_roots, node_rows, parity, rooted, shared_keys, shingle_sets, texts_of
from .textvec import mix

WORDS, PERCENT = 5, 80
CHUNKS, WIDTH, ERRORS, BITS = 16, 4, 1, 16
SYMBOLS = CHUNKS * WIDTH
BYTES = SYMBOLS * BITS // 8
#: Distance within which all pairs meet, and beyond which pairs that meet are not compared.
LIMIT, FAR = CHUNKS * (ERRORS + 1) - 1, 40
#: Places of a chunk that a key keeps: all choices of the others are the errors allowed.
KEPT = list(combinations(range(WIDTH), WIDTH - ERRORS))
#: Odd multipliers of the hash functions.
FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of symbols for each set; the sets must not be empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(FACTORS):
            out[:, k] = mix(np.minimum.reduceat(values * factor, starts)) >> np.uint64(64 - BITS)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature, CHUNKS * len(KEPT) a row."""
    chunks = signature.reshape(len(signature), CHUNKS, WIDTH).astype(np.int64)
    out = np.empty((len(signature), CHUNKS, len(KEPT)), np.int64)
    for k, places in enumerate(KEPT):
        key = np.arange(CHUNKS) * len(KEPT) + k
        for p in places:
            key = key << BITS | chunks[:, :, p]
        out[:, :, k] = key
    return out.reshape(len(signature), -1)


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, mark (hash of the text), n, node and bits (signature, then parity bits of the set) of every row of docs."""

    def run(iterator):
        for t, text in texts_of(iterator):
            sets = shingle_sets(text, words)
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full) if full else [])
            bits = [next(rows).tobytes() + parity(s) if len(s) else None for s in sets]
            node = [node_of(s) if len(s) else None for s in sets]
            columns = [t.column("doc_id").combine_chunks(), t.column("mark").combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary())]
            yield from pa.table(columns, ["doc_id", "mark", "n", "node", "bits"]).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n long, node long, bits binary")


def matrix(bits: list[bytes]) -> np.ndarray:
    """The signatures that bits begin with, one a row."""
    return np.frombuffer(b"".join(x[:BYTES] for x in bits), np.uint16).reshape(-1, SYMBOLS)


def multi_index(nodes: DataFrame) -> DataFrame:
    """(key, node, hot) of every node; none is hot."""

    def run(iterator):
        for b in iterator:
            if b.num_rows:
                keys = keys_of(matrix(b.column("bits").to_pylist()))
                node = np.repeat(b.column("node").to_numpy(), keys.shape[1])
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(node), pa.array(np.zeros(len(node), bool))], ["key", "node", "hot"])

    return nodes.select("node", "bits").mapInArrow(run, "key long, node long, hot boolean")


def near(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that neither sizes, nor the distance of signatures, nor parity bits rule out."""

    def run(iterator):
        for t in iterator:
            if t.num_rows:
                x, y, n = (t.column(c).to_pylist() for c in ("x", "y", "n"))
                ok = (matrix(x) != matrix(y)).sum(1) <= FAR
                for i in np.flatnonzero(ok).tolist():
                    ok[i] = (100 + percent) * apart(x[i][BYTES:], y[i][BYTES:]) <= (100 - percent) * n[i]
                yield t.select(["a", "b"]).filter(pa.array(ok))

    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("na")), "a")
    full = left.join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("nb")), "b")
    full = full.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return full.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(run, "a long, b long")


def duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trace=None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    if percent < 80:
        raise ValueError("the chunks are chosen for similarities of 80 % and more")
    spark = prepare(docs.sparkSession)
    folder = work_folder(spark, "minhash")
    seen = keep(signed(docs, words), f"{folder}/signed")
    nodes = keep(node_rows(seen), f"{folder}/nodes-all")
    roots = node_roots(docs, nodes, shared_keys(multi_index(nodes)), folder, words, percent, trace or (lambda *a: None), near, BYTES, again=0)
    out = rooted(seen.select("doc_id", "mark", "n", "node"), roots, folder)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("top_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("top_id")).alias("kept"))
