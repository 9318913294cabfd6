"""Merkle manifest of a table (operator 11): leaves, trees by group, one root, and a proof of every row.

A leaf is the digest of a row's fields: of each `-` if null, else its UTF-8 byte count, `:` and its value. H is the
lowercase hex sha256 of inputs put one after the other, digests as hex text. Per group (lang) leaves ascend by
doc_id; every `fanout` consecutive nodes become their H (a shorter last run too, even one node) until one is left,
the subroot. Subroots, by group (null first, UTF-8 order), become the root the same way.

Leaves are numbered within their group by ranges: sorted range partitions, and the counts of each partition and
group summed up. Aligned blocks of fanout ** LEVELS leaves are folded each in one task: hex digests are the rows of
a contiguous matrix, reshaped by the fanout and hashed row by row, a level at a time. The blocks' tops are the leaves of the
next tables, until each group has one; then the siblings above go down again, one row for each block, and meet the
block's leaves once more, where index arithmetic gives every sibling. A group of any size thus becomes blocks of bounded
size, and no table of proofs is stored.

Defined results: no rows: no rows. Null group: a group of its own, before the others. Null doc_id: before the other
ids of its group, never tampered with. Rows with one doc_id: by their leaves, so equal rows may take each other's place. One row in all: leaf, subroot and
root are equal, and the proof is H of nothing. Extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, prepare, work_folder

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Nodes of a run, and levels that a block has; a block is FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 2, 12
#: Rows of the table of partitions' counts up to which it is broadcast (some 40 bytes each).
SMALL = 100_000
PATH = "path array<struct<place int, others binary>>"


def part(value: Column) -> Column:
    """A field as it is hashed."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(part(v) for v in values)).cast("binary"), 256)


def hash_rows(m: np.ndarray) -> np.ndarray:
    """H of each row of a byte matrix, as rows of 64 hex characters."""
    if not m.size:
        return np.zeros((len(m), 64), np.uint8)
    raw, w = np.ascontiguousarray(m).tobytes(), m.shape[1]
    return np.frombuffer("".join([sha256(raw[i : i + w]).hexdigest() for i in range(0, len(raw), w)]).encode(), np.uint8).reshape(-1, 64)


def depth(n: int, fanout: int, levels: int) -> int:
    """Levels that a block of a group of n nodes folds."""
    j = 0
    while j < levels and n > fanout**j:
        j += 1
    return j


def raised(m: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: rows of `fanout` nodes hashed, the shorter last run too."""
    full = len(m) // fanout * fanout
    above = hash_rows(m[:full].reshape(-1, fanout * 64))
    return np.concatenate([above, hash_rows(m[full:].reshape(1, -1))]) if full < len(m) else above


def block_levels(m: np.ndarray, n: int, fanout: int, levels: int) -> list[np.ndarray]:
    out = [m]
    for _ in range(depth(n, fanout, levels)):
        out.append(raised(out[-1], fanout))
    return out


def siblings(count: int, at: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes `at` of a level of `count`: their place in the run, the indices of the run's others, and which of these exist."""
    place = at % fanout
    others = np.arange(fanout - 1) + (np.arange(fanout - 1) >= place[:, None])
    index = (at - place)[:, None] + others
    return place, np.minimum(index, count - 1), index < count


def folded(m: np.ndarray, current: np.ndarray, at: np.ndarray, fanout: int) -> np.ndarray:
    """H of the runs of nodes `at` of level m, with `current` in the nodes' own places."""
    count = len(m)
    start = at - at % fanout
    run = m[np.minimum(start[:, None] + np.arange(fanout), count - 1)]
    run[np.arange(len(at)), at % fanout] = current
    whole = start + fanout <= count
    out = np.empty((len(at), 64), np.uint8)
    out[whole] = hash_rows(run[whole].reshape(-1, fanout * 64))
    if not whole.all():
        few = run[~whole][:, : count % fanout]
        out[~whole] = hash_rows(few.reshape(len(few), -1))
    return out


def fold_path(current: np.ndarray, path: list[dict]) -> np.ndarray:
    """Nodes after the levels of one path; equal nodes once."""
    distinct, back = np.unique(current, axis=0, return_inverse=True)
    for step in path:
        others = np.frombuffer(step["others"], np.uint8)
        cut = 64 * step["place"]
        sides = [np.broadcast_to(o, (len(distinct), len(o))) for o in (others[:cut], others[cut:])]
        distinct = hash_rows(np.concatenate([sides[0], distinct, sides[1]], axis=1))
    return distinct[back.ravel()]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Hex text of 64 characters a row, as a matrix."""
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def texts(m: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(m).tobytes()[i : i + 64].decode() for i in range(0, m.size, 64)) if m.size else pa.array([], pa.string())


def in_order(t: pa.Table, n_column: str = "n") -> tuple[pa.Table, np.ndarray, int]:
    t = t.sort_by("idx")
    return t, t.column("idx").to_numpy(), t.column(n_column)[0].as_py()


def numbered(rows: DataFrame, group: str, order: list[str], folder: str) -> DataFrame:
    """rows with idx, the place within the group by the columns of order, and n, the rows of the group."""
    sort = [F.asc(group), *(F.asc_nulls_first(c) for c in order)]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    once = keep(placed, f"{folder}/placed")
    counts = once.groupBy("_p", group).agg(F.count("*").alias("_c"), F.min("_i").alias("_f"))
    each = Window.partitionBy(group)
    before = each.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = keep(counts.select("_p", group, (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_f")).alias("_b"), F.sum("_c").over(each).alias("n")), f"{folder}/counts")
    if base.count() <= SMALL:
        base = F.broadcast(base)
    return once.join(base, ["_p", group]).withColumn("idx", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def tops(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """k, idx, n, digest of the blocks of nodes (k, idx, n, digest)."""
    size = fanout**levels

    def fold(key, t):
        t, idx, n = in_order(t)
        last = block_levels(matrix(t.column("digest")), n, fanout, levels)[-1]
        return pa.table({"k": pa.array([key[0].as_py()]), "idx": pa.array([int(idx[0]) // size]), "n": pa.array([-(-n // size)]), "digest": texts(last)})

    cut = nodes.select("k", "idx", "n", "digest", F.floor(F.col("idx") / size).alias("b"))
    return cut.groupBy("k", "b").applyInArrow(fold, "k string, idx long, n long, digest string")


def paths(nodes: DataFrame, folder: str, fanout: int, levels: int) -> DataFrame:
    """k, idx, path, top: of each node the siblings up to the one node that is left of its group."""
    most = nodes.agg(F.max("n")).first()[0]
    if (most or 0) <= 1:
        return nodes.select("k", "idx", F.array().cast("array<struct<place int, others binary>>").alias("path"), F.col("digest").alias("top"))
    size = fanout**levels
    above = paths(keep(tops(nodes, fanout, levels), f"{folder}/tops"), f"{folder}/up", fanout, levels)

    def meet(key, t, up):
        if not t.num_rows:
            return pa.table({"k": pa.array([], pa.string()), "idx": pa.array([], pa.int64()), "path": pa.array([], PATH_TYPE), "top": pa.array([], pa.string())})
        t, idx, n = in_order(t)
        at, steps = idx % size, [[] for _ in idx]
        for m in block_levels(matrix(t.column("digest")), n, fanout, levels)[:-1]:
            place, index, real = siblings(len(m), at, fanout)
            for s, p, i, r in zip(steps, place.tolist(), index, real, strict=True):
                s.append({"place": p, "others": m[i[r]].tobytes()})
            at = at // fanout
        upper, top = up.column("path")[0].as_py(), up.column("top")[0].as_py()
        return pa.table({"k": t.column("k"), "idx": t.column("idx"), "path": pa.array([s + upper for s in steps], PATH_TYPE), "top": pa.array([top] * len(idx))})

    cut = nodes.select("k", "idx", "n", "digest", F.floor(F.col("idx") / size).alias("b"))
    met = cut.groupBy("k", "b").cogroup(above.select("k", F.col("idx").alias("b"), "path", "top").groupBy("k", "b"))
    return keep(met.applyInArrow(meet, f"k string, idx long, {PATH}, top string"), f"{folder}/paths")


PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "lang", order: str = "doc_id", claimed: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """For each row: the order column, leaf, subroot, root, proof_sha256, and the root folded from its leaf and its siblings with whether it equals the root.

    claimed: columns that replace fields where the folding begins (an audit of rows against the manifest's siblings).
    proofs: adds idx (the leaf's number in its group) and path (of each level its place in the run and the run's others).
    """
    spark = prepare(docs.sparkSession)
    folder = work_folder(spark, "merkle")
    fields = fields or FIELDS
    claimed = claimed or {}
    size = fanout**levels
    leaf = leaf_of([F.col(c) for c in fields])
    other = leaf_of([claimed.get(c, F.col(c)) for c in fields])
    same = F.lit(True)
    for c, value in claimed.items():
        same = same & value.eqNullSafe(F.col(c))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("k")  # null before all others
    rows = docs.select(key, F.col(order).alias("id"), leaf.alias("digest"), F.when(~same, other).alias("other"))
    nodes = numbered(rows, "k", ["id", "digest"], folder)
    blocks = keep(tops(nodes, fanout, levels), f"{folder}/blocks")
    above = paths(blocks, f"{folder}/groups", fanout, levels)
    subroots = numbered(above.where("idx = 0").select(F.lit("").alias("k"), F.col("k").alias("name"), F.col("top").alias("digest")), "k", ["name"], f"{folder}/subroots")
    roots = paths(subroots.select("k", "idx", "n", "digest"), f"{folder}/root", fanout, levels)
    named = subroots.select("name", "idx", F.col("digest").alias("subroot")).join(roots.select("idx", F.col("path").alias("last"), F.col("top").alias("root")), "idx").drop("idx")
    upper = above.join(named, above["k"] == named["name"]).select("k", F.col("idx").alias("b"), F.concat("path", "last").alias("path"), "subroot", "root")
    id_type = docs.schema[order].dataType.simpleString()
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", idx long, {PATH}" if proofs else "")

    def audit(key, t, up):
        t, idx, n = in_order(t)
        leaves = matrix(t.column("digest"))
        current = leaves.copy()
        changed = np.flatnonzero(t.column("other").is_valid().to_numpy(zero_copy_only=False))
        if len(changed):
            current[changed] = matrix(t.column("other").drop_null())
        path, subroot, root = (up.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        at, found, real, steps = idx % size, [], [], [[] for _ in idx]
        for m in block_levels(leaves, n, fanout, levels)[:-1]:
            place, index, exists = siblings(len(m), at, fanout)
            found.append(m[index])
            real.append(exists)
            if proofs:
                for s, p, i, r in zip(steps, place.tolist(), index, exists, strict=True):
                    s.append({"place": p, "others": m[i[r]].tobytes()})
            current = folded(m, current, at, fanout)
            at = at // fanout
        current = fold_path(current, path)
        rest = b"".join(s["others"] for s in path)
        if found:
            found, real = np.concatenate(found, axis=1), np.concatenate(real, axis=1)
            lists = [(f if r.all() else f[r]).tobytes() for f, r in zip(found, real, strict=True)]
        else:
            lists = [b""] * len(idx)
        ends = texts(current)
        columns = {"id": t.column("id"), "leaf": t.column("digest"), "subroot": pa.array([subroot] * len(idx)), "root": pa.array([root] * len(idx)), "proof_sha256": pa.array([sha256(b + rest).hexdigest() for b in lists]), "folded_root": ends, "verified": pa.array([e == root for e in ends.to_pylist()], pa.bool_())}
        if proofs:
            columns |= {"idx": t.column("idx"), "path": pa.array([s + path for s in steps], PATH_TYPE)}
        return pa.table(columns)

    cut = nodes.select("k", "idx", "n", "id", "digest", "other", F.floor(F.col("idx") / size).alias("b"))
    out = cut.groupBy("k", "b").cogroup(upper.groupBy("k", "b")).applyInArrow(audit, schema)
    return out.withColumnRenamed("id", order)


def op11_merkle(docs: DataFrame) -> DataFrame:
    """The manifest of documents, audited against rows of which those whose crc32(doc_id) 7 divides claim one character more."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = F.col("n_chars").cast("decimal(38,0)")
    return manifest(docs, claimed={"n_chars": F.when(hit, more + 1).otherwise(more)})


#: The same in DuckDB; crc32 is a sum over bits, as the engine has no such function.
ORACLE = """
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce([b::UBIGINT] || list_transform(range(8), lambda x: 0::UBIGINT), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, source, lang, n_chars, text, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda c, x: xor(c >> 8, crc[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 7 = 0 AS hit FROM documents, bits),
h AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS size, coalesce(octet_length(encode((n_chars::HUGEINT + 1)::VARCHAR)) || ':' || (n_chars::HUGEINT + 1), '-') AS more, coalesce(octet_length(encode(text)) || ':' || text, '-') AS body FROM d),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS k, sha256(head || size || body) AS leaf, sha256(head || CASE WHEN hit THEN more ELSE size END || body) AS claimed FROM h),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
tree(k, level, idx, digest) AS (SELECT k, 0, idx, leaf FROM placed
  UNION ALL SELECT k, level + 1, idx // 2, sha256(digest || coalesce(follow, '')) FROM (SELECT *, lead(digest) OVER (PARTITION BY k ORDER BY idx) AS follow, count(*) OVER (PARTITION BY k) AS n FROM tree) WHERE n > 1 AND idx % 2 = 0),
subs AS (SELECT k, digest AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS idx FROM (SELECT k, arg_max(digest, level) AS digest FROM tree GROUP BY k)),
crown(level, idx, digest) AS (SELECT 0, idx, subroot FROM subs
  UNION ALL SELECT level + 1, idx // 2, sha256(digest || coalesce(follow, '')) FROM (SELECT *, lead(digest) OVER (ORDER BY idx) AS follow, count(*) OVER () AS n FROM crown) WHERE n > 1 AND idx % 2 = 0),
root AS (SELECT digest AS root, level AS high FROM crown ORDER BY level DESC LIMIT 1),
heights AS (SELECT k, max(level) AS high FROM tree GROUP BY k),
low AS (SELECT p.k, p.idx, list(CASE WHEN s.digest IS NULL THEN 'N' WHEN s.idx % 2 = 0 THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY j.level) AS steps
  FROM placed p JOIN heights USING (k) JOIN (SELECT unnest(range(64)) AS level) j ON j.level < high LEFT JOIN tree s ON s.k = p.k AND s.level = j.level AND s.idx = xor(p.idx >> j.level, 1) GROUP BY ALL),
top AS (SELECT p.k, list(CASE WHEN s.digest IS NULL THEN 'N' WHEN s.idx % 2 = 0 THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY j.level) AS steps
  FROM subs p CROSS JOIN root JOIN (SELECT unnest(range(64)) AS level) j ON j.level < high LEFT JOIN crown s ON s.level = j.level AND s.idx = xor(p.idx >> j.level, 1) GROUP BY ALL),
whole AS (SELECT p.*, subroot, root, coalesce(low.steps, []) || coalesce(top.steps, []) AS steps FROM placed p JOIN subs USING (k) CROSS JOIN root LEFT JOIN low ON low.k = p.k AND low.idx = p.idx LEFT JOIN top ON top.k = p.k),
ends AS (SELECT *, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, list_reduce([claimed] || steps, lambda a, b: CASE b[1] WHEN 'L' THEN sha256(b[2:] || a) WHEN 'R' THEN sha256(a || b[2:]) ELSE sha256(a) END) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM ends
"""
