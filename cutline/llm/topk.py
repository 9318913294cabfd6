"""Exact top-k inner-product search by the threshold algorithm (operator 8).

Vectors are dealt by id hash into blocks of bounded size; a block holds, for each dimension, its rows in
value order. Every query block is sent to every candidate block (a stated query set against all rows). There a
query reads its dimensions' lists from the end that helps it, in steps of doubling depth, scores what it has
not seen, and stops when the bound of all unread rows (the sum of the values at the lists' current depth)
can no longer reach its kth score. The k best of all blocks are merged by a window over each query.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; of
repeated vec_ids the row with the smallest vector does. Vectors of different lengths are never compared.
Fewer than k candidates: all of them. Ties go to the smaller vec_id. Inner products that may not
fit into 64 bits raise. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

K, SCALE, EVERY = 5, 256, 50
#: Rows of a candidate block and of a query block.
ROWS, QUERIES = 8192, 1024
DEPTH = 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of each component, of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """One row for each block: ids and the matrix, rows in id order."""

    def pack(frame):
        ids = frame.column("vec_id").to_numpy()
        x = np.array(frame.column("v").to_pylist(), np.int64)
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        one = np.concatenate([[True], ids[1:] != ids[:-1]])
        return pa.table({name: frame.column(name)[:1], "d": frame.column("d")[:1], f"{name}_ids": pa.array([ids[one].tobytes()], pa.binary()), f"{name}_x": pa.array([x[one].tobytes()], pa.binary())})

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name), F.size("v").alias("d"), "vec_id", "v")
    return dealt.groupBy(name, "d").applyInArrow(pack, f"{name} int, d int, {name}_ids binary, {name}_x binary")


def longest(x: np.ndarray) -> float:
    """The largest length of a row."""
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)))


def threshold_search(ids: np.ndarray, x: np.ndarray, lists: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best rows of a block for one query: positions, scores, and how many rows were scored.

    ids ascend; lists[:, j]: row positions by falling value of dimension j.
    """
    n = len(ids)
    dims = np.flatnonzero(q)
    falling = np.where(q[dims] > 0, 1, -1)
    at = np.arange(n)
    seen = np.zeros(n, bool)
    score = np.zeros(n, np.int64)
    skip = np.flatnonzero(ids == own)
    seen[skip] = True
    best, depth, read, scored = np.zeros(0, np.int64), 0, DEPTH, 0
    while depth < n:
        upto = min(n, read)
        span = at[depth:upto]
        rows = np.where(falling > 0, span[:, None], n - 1 - span[:, None])
        new = np.zeros(n, bool)
        new[lists[rows, dims] if len(dims) else span] = True
        new &= ~seen
        fresh = np.flatnonzero(new)
        score[fresh] = (x[fresh] @ q).astype(np.int64)
        seen |= new
        scored += len(fresh)
        both = np.concatenate([best, fresh])
        best = both[np.lexsort((both, -score[both]))[:k]]
        depth, read = upto, read * 2
        edge = np.where(falling > 0, depth - 1, n - depth)
        bound = (x[lists[edge, dims], dims] * q[dims]).sum() if len(dims) else 0
        if len(best) == k and bound < score[best[-1]]:
            break
    return best, score[best], scored


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each row of queries (vec_id, embedding)."""
    prepare(vectors.sparkSession)
    rows, asked = quantised(vectors, scale), quantised(queries, scale)
    n, m = max(1, -(-vectors.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    left = blocks(rows, n, "c").select("c", "d", F.lit(-1).alias("q"), F.col("c_ids").alias("ids"), F.col("c_x").alias("x"))
    right = blocks(asked, m, "q").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c"), "d", "q", F.col("q_ids").alias("ids"), F.col("q_x").alias("x"))

    def run(iterator):
        at = None  # the block in hand: a block comes before the query tiles that meet it, so its lists are made once
        for b in iterator:
            for r in b.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], np.int64).reshape(-1, r["d"])
                if r["q"] < 0:
                    at, mine, block, lists, top = (r["c"], r["d"]), ids, x, None, longest(x)
                elif at == (r["c"], r["d"]):
                    big = top * longest(x)  # no inner product is larger
                    if big >= 2.0**63:
                        raise OverflowError("an inner product may not fit into 64 bits")
                    kind = np.int64 if big >= 2.0**52 else np.float64  # exact either way; doubles multiply faster
                    if lists is None:
                        lists = np.argsort(-block, axis=0, kind="stable")
                    values = block.astype(kind)
                    out = [(own, mine[p], s) for own, q in zip(ids.tolist(), x.astype(kind), strict=True) for p, s, _ in [threshold_search(mine, values, lists, q, own, k)]]
                    if out:
                        yield pa.record_batch(
                            [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))],
                            ["query_id", "vec_id", "score"],
                        )

    met = left.unionByName(right).repartition("c", "d").sortWithinPartitions("c", "d", "q")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """The k best for every row whose vec_id is divisible by EVERY."""
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
