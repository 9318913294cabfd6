"""Audit of how quality filters interact (operator 12): what each removes, alone and after others, in every order.

A text (null: empty) fails A with under MIN_WORDS words (maximal runs of bytes other than blanks), B if distinct words
are under DISTINCT percent of the words, C if capitals A-Z are over CAPITALS percent of the code points, D if it holds a symbol
of SYMBOLS, E if it is identical to the text of a smaller doc_id anywhere in the table.

One scan of Arrow's text buffers finds A to D: byte classes by table look-up, counts of a document as
differences of prefix sums. Distinct words come from word hashes, sorted within the document; neighbours with equal hashes
are compared byte by byte, and a document with a true collision is counted anew by its words. What leaves the scan
is a mask and a digest of each text (128 bits of blake2b), so that texts aren't shuffled.

E needs no join of copies: in each group of equal digests only the rows of the smallest doc_id pass, found by a combining
minimum; all the others fail. So rows of a part and mask are counted twice, all of them and the first ones, and the
difference fails E. Per part there remain 32 masks with three counts, from which constant matrices give all 120 orders.

Defined results: no rows: no rows. Null source: part ''. Null doc_id: not larger or smaller than any other, so such a
row passes E and has no labels. Rows of one doc_id and text don't fail E by each other. A document counts as good or toxic if any of its
rows in labels says 1; null labels don't. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare, work_folder
from .textvec import batches, mix

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
#: Bytes of text that a task looks at together; words of more than LONG bytes are hashed and compared one by one.
VECTOR, LONG = 1_000_000, 64
#: Byte classes as bits of a table: blank, capital, symbol, byte that continues a code point.
BLANK, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, 9, 10, 11, 12, 13]] |= BLANK
CLASSES[0x41:0x5B] |= CAPITAL
CLASSES[list(SYMBOLS.encode())] |= SYMBOL
CLASSES[0x80:0xC0] |= INNER
LOW = (np.uint64(1) << (np.arange(9, dtype=np.uint64) * np.uint64(8)) % np.uint64(64)) - np.uint64(1)
LOW[8] = np.uint64((1 << 64) - 1)  # masks of the first 0 to 8 bytes


class Texts:
    """The bytes of a batch of texts, their offsets, and their words (start and size, in order)."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.bytes = self.padded[: len(raw)]
        self.classes = CLASSES[self.bytes]
        inside = self.classes & BLANK == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]  # words end with their text
        first[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
        self.start = np.flatnonzero(first)
        self.size = np.flatnonzero(last) + 1 - self.start
        self.bounds = np.searchsorted(self.start, self.offsets)  # words before each text

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have a flag."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def eights(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place, as one number."""
        every = np.ndarray((len(self.bytes) + 1,), "<u8", self.padded, strides=(1,))
        return every[at] & LOW[np.minimum(size, 8)]

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        h = mix(self.size.astype(np.uint64) + np.uint64(0x51ED270B))
        rest = np.flatnonzero(self.size <= LONG)
        for k in range(0, LONG, 8):
            rest = rest[self.size[rest] > k]
            if not len(rest):
                break
            h[rest] = mix(h[rest] ^ self.eights(self.start[rest] + k, self.size[rest] - k))
        for i in np.flatnonzero(self.size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return h

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words i and j aren't the same bytes."""
        out = self.size[i] != self.size[j]
        rest = np.flatnonzero(~out & (self.size[i] <= LONG))
        for k in range(0, LONG, 8):
            rest = rest[self.size[i[rest]] > k]
            if not len(rest):
                break
            size = self.size[i[rest]] - k
            out[rest] |= self.eights(self.start[i[rest]] + k, size) != self.eights(self.start[j[rest]] + k, size)
        for n in np.flatnonzero(~out & (self.size[i] > LONG)).tolist():
            out[n] = self.word(int(i[n])) != self.word(int(j[n]))
        return out

    def distinct(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct words of each text."""
        docs = len(self.offsets) - 1
        doc = np.repeat(np.arange(docs), np.diff(self.bounds))
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        out = np.diff(self.bounds) - np.bincount(d[1:][same], minlength=docs)
        at = np.flatnonzero(same)
        for x in np.unique(d[at[self.differ(order[at], order[at + 1])]]).tolist():
            out[x] = len({self.word(i) for i in range(self.bounds[x], self.bounds[x + 1])})
        return out


def masks(texts: Texts) -> np.ndarray:
    """Filters A to D that each text fails, as bits 1, 2, 4, 8."""
    words = np.diff(texts.bounds)
    fails = [
        words < MIN_WORDS,
        100 * texts.distinct(texts.hashes()) < DISTINCT * words,
        100 * texts.counts(texts.classes & CAPITAL != 0) > CAPITALS * texts.counts(texts.classes & INNER == 0),
        texts.counts(texts.classes & SYMBOL != 0) > 0,
    ]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (A to D) and digest of every row of docs."""

    def run(iterator):
        for held in batches(lambda b: b.column("text"), iterator, VECTOR):
            t = pa.Table.from_batches(held).combine_chunks()
            texts = Texts(t.column("text").combine_chunks() if t.column("text").num_chunks != 1 else t.column("text").chunk(0))
            raw, cut = memoryview(texts.bytes), texts.offsets.tolist()
            digest = [hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(cut[:-1], cut[1:], strict=True)]
            columns = {"doc_id": t.column("doc_id"), "part": t.column("part"), "mask": pa.array(masks(texts), pa.int32()), "digest": pa.array(digest, pa.binary())}
            yield from pa.table(columns).combine_chunks().to_batches()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return named.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E) and the numbers of rows, of good and of toxic ones (n, good, toxic)."""
    folder = work_folder(prepare(docs.sparkSession), "filters")
    rows = keep(scan(docs), f"{folder}/scan")
    one = [F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(x) for c, x in (("quality", "good"), ("toxic", "toxic"))]
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*one)
    joined = rows.where("doc_id is not null").join(marked, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # Rows of one id and text, by part: one row, but for repeated ids.
    per_part = joined.groupBy("doc_id", "digest", "mask", "good", "toxic", "part").agg(F.count("*").alias("n"))
    each = keep(per_part.groupBy("doc_id", "digest", "mask", "good", "toxic").agg(F.collect_list(F.struct("part", "n")).alias("parts")), f"{folder}/each")
    first = each.groupBy("digest").agg(F.min_by(F.struct("mask", "good", "toxic", "parts"), "doc_id").alias("f")).select("f.*")

    def sums(groups: DataFrame) -> DataFrame:
        flat = groups.select("mask", "good", "toxic", F.explode("parts").alias("p"))
        return flat.groupBy(F.col("p.part").alias("part"), "mask").agg(F.sum("p.n").alias("n"), F.sum(F.col("good") * F.col("p.n")).alias("good"), F.sum(F.col("toxic") * F.col("p.n")).alias("toxic"))

    firsts = keep(sums(first), f"{folder}/first")
    copy = F.col("mask").bitwiseOR(F.lit(16)).alias("mask")
    zero = F.lit(0).cast("long")
    without = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    signed = firsts.unionByName(without).unionByName(sums(each).withColumn("mask", copy)).unionByName(firsts.select("part", copy, *((-F.col(c)).alias(c) for c in ("n", "good", "toxic"))))
    return signed.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def order_matrices() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The orders; for each (order, step) row which masks are kept, removed here, redundant; and the filter of the step."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    mask = np.arange(1 << len(FILTERS))
    kept, removed, redundant, which = [], [], [], []
    for o in orders:
        before = np.zeros(len(mask), bool)
        for letter in o:
            k = FILTERS.index(letter)
            fails = mask >> k & 1 == 1
            removed.append(fails & ~before)
            redundant.append(fails & before)
            before = before | fails
            kept.append(~before)
            which.append(k)
    return orders, *(np.array(m, np.int64) for m in (kept, removed, redundant)), np.array(which)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, with long counts; see the module."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(iterator):
        orders, kept, removed, redundant, which = order_matrices()
        steps = len(FILTERS)
        for b in iterator:
            for part, cells in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, 1 << steps), np.int64)
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                out = removed @ n
                shapley = np.array([out[which == k].sum() for k in range(steps)])
                values = [kept @ n, out, redundant @ n, n[1 << which], removed @ good, removed @ toxic, shapley[which]]
                yield pa.record_batch(
                    [pa.array([part] * len(out), pa.string()), pa.array(np.repeat(orders, steps)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))), *(pa.array(v) for v in values)],
                    ["part", "filter_order", "step", *names],
                )

    cells = counted(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


#: The same in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, doc_id, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
parts AS (SELECT DISTINCT part FROM m),
letter AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT array_to_string(list_transform(ks, lambda k: chr(65 + k)), '') AS filter_order, k + 1 AS step, 1 << ks[k + 1] AS bit, list_sum(list_transform(ks[1:k], lambda x: 1 << x)) AS earlier FROM orders, letter),
rows AS (SELECT p.part, filter_order, step, bit, coalesce(earlier, 0)::BIGINT AS earlier FROM parts p, steps),
counts AS (SELECT r.part, filter_order, step, bit,
    sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM rows r JOIN m ON m.part = r.part GROUP BY r.part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counts
"""
