"""Personal data: base patterns, and terms that give protected entities away (operator 4).

Base patterns find e-mail addresses, ip addresses, card and phone numbers. Around them, corpus co-occurrence
estimates how strongly a term (a word) reveals an entity of a kind: of all its occurrences in the corpus, the
share within WINDOW words of such an entity, against the share any word has. A term whose pointwise
information about a kind reaches BITS, with at least SUPPORT occurrences there and a share of SHARE, exceeds
the disclosure threshold; all its occurrences in documents with an entity of that kind, near it or not, become
spans of kind `term`. sanitise replaces entities by their kind, generalises terms that reveal one kind only
to that kind's context mark ([EMAIL CONTEXT]), and removes terms that reveal several.

Counts cover all words of all documents. Words of no use are left out by a bit table of fixed size (those
whose hash no term near an entity has), which may let others in but loses none.

Defined results: null text counts as empty and has no spans. Base spans of different kinds may overlap and
all stay; term spans that overlap a base span are left out. Repeated rows of a document, and rows without a doc_id, count each time.
Extra columns are ignored by find and carried along by sanitise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare, work_folder

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. (An ip that begins inside a run of digits would begin at its first digit too.)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Parameters of the method.
WINDOW, SUPPORT, SHARE, BITS = 4, 8, 0.5, 3.0
TABLE = 1 << 20
WORD = re.compile(r"[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """All leftmost, non-overlapping matches; only what stands before an @ is tried, from its first character on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not text:
        return []
    out = [(0, *s) for s in emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


DIGIT = re.compile("[0-9]")


def bucket(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % TABLE


def near(text: str, spans: list[tuple[int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(kind, entity start, start, end) of the window words before and after each entity; words of entities don't count."""
    words = outside([m.span() for m in WORD.finditer(text)], spans)
    starts = [s for s, _ in words]
    out = []
    for kind, a, z in spans:
        left, right = bisect_left(starts, a), bisect_left(starts, z)
        out += [(kind, a, s, e) for s, e in (*words[max(0, left - window) : left], *words[right : right + window])]
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """kind, term, n: how often each word stands near an entity of a kind (each occurrence once per kind)."""

    def run(iterator):
        for b in iterator:
            n: Counter = Counter()
            for t in b.column("text").to_pylist():
                if t and (spans := base_spans(t)):
                    n.update((k, t[s:e].lower()) for k, s, e in {(k, s, e) for k, _, s, e in near(t, spans)})
            keys = list(n)
            yield pa.record_batch([pa.array([k for k, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())], ["kind", "term", "n"])

    return docs.select("text").mapInArrow(run, "kind int, term string, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def bits_of(terms: DataFrame) -> np.ndarray:
    """The bit table of some terms; the driver gets at most TABLE numbers."""

    def run(iterator):
        for b in iterator:
            yield pa.record_batch([pa.array(sorted({bucket(w) for w in b.column("term").to_pylist()}), pa.int32())], ["at"])

    table = np.zeros(TABLE, bool)
    table[terms.select("term").mapInArrow(run, "at int").distinct().toPandas()["at"].to_numpy(np.int64)] = True
    return table


def corpus_counts(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """term, n over all documents, of terms in the bit table; the row with a null term counts all words."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(iterator):
        known: dict[str, bool] = {}
        for b in iterator:
            n: Counter = Counter()
            for t in b.column("text").to_pylist():
                if t:
                    n.update(WORD.findall(t.lower()))
            if len(known) > 300_000:
                known.clear()
            for w in n.keys() - known.keys():
                known[w] = bool(shared.value[bucket(w)])
            keys = [w for w in n if known[w]]
            yield pa.record_batch([pa.array([None, *keys], pa.string()), pa.array([sum(n.values()), *(n[w] for w in keys)], pa.int64())], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """kind, term, n (near), total, bits: the terms that exceed the disclosure threshold of a kind."""
    folder = work_folder(prepare(docs.sparkSession), "pii")
    close = keep(term_counts(docs), f"{folder}/near")
    all_near = {r["kind"]: r["n"] for r in close.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    candidates = close.where(F.col("n") >= support)
    schema = "kind int, term string, n long, total long, bits double"
    if not all_near or candidates.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    totals = keep(corpus_counts(docs, bits_of(candidates)), f"{folder}/totals")
    words = totals.where("term is null").agg(F.sum("n")).first()[0]
    rate = F.create_map(*(x for k, n in all_near.items() for x in (F.lit(k), F.lit(n / max(1, words)))))
    part = F.col("n") / F.greatest("total", "n")
    got = candidates.join(totals.where("term is not null").withColumnRenamed("n", "total"), "term").withColumn("bits", F.log2(part / F.element_at(rate, F.col("kind"))))
    return keep(got.where((part >= share) & (F.col("bits") >= bits)).select("kind", "term", "n", "total", "bits"), f"{folder}/terms")


LETTER = re.compile(r"[^\W\d_]")


def places(text: str, words: list[str]) -> list[tuple[int, int]]:
    """(start, end) of all words of the text that are one of words."""
    if len(words) > 16:
        wanted = set(words)
        return [m.span() for m in WORD.finditer(text) if m[0] in wanted]
    out = []
    for w in words:
        at = text.find(w)
        while at >= 0:
            end = at + len(w)
            if not (at and LETTER.match(text, at - 1)) and not LETTER.match(text, end):
                out.append((at, end))
            at = text.find(w, end)
    return sorted(out)


def outside(found: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those of found, in order, that overlap no span."""
    out, cut, at = [], sorted((a, z) for _, a, z in spans), 0
    reach = 0  # the furthest end of the spans that begin before the word ends
    for s, e in found:
        while at < len(cut) and cut[at][0] < e:
            reach = max(reach, cut[at][1])
            at += 1
        if s >= reach:
            out.append((s, e))
    return out


def located(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """find(), with mark (a hash of the text) and cuts: the spans of terms by what sanitise writes for them.

    All words of a document with an entity that pass the bit table go to the terms by a join, so the list of terms
    may be of any size. A term counts in documents that have an entity of one of its kinds.
    """
    spark = prepare(docs.sparkSession)
    terms = disclosing(docs) if terms is None else terms
    shared = spark.sparkContext.broadcast(bits_of(terms))

    def run(iterator):
        known: dict[str, bool] = {}
        for b in iterator:
            rows = []
            if len(known) > 300_000:
                known.clear()
            for doc, mark, t in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist(), strict=True):
                spans = base_spans(t)
                words = []
                if spans:
                    seen = set(WORD.findall(t))
                    for w in seen - known.keys():
                        known[w] = bool(shared.value[bucket(w.lower())])
                    words = outside(places(t, [w for w in seen if known[w]]), spans)
                listed = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
                n = Counter(k for k, _, _ in spans)
                rows.append((doc, mark, *(n[k] for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), listed, sorted(n), [{"term": t[s:e].lower(), "start": s, "end": e} for s, e in words]))
            kinds = [pa.int64()] * 6 + [pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.record_batch(columns, ["doc_id", "mark", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "has", "words"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id long, mark long, {counts}, base_sha256 string, base string, has array<int>, words array<struct<term:string,start:bigint,end:bigint>>"
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, schema)
    rows = keep(rows, work_folder(spark, "pii-words"))
    hit = rows.where(F.size("words") > 0).select("doc_id", "mark", "has", F.explode("words").alias("x")).select("doc_id", "mark", "has", "x.*")
    reveals = terms.groupBy("term").agg(F.collect_set("kind").alias("reveals"))
    names = F.array(*map(F.lit, KINDS))
    what = F.when(F.size("reveals") == 1, F.concat(F.element_at(names, F.col("reveals")[0] + 1), F.lit(" context"))).otherwise("")
    hit = hit.join(reveals, "term").where(F.arrays_overlap("has", "reveals")).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "end", what.alias("what")))).alias("t"))

    def listed(kind) -> F.Column:
        return F.array_join(F.transform("t", lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")

    hit = hit.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), listed(lambda x: F.lit("term")).alias("more"), listed(lambda x: x["what"]).alias("cuts"), F.size("t").cast("long").alias("n_term"))
    rows = rows.drop("has", "words").join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left")
    base = F.nullif("base", F.lit(""))
    return rows.select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.concat_ws(",", base, "more").alias("spans"), F.coalesce("n_term", F.lit(0)).cast("long").alias("n_term"), "mark", F.concat_ws(",", base, "cuts").alias("cuts")
    )


def find(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, n of each kind, base_sha256, spans of every text; n_term counts the term spans."""
    return located(docs, terms).drop("mark", "cuts")


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """docs with entities replaced by their kind and disclosing terms generalised or removed.

    The terms that can occur in a batch are few; they come as cuts of located(), joined by doc_id and text.
    """
    found = located(docs, terms).groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(F.max("cuts").alias("spans of it"))
    columns = docs.columns
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_m")), "left").select(*(docs[c] for c in columns), "spans of it")

    def run(iterator):
        for b in iterator:
            out = []
            for t, spans in zip(b.column("text").to_pylist(), b.column("spans of it").to_pylist(), strict=True):
                if t and spans:
                    cut = sorted((int(a), int(z), k) for k, a, z in (s.split(":") for s in spans.split(",")))
                    parts, at = [], 0
                    for a, z, k in cut:
                        if a >= at:
                            parts += [t[at:a], f"[{k.upper()}]" if k else ""]
                        at = max(at, z)
                    t = "".join(parts) + t[at:]
                out.append(t)
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type)).select(columns)

    return joined.mapInArrow(run, docs.schema)
