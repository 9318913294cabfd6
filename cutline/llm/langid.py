"""Language identification of mixed-language text (operator 1).

Script ranges narrow the candidate languages of each word; a hashed letter-trigram model scores the
word under each candidate; Viterbi decoding with a switching penalty labels the words of a text, and
runs of one label are its spans. The text's language is the one with most labelled letters; the score
is its share of all labelled letters.

Defined results: null text, or text without any letter: `und`, score 0, no spans. A text whose letters
are all of scripts that no learned language uses is still given the likeliest learned language. Ties go
to the language that sorts first. No learned language at all (empty table, all lang null): `und`.
A row with a null doc_id is predicted like others, held_out null, and is not learned from.
Extra columns are ignored by predict and carried along by keep_known.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, prepare
from .textvec import SCRIPT_NAMES, Words, batches, lanes, letters, scripts

#: Model parameters. PER_LANG: labelled texts of one language that the model is fitted on (chosen by a hash, so about as many).
GRAMS = 1 << 17
PER_LANG = 1500
SWITCH = 9.0
SCRIPT_SHARE = 0.005
FOLDS, HELD = 5, 0
#: Bytes of text labelled at a time.
VECTOR = 2_000_000
SPANS = "array<struct<start:int,end:int,lang:string>>"
SCHEMA = f"doc_id long, lang_pred string, score double, spans {SPANS}"


@lru_cache(1)
def true_letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def gram_index(cp: np.ndarray, is_letter: np.ndarray) -> np.ndarray:
    """Hash bucket of the trigram around each letter position; anything else counts as a blank."""
    c = np.where(is_letter, cp, 32).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = c * np.uint32(0x9E3779B1)
        h[1:] += c[:-1] * np.uint32(0x85EBCA77)
        h[:-1] += c[1:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(15)).astype(np.int32)


def _counts(iterator):
    """(lang, bucket, n) of labelled texts; buckets from GRAMS on are scripts."""
    for batch in iterator:
        langs = batch.column("lang").to_pylist()
        w = Words(batch.column("text").to_pylist())
        is_letter = letters()[w.cp]
        at = np.flatnonzero(is_letter)
        doc = np.searchsorted(w.base, at, side="right") - 1
        gram, script = gram_index(w.cp, is_letter)[at], scripts()[w.cp[at]]
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], np.int64)[doc]
        width = GRAMS + len(SCRIPT_NAMES)
        n = np.bincount(code * width + gram, minlength=width * len(names))
        n += np.bincount(code * width + GRAMS + script, minlength=width * len(names))
        hit = np.flatnonzero(n)
        yield pa.record_batch(
            [pa.array([names[i] for i in hit // width], pa.string()), pa.array((hit % width).astype(np.int32)), pa.array(n[hit])], ["lang", "bucket", "n"]
        )


class Model:
    """langs; logp[bucket, lang], centred; allowed[script, lang]."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        n = np.zeros((GRAMS + len(SCRIPT_NAMES), len(self.langs)))
        for lang, bucket, k in rows:
            n[bucket, self.langs.index(lang)] = k
        grams, by_script = n[:GRAMS], n[GRAMS:]
        logp = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * GRAMS)) if self.langs else grams
        if self.langs:
            logp -= logp.mean(1, keepdims=True)
        self.logp = logp.astype(np.float32)
        self.allowed = by_script >= SCRIPT_SHARE * np.maximum(1, by_script.sum(0))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Counts trigrams over texts of each language: all of up to per_lang, else about per_lang, those with a small id hash."""
    spark = prepare(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n of it"))  # a row a language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("n of it") < per_lang << 30
    picked = known.join(F.broadcast(sizes), "lang").where(share).select("text", "lang")
    rows = picked.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return Model(list(rows.itertuples(index=False, name=None)))


def viterbi(emit: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word, for all texts side by side; emit[word, label]."""
    best = np.zeros(len(emit), np.int32)
    order, begin, active = lanes(first, count)
    v = np.zeros((len(order), emit.shape[1]), np.float32)
    back = np.zeros(emit.shape, np.int32)
    own = np.arange(emit.shape[1], dtype=np.int32)
    for t, k in enumerate(active):
        at = begin[:k] + t
        u = v[:k]
        top = u.argmax(1)
        switched = u[np.arange(k), top][:, None] - np.float32(penalty)
        back[at] = np.where(u >= switched, own, top[:, None].astype(np.int32))
        v[:k] = np.maximum(u, switched) + emit[at]
    label = v.argmax(1).astype(np.int32) if len(order) else np.zeros(0, np.int32)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        best[at] = label[:k]
        label[:k] = back[at, label[:k]]
    return best


def label(texts: list[str], m: Model):
    """Language code of each text (-1: none), its score, spans as (text, start, end, code), and the share of its letters in words of scripts that learned languages use."""
    w = Words(texts)
    none = np.zeros(0, np.int64)
    has = np.bincount(np.searchsorted(w.base, np.flatnonzero(true_letters()[w.cp]), side="right") - 1, minlength=w.docs) > 0 if w.docs else np.zeros(0, bool)
    if not m.langs or not len(w.start):
        return np.full(w.docs, -1), np.zeros(w.docs), (none, none, none, none), np.zeros(w.docs)
    is_letter = letters()[w.cp]
    gram = gram_index(w.cp, is_letter)
    at = np.flatnonzero(is_letter)
    steps = np.concatenate([[0], np.cumsum(w.end - w.start)])[:-1]
    emit = np.add.reduceat(m.logp[gram[at]], steps, axis=0)
    allowed = m.allowed[scripts()[w.cp[w.start]]]
    narrowed = allowed.any(1)
    emit[narrowed[:, None] & ~allowed] = -1e4
    first, count = w.per_doc()
    best = viterbi(emit, first, count, SWITCH)
    size = (w.end - w.start).astype(np.float64)
    share = np.bincount(w.doc * len(m.langs) + best, weights=size, minlength=w.docs * len(m.langs)).reshape(w.docs, -1)
    code = np.where(has, share.argmax(1), -1)
    score = np.where(has, share.max(1) / np.maximum(1, share.sum(1)), 0.0)
    turn = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (w.doc[1:] != w.doc[:-1])]))
    last = np.concatenate([turn[1:] - 1, [len(best) - 1]])
    d = w.doc[turn]
    spans = (d, w.start[turn] - w.base[d], w.end[last] - w.base[d], best[turn].astype(np.int64))
    ok = has[d]
    known = np.bincount(w.doc, weights=size * narrowed, minlength=w.docs) / np.maximum(1, np.bincount(w.doc, weights=size, minlength=w.docs))
    return code, score, tuple(x[ok] for x in spans), known


def _predict(model):
    def run(iterator):
        m = model.value
        names = np.array([*m.langs, "und"], dtype=object)
        for held in batches(lambda b: b.column("text"), iterator, VECTOR):
            b = pa.Table.from_batches(held).combine_chunks()
            code, score, (d, start, end, lang), _ = label(b.column("text").to_pylist(), m)
            offsets = np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32)
            span = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(names[lang], pa.string())], ["start", "end", "lang"])
            yield pa.record_batch(
                [b.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(names[code], pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), span)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and labelled spans (code points, end exclusive) of every text."""
    spark = prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_predict(spark.sparkContext.broadcast(model)), SCHEMA)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text is in some learned language: lang_pred is not `und`, and at least half of its letters are of scripts that learned languages use."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(iterator):
        m = shared.value
        for held in batches(lambda b: b.column("text"), iterator, VECTOR):
            b = pa.Table.from_batches(held)
            code, _, _, known = label(b.column("text").to_pylist(), m)
            yield from b.filter(pa.array((code >= 0) & (known >= 0.5))).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark, docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out and predicts every row."""
    held = fold("doc_id", FOLDS) == HELD
    model = fit(docs.where(~held))
    return predict(docs, model).select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD).alias("held_out"), "lang_pred", "score", "spans")
