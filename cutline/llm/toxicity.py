"""Toxic spans by a linear-chain conditional random field, and document scores from them (operator 5).

Labels mark documents; tokens get theirs from them: in toxic documents, a token is labelled 1 if one of its
features (the word, its prefixes, its ending) is found in toxic documents far more often than in others. On
these labelled tokens the field is trained: emission weights of hashed features and four transition weights,
by full gradients, each summed by a Spark job over the bounded training sample. Forward-backward marginals
of all texts run side by side in vectors; their aggregates become a calibrated document score, and runs of
likely tokens are the offending offsets.

Defined results: null text and text without words: the score of a text without toxic tokens, no spans. No
labelled rows, or none toxic: score 0 everywhere. Labels of one kind only in the sample: the labels' share of toxic
rows as the score of all. Too few labels for a calibrating half: the training texts calibrate too. A null label counts as 0; of repeated labels of a document
the larger holds. Rows with a null
doc_id are scored like others, held_out null, and labels without one are not used. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keep, prepare, work_folder
from .textvec import Words, batches, lanes, mix

#: Labelled documents the model is fitted on: this many of each label, those with the smallest id hash. Half of
#: them train the field, the others calibrate the score. Of texts of one label that begin or end alike one is used.
SAMPLE, ALIKE = 3000, 64
FEATURES, STEPS, RATE, DECAY = 1 << 17, 18, 0.7, 1e-4
PREFIXES = (3, 4, 5, 6)
#: Log-odds and support (documents, and share of the toxic ones) of a feature that labels tokens.
ODDS, SUPPORT, SUPPORT_SHARE = 3.0, 3, 0.005
LIKELY = 0.5
FOLDS, HELD, CUT = 4, 2, 0.3
SPANS = "array<struct<start:int,end:int,score:double>>"


def token_features(w: Words) -> np.ndarray:
    """Hash buckets of each word's features; 0 where a word is too short to have one."""
    size = w.end - w.start
    out = np.zeros((len(size), len(PREFIXES) + 2), np.int32)
    if not len(size):
        return out
    with np.errstate(over="ignore"):
        h = np.zeros(len(size), np.uint64)
        for k in range(max(PREFIXES)):
            there = size > k
            h = np.where(there, mix(h * np.uint64(31) + w.cp[np.minimum(w.start + k, len(w.cp) - 1)] + np.uint64(1)), h)
            if k + 1 in PREFIXES:
                out[:, PREFIXES.index(k + 1)] = np.where(there, bucket(h, k + 1), 0)
        at = np.repeat(w.start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        place = at - np.repeat(w.start, size)
        power = np.cumprod(np.full(int(size.max()), 0x5851F42D4C957F2D, np.uint64))
        whole = np.add.reduceat((w.cp[at].astype(np.uint64) + np.uint64(7)) * power[place], np.cumsum(size) - size)
        out[:, -2] = bucket(mix(whole), 99)
        last = [w.cp[np.maximum(w.end - k, 0)].astype(np.uint64) for k in (1, 2, 3)]
        out[:, -1] = np.where(size >= 3, bucket(mix(last[0] + (last[1] << np.uint64(21)) + (last[2] << np.uint64(42))), 98), 0)
    return out


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (1 + mix(h + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(FEATURES - 1)).astype(np.int32)


def forward_backward(emit: np.ndarray, first: np.ndarray, count: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of state 1 against 0: forward, backward, and the weight exp(emit); all texts side by side.

    trans[i, j]: log weight of going from state i to j.
    """
    e = np.exp(np.clip(emit, -25, 25))
    t = np.exp(trans)
    order, begin, active = lanes(first, count)
    f, b = np.ones(len(emit)), np.ones(len(emit))
    r = np.ones(len(order))
    for k, n in enumerate(active):
        at = begin[:n] + k
        if k:
            r[:n] = np.clip((t[0, 1] + r[:n] * t[1, 1]) / (t[0, 0] + r[:n] * t[1, 0]), 1e-12, 1e12)
        r[:n] = np.clip(r[:n] * e[at], 1e-12, 1e12)
        f[at] = r[:n]
    s = np.ones(len(order))
    for k in range(len(active) - 2, -1, -1):
        n = active[k + 1]  # texts that have a word after this one
        at = begin[:n] + k
        x = e[at + 1] * s[:n]
        s[:n] = np.clip((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), 1e-12, 1e12)
        b[at] = s[:n]
    return f, b, e


def marginals(w: Words, feats: np.ndarray, m: dict):
    first, count = w.per_doc()
    emit = m["weights"][feats].sum(1) + m["bias"]
    f, b, e = forward_backward(emit, first, count, m["trans"])
    return f * b / (1 + f * b), f, b, e


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """text, toxic and half (0 trains, 1 calibrates) of the sample."""
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").where(F.col("text").isNotNull()).select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("half"))


def _lexicon(sample: DataFrame) -> np.ndarray:
    """Log-odds of each feature bucket: documents with it among the toxic against the others."""

    def run(iterator):
        n = np.zeros((2, FEATURES + 1), np.int64)
        for b in iterator:
            w = Words(b.column("text").to_pylist())
            feats = token_features(w)
            key = np.unique(w.doc[:, None] * FEATURES + feats)
            toxic = np.array(b.column("toxic").to_pylist(), np.int64)
            np.add.at(n, (toxic[key // FEATURES], key % FEATURES), 1)
            n[:, FEATURES] += np.bincount(toxic, minlength=2)
        at = np.flatnonzero(n.sum(0))
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], ["f", "n", "t"])

    rows = sample.mapInArrow(run, "f int, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()
    n = np.zeros((2, FEATURES + 1))
    n[0, rows["f"]], n[1, rows["f"]] = rows["n"], rows["t"]
    all_n, n = n[:, FEATURES], n[:, :FEATURES]
    odds = np.log((n[1] + 0.5) / (all_n[1] + 1)) - np.log((n[0] + 0.5) / (all_n[0] + 1))
    odds[n[1] < max(SUPPORT, SUPPORT_SHARE * all_n[1])] = -np.inf
    odds[0] = -np.inf
    return odds


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> dict | None:
    spark = prepare(docs.sparkSession)
    folder = work_folder(spark, "toxicity")
    both = keep(_sample(docs, labels, per_label), f"{folder}/all").withColumn("from", F.substring("text", 1, ALIKE)).withColumn("to", F.substring("text", -ALIKE, ALIKE))
    for end in ("from", "to"):
        both = both.groupBy(end, F.col("toxic").alias("y")).agg(F.min(F.struct("text", "toxic", "half", "from", "to")).alias("r")).select("r.*")
    both = keep(both.select("text", "toxic", "half").repartition(6), f"{folder}/one")
    cells = {(r["half"], r["toxic"]): r["count"] for r in both.groupBy("half", "toxic").count().collect()}
    few = min(cells.get((h, k), 0) for h in (0, 1) for k in (0, 1)) < 2 * SUPPORT
    sample, apart = (both.where(F.col("half") == h) if not few else both for h in (0, 1))  # too few labels: the same texts train and calibrate
    sample, apart = sample.select("text", "toxic"), apart.select("text", "toxic")
    if not sample.where("toxic = 1").head(1):
        return None
    odds = _lexicon(sample)
    m = {"weights": np.zeros(FEATURES), "bias": -2.0, "trans": np.zeros((2, 2))}
    step = {"weights": np.full(FEATURES, 1e-8), "bias": 1e-8, "trans": np.full((2, 2), 1e-8)}
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast((odds, m))

        def run(iterator, shared=shared):
            lex, model = shared.value
            total, rest = np.zeros(FEATURES), np.zeros(6)
            for b in iterator:
                w = Words(b.column("text").to_pylist())
                if not len(w.start):
                    continue
                feats = token_features(w)
                toxic = np.array(b.column("toxic").to_pylist(), np.int64)
                y = ((lex[feats].max(1) >= ODDS) & (toxic[w.doc] == 1)).astype(np.float64)
                p, f, back, e = marginals(w, feats, model)
                miss = y - p
                total += np.bincount(feats.ravel(), weights=np.repeat(miss, feats.shape[1]), minlength=FEATURES)
                pair = np.flatnonzero(w.doc[1:] == w.doc[:-1])
                a = np.stack([1 / (1 + f[pair]), f[pair] / (1 + f[pair])])
                z = np.stack([np.ones(len(pair)), e[pair + 1] * back[pair + 1]])
                joint = a[:, None] * np.exp(model["trans"])[:, :, None] * z[None]
                joint /= joint.sum((0, 1))
                seen = np.bincount((2 * y[pair] + y[pair + 1]).astype(np.int64), minlength=4)
                rest += np.concatenate([[miss.sum()], seen - joint.sum(2).ravel(), [len(y)]])
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.concatenate([at, FEATURES + np.arange(6)]).astype(np.int32)), pa.array(np.concatenate([total[at], rest]))], ["f", "g"])

        rows = sample.mapInArrow(run, "f int, g double").groupBy("f").agg(F.sum("g").alias("g")).toPandas()
        g = np.zeros(FEATURES + 6)
        g[rows["f"]] = rows["g"]
        size = max(1.0, g[-1]) ** 0.5
        grad = {"weights": g[:FEATURES] / size - DECAY * m["weights"], "bias": g[FEATURES] / size, "trans": g[FEATURES + 1 : FEATURES + 5].reshape(2, 2) / size}
        for k, v in grad.items():  # steps shrink with the gradients a weight has seen
            step[k] = step[k] + v * v
            m[k] = m[k] + RATE * v / np.sqrt(step[k])
        m["weights"][0] = 0.0
        shared.destroy()
    m["calibration"] = _calibrated(apart, m, labels)
    return m


def _aggregates(w: Words, p: np.ndarray) -> np.ndarray:
    """Of each text: expected toxic tokens (log), the largest marginal, and their share of the words."""
    total = np.bincount(w.doc, weights=p, minlength=w.docs)
    n = np.bincount(w.doc, minlength=w.docs)
    top = np.zeros(w.docs)
    np.maximum.at(top, w.doc, p)
    return np.stack([np.log1p(total), top, total / np.maximum(1, n)], 1)


def _calibrated(sample: DataFrame, m: dict, labels: DataFrame) -> list[float]:
    """Logistic weights of the aggregates, fitted on the sample with the labels' own balance."""
    shared = sample.sparkSession.sparkContext.broadcast(m)

    def run(iterator):
        for b in iterator:
            w = Words(b.column("text").to_pylist())
            p = marginals(w, token_features(w), shared.value)[0]
            x = _aggregates(w, p)
            yield pa.record_batch([*(pa.array(x[:, k]) for k in range(3)), pa.array(b.column("toxic").to_pylist(), pa.int32())], ["a", "b", "c", "y"])

    rows = sample.mapInArrow(run, "a double, b double, c double, y int").toPandas()  # as many rows as the sample, at most
    share = labels.agg(F.avg((F.coalesce("toxic", F.lit(0)) == 1).cast("double"))).first()[0] or 0.0
    y = rows["y"].to_numpy(float)
    if not 0 < y.mean() < 1:  # one label only: the share of that label in the labelled table, whatever the text
        odds = np.clip(share, 0.01, 0.99)
        return [0.0, 0.0, 0.0, float(np.log(odds / (1 - odds)))]
    x = np.column_stack([rows[["a", "b", "c"]].to_numpy(), np.ones(len(y))])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(4)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4)
        beta += np.linalg.solve(h, x.T @ (weight * (y - q)) - 0.05 * beta)
    return beta.tolist()


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score and the offending spans (code points, end exclusive) of every text."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.array().cast(SPANS).alias("spans"))
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(iterator):
        m = shared.value
        for held in batches(lambda b: b.column("text"), iterator):
            b = pa.Table.from_batches(held).combine_chunks()
            w = Words(b.column("text").to_pylist())
            p = marginals(w, token_features(w), m)[0]
            x = np.column_stack([_aggregates(w, p), np.ones(w.docs)])
            score = 1 / (1 + np.exp(-np.clip(x @ np.array(m["calibration"]), -30, 30)))
            hot = np.flatnonzero(p >= LIKELY)
            turn = np.concatenate([[True], (hot[1:] != hot[:-1] + 1) | (w.doc[hot[1:]] != w.doc[hot[:-1]])]) if len(hot) else np.zeros(0, bool)
            begin, end = hot[turn], hot[np.append(turn[1:], True)] if len(hot) else hot
            d = w.doc[begin]
            top = np.maximum.reduceat(p[hot], np.flatnonzero(turn)) if len(hot) else np.zeros(0)
            span = pa.StructArray.from_arrays([pa.array(w.start[begin] - w.base[d], pa.int32()), pa.array(w.end[end] - w.base[d], pa.int32()), pa.array(top)], ["start", "end", "score"])
            offsets = pa.array(np.searchsorted(d, np.arange(w.docs + 1)).astype(np.int32))
            yield pa.record_batch([b.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(score), pa.ListArray.from_arrays(offsets, span)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, spans {SPANS}")


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every row."""
    model = fit(docs, labels.where(fold("doc_id", FOLDS) != HELD))
    return predict(docs, model).select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")
