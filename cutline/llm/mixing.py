"""Soft-membership mixing to target weights, with DataFrame functions only (operator 6).

A classifier fitted on the labelled table gives every document its posteriors over domains (multinomial
logistic regression on the words and signs of style that tell the domains apart best). Each document has a rate, the expected number of its
copies; domain k then has sum(tokens * posterior_k * rate) expected tokens. Projected gradient descent fits
rates that are not negative and bring these totals to the targets in the least-squares sense: a step moves
each rate along its posteriors by the residual of all documents, whitened by the domains' Gram matrix, and
cuts it at zero. An iteration is one combining aggregation to as many sums as there are domains; rates are
never stored, they follow from the few residuals of the iterations before.

Defined results: null text: no words, the prior's posteriors, 0 tokens. No labelled rows: one domain `all`,
posterior 1. Labels that are null count as 0 (toxic) and 0 (quality). A domain without tokens keeps its
residual. Repeated doc_ids are rows of their own. Extra columns are ignored by rates, carried along by mix.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare, work_folder

#: Labelled rows the classifier is fitted on (those with the smallest id hash), and words it uses.
SAMPLE, VOCABULARY, SEEN = 4000, 96, 12
SYMBOLS = "*$%&#@^~|<>="
STEPS, TOLERANCE = 25, 1e-6
#: Shares of the domains in the mixture, and its size in relation to the tokens there are.
WEIGHTS = {"good": 0.86, "poor": 0.09, "toxic": 0.05}
BUDGET = 1.1


def domain(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled rows."""
    name = F.when(F.coalesce("toxic", F.lit(0)) == 1, "toxic").when(F.coalesce("quality", F.lit(0)) == 1, "good").otherwise("poor")
    return labels.select("doc_id", name.alias("domain")).groupBy("doc_id").agg(F.max("domain").alias("domain"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\n\r\t.,;:!?", "         "), " "), "")


def with_signs(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns, tokens (words of the text) and w: its distinct words and, as words of their own, steps of how many are distinct and how many symbols it has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*kept, words(text).alias("w"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("odd"))
    rows = rows.select(*kept, "odd", F.size("w").cast("double").alias("tokens"), F.array_distinct("w").alias("w"))
    distinct = F.concat(F.lit("#distinct"), F.floor(10 * F.size("w") / F.greatest(F.col("tokens"), F.lit(1.0))).cast("string"))
    length = F.concat(F.lit("#length"), F.floor(F.log2(F.col("tokens") + 1)).cast("string"))
    odd = F.concat(F.lit("#symbols"), F.least(F.lit(8), F.floor(20 * F.col("odd") / F.greatest(F.col("tokens"), F.lit(1.0)))).cast("string"))
    # Long texts repeat words by nature, so the distinct share is taken within a length step.
    return rows.select(*kept, "tokens", F.concat("w", F.array(odd, F.concat_ws("", distinct, length))).alias("w"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> dict:
    """Domains, the constant of each, and each chosen word's weight for each domain."""
    picked = domain(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    known = with_signs(known, "domain").select("domain", "w")
    known = keep(known, work_folder(docs.sparkSession, "mixing-sample"))
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return {"names": ["all"], "start": [0.0], "weights": {}}
    total = sum(sizes.values())
    counts = known.select("domain", F.explode("w").alias("w")).groupBy("w").agg(*(F.sum((F.col("domain") == k).cast("long")).alias(f"n{i}") for i, k in enumerate(names)))
    n = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    gain = F.lit(0.0)  # mutual information of the domain and the word's presence
    for i, k in enumerate(names):
        for there, base in ((F.col(f"n{i}"), n), (F.lit(sizes[k]) - F.col(f"n{i}"), F.lit(total) - n)):
            gain = gain + F.when(there > 0, there / total * F.log(there * F.lit(float(total)) / (base * F.lit(float(sizes[k]))))).otherwise(F.lit(0.0))
    best = counts.where(n >= SEEN).select("w", *(f"n{i}" for i in range(len(names))), gain.alias("gain")).orderBy(F.desc(F.round("gain", 9)), "w").limit(vocabulary).collect()
    chosen = [r["w"] for r in best]
    if len(names) == 1 or not chosen:
        return {"names": names, "start": [math.log(sizes[k] / total) for k in names], "weights": {}}
    code = F.array_position(F.array(*map(F.lit, names)), F.col("domain")) - 1
    x = array_to_vector(F.transform(F.array(*map(F.lit, chosen)), lambda v: F.array_contains("w", v).cast("double")))
    fitted = LogisticRegression(family="multinomial", regParam=0.003, maxIter=40).fit(known.select(code.cast("double").alias("label"), x.alias("features")))
    matrix = fitted.coefficientMatrix.toArray()
    return {"names": names, "start": fitted.interceptVector.toArray().tolist(), "weights": {w: matrix[:, j].tolist() for j, w in enumerate(chosen)}}


def posteriors(docs: DataFrame, model: dict, *kept: str) -> DataFrame:
    """The kept columns (doc_id, if none are given), tokens (words of the text) and p, the posterior of each domain in the model's order."""
    kept = kept or ("doc_id",)
    rows = with_signs(docs, *kept).select(*kept, "tokens", (F.array_intersect("w", F.array(*map(F.lit, model["weights"]))) if model["weights"] else F.array().cast("array<string>")).alias("hits"))
    table = F.create_map(*(x for w, v in model["weights"].items() for x in (F.lit(w), F.array(*map(F.lit, v))))) if model["weights"] else None
    start = F.array(*map(F.lit, model["start"]))
    score = F.aggregate("hits", start, lambda s, w: F.zip_with(s, F.element_at(table, w), lambda a, b: a + b)) if table is not None else start
    rows = rows.select(*kept, "tokens", score.alias("s"))
    top = F.array_max("s")
    odds = rows.select(*kept, "tokens", F.transform("s", lambda x: F.exp(x - top)).alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return odds.select(*kept, "tokens", F.transform("e", lambda x: x / whole).alias("p"))


def rate(p: Column, steps: list[list[float]]) -> Column:
    """Rate after some steps: each adds the product with the posteriors, cut at zero; the first rate is 1. p must be a stored column, since each step reads it."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    return F.aggregate(moves, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r + F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)))


def solve(members: DataFrame, names: list[str], weights: dict[str, float], budget: float) -> tuple[list[list[float]], dict]:
    """Steps of the projected gradient descent, and the totals before and after."""
    k = len(names)
    p = [F.col("p")[i] for i in range(k)]
    sums = [F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("tokens") * p[i]).alias(f"t{i}") for i in range(k)]
    row = members.agg(*sums).first()
    now = np.array([row[f"t{i}"] or 0.0 for i in range(k)])
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    share = np.array([weights.get(n, 0.0) for n in names]) if any(weights.get(n) for n in names) else now
    target = share / max(share.sum(), 1e-12) * now.sum() * budget
    whiten = np.linalg.pinv(gram + 1e-9 * max(gram.trace(), 1e-9) * np.eye(k))
    steps, before = [], now.tolist()
    for _ in range(STEPS):
        residual = target - now
        if np.abs(residual).sum() <= TOLERANCE * max(1.0, target.sum()):
            break
        steps.append([float(x) for x in whiten @ residual])
        got = members.select("tokens", "p", rate(F.col("p"), steps).alias("r")).agg(*(F.sum(F.col("tokens") * F.col("p")[i] * F.col("r")).alias(f"t{i}") for i in range(k))).first()
        now = np.array([got[f"t{i}"] or 0.0 for i in range(k)])
    if k > 1 and np.abs(target - now).sum() > 0.01 * max(1.0, target.sum()):
        raise RuntimeError(f"the totals {now.tolist()} miss the targets {target.tolist()} by more than 1 % after {STEPS} steps")
    return steps, {"domains": names, "before": before, "target": target.tolist(), "after": now.tolist()}


def _fitted(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None, budget: float, rows: DataFrame | None = None, *kept: str):
    """The members of the mixture (written once: kept columns of rows, tokens, p), the steps and the report."""
    spark = prepare(docs.sparkSession)
    model = fit(docs, labels)
    members = keep(posteriors(docs if rows is None else rows, model, *kept), work_folder(spark, "mixing"))
    return members, *solve(members, model["names"], WEIGHTS if weights is None else weights, budget)


def _copies(rows: DataFrame, doc_id: Column, steps: list[list[float]], *kept: str) -> DataFrame:
    """rows (the kept columns, p) with the rate and the copies: its whole part, and one more with the probability of the rest, by the id's hash."""
    out = rows.select(*kept, "p", F.round(rate(F.col("p"), steps), 9).alias("rate"))
    chance = F.pmod(F.xxhash64(doc_id, F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return out.withColumn("copies", copies)


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET) -> tuple[DataFrame, dict]:
    """doc_id, tokens, p (posteriors), rate and copies of every document; and a report of the totals."""
    members, steps, report = _fitted(docs, labels, weights, budget)
    return _copies(members, F.col("doc_id"), steps, "doc_id", "tokens"), report


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """The rows of docs, all columns, each as often as its copies say.

    Rows are written once with their posteriors, and copies follow from these, so texts aren't shuffled; rows of one id with different texts have rates of their own,
    and rows with a null id count like others.
    """
    row = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row of it"))
    members, steps, _ = _fitted(docs, labels, weights, budget, row, "row of it")
    got = _copies(members, F.col("row of it.doc_id"), steps, "row of it")
    again = got.select("row of it", F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))).alias("copy of it"))
    return again.where(F.col("copy of it").isNotNull()).select(*(F.col("row of it")[c].alias(c) for c in docs.columns))
