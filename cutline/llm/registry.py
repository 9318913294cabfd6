"""Queries of the numbered operators and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import bytebpe, filters, huffman, jaccard, langid, media, merkle, minhash, mixing, pii, secrets, topk, toxicity
from .common import table


def op1_language_id(spark, sf_dir):
    return langid.op1_language_id(spark, table(spark, sf_dir, "documents"))


def op2_token_ids(spark, sf_dir):
    return huffman.round_trip(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    return bytebpe.digests(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark, sf_dir):
    """doc_id, tokens, posteriors by domain, rate and copies of every document."""
    rows, report = mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = report["domains"]
    return rows.select("doc_id", "tokens", *(rows.p[i].alias(f"p_{k}") for i, k in enumerate(names)), "rate", "copies")


def op7_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_top_k(spark, sf_dir):
    return topk.op8_top_k(table(spark, sf_dir, "embeddings"))


def op9_media(spark, sf_dir):
    return media.op9_media(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark, sf_dir):
    """The contract of this query: sets of 4 words, 85 %."""
    return jaccard.components(table(spark, sf_dir, "documents"), 4, 85)


def op11_merkle(spark, sf_dir):
    return merkle.op11_merkle(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_minhash(spark, sf_dir):
    """The contract of this query: sets of 4 words, 80 %."""
    return minhash.duplicates(table(spark, sf_dir, "documents"), 4, 80)


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_token_ids, op3_byte_bpe, op4_pii, op5_toxicity, op6_mixing, op7_secret_scan, op8_top_k, op9_media, op10_ngram_jaccard, op11_merkle, op12_filter_audit, op13_minhash, pipeline)
}
ORACLES: dict[str, str] = {"op8_top_k": topk.ORACLE, "op11_merkle": merkle.ORACLE, "op12_filter_audit": filters.ORACLE}
