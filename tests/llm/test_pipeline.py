"""Stages of the corpus pipeline on small rows."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_by_the_stage_contract(spark):
    words = [f"w{i}" for i in range(49)]
    near = words[:24] + ["other"] + words[25:]  # 5-word Jaccard 40/50, 4-word 42/50
    far = words[:20] + ["other"] + words[21:28] + ["more"] + words[29:]  # 5-word Jaccard 35/55
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([words, near, far])]
    kept = corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
