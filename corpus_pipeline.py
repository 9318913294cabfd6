"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

1. language_id: rows in no learned language (no text, no letter, or mostly letters of scripts that no learned language uses) go.
2. ngram_jaccard: of each group of near copies (5-word Jaccard of at least 0.8) the document with the smallest doc_id stays.
3. secret_scan: secrets in the text become a mark; every row stays.
4. mixing: rows are kept, dropped or repeated as the fitted rates of their domains say.
5. byte_bpe: texts become token ids, which are decoded again to confirm them; every row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutline.llm import bytebpe, jaccard, langid, mixing, secrets
from cutline.llm.common import keep, prepare, table, work_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The near-copy stage's contract; the 4 words and 85 % are those of the query op10_ngram_jaccard.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return langid.keep_known(docs, langid.fit(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs.select(*COLUMNS), NEAR_WORDS, NEAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytebpe.encode_rows(docs, columns=["doc_id", "lang", "source", "n_chars"], confirm=True).drop("offsets")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("mixing", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: The stages are models, iterations and a tokenizer, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; the output of each is written to the shared folder and read again."""
    folder = work_folder(prepare(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
