"""A training corpus from raw documents, in five stages.

Each stage works on all that its predecessor kept, is written as Parquet and
read again. All stages but the last return the columns of documents.

* language_id: documents without a letter, or whose best language has a mean
  probability under ``MIN_SCORE``, go.
* near_dedup: of each group of documents linked by a Jaccard similarity of 0.8
  or more on five-word shingles, the one with the smallest doc_id stays.
* substring_dedup: words covered by a window of 20 words that starts earlier
  are removed; a document that loses all its words goes.
* secret_scan: spans are replaced by a mark; no document goes.
* packing: the remaining texts become pieces of sequences of 2048 tokens.

Rows with null or repeated ids and equal texts are judged as each operator
states: rows without a text or a letter go in the first stage, and of documents
with equal texts the smallest id stays, null after all others. An empty table
passes through. Extra columns stay up to the last stage, whatever their names.

SQL can't express the first stage (a trained model), the second (hash families
with densification) or the last (greedy retrieval), so there is no ORACLE_SQL;
the tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm import langid, minhash, packing, queries, secrets, substring
from fieldtrust.llm.common import cut, fresh

MIN_SCORE = 0.5
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    label, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    judged = langid.predict(docs, langid.train(docs), label=label, score=score)
    return judged.where((F.col(label) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs, size=5, percent=80).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_words, n_removed = (F.col(fresh(docs, c)) for c in ("n_words", "n_removed"))
    return _measured(substring.dedup(docs).where((n_removed == 0) | (n_removed < n_words)), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_digest(docs, queries.tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
