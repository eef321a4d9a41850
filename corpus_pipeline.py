"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents. run() writes each result as Parquet in the shared
checkpoint folder and rereads it. Null and empty texts are rejected by the first stage (they
have no language); an empty table stays empty; further columns of the table are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from taxonaut.llm import jaccard, langid, packing, secrets, substrings
from taxonaut.llm.common import load, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Posterior of the predicted language below which a document is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told: texts with letters and a clear winner. Trees are fitted on a bounded sample of `docs`."""
    docs = docs.select(*COLUMNS)
    guessed = langid.predict(docs, langid.fit(docs, F.lit(True)))
    return guessed.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group linked by five-word shingles with similarity of 0.8 or more.

    Documents with a null id stay; rows that share a doc_id stay or go together.
    """
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"), k=5, num=80, den=100)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words in passages of 20 words that also start earlier; a document without a word left goes.

    Texts that lose nothing are unchanged; of others the words left are joined by one space.
    """
    found = substrings.deduplicate(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets found in its text redacted."""
    return secrets.redact(docs.select(*COLUMNS)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with the sequences and offsets they are packed at."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages. tests/llm holds the operators against brute force, planted cases against each stage, and run()'s count against the chained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
