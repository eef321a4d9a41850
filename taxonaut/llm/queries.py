"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from taxonaut.llm import jaccard, kd_trees, langid, metric_join, neighbours, pitman_yor, spelling, sql, substrings, warc, whitening
from taxonaut.llm.common import held_out, load
from taxonaut.llm.packing import pack
from taxonaut.llm.pieces import encode_and_decode
from taxonaut.llm.secrets import scan
from taxonaut.llm.vectors import finite, fixed_point


def op1_best_fit_packing(spark, sf_dir):
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_lm_scoring(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return pitman_yor.score(docs, held_out("doc_id", 5))


def op3_substring_dedup(spark, sf_dir):
    return substrings.digest(load(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    return encode_and_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_warc_revisits(spark, sf_dir):
    return warc.archive(load(spark, sf_dir, "pages"))


def op6_embedding_near_dedup(spark, sf_dir):
    return metric_join.near_duplicates(load(spark, sf_dir, "embeddings"))


def op8_nearest_neighbours(spark, sf_dir):
    return neighbours.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op9_secret_scans(spark, sf_dir):
    return scan(load(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 3))
    trees = langid.fit(docs, ~F.col("held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), trees).select("doc_id", "held_out", "lang_pred", "score")


def op11_embedding_whitening(spark, sf_dir):
    offset = 1_000_000
    rows = load(spark, sf_dir, "embeddings").where(finite()).select("vec_id", fixed_point(64, offset).alias("x"))
    fit = whitening.fit(rows, "x", pad=offset)
    return whitening.whiten(rows, fit, "x", "vec_id", most=32)


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.occurrences(load(spark, sf_dir, "documents")))


def op13_exact_top_k(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").where(finite()).select("vec_id", fixed_point(1024).alias("embedding"))
    return kd_trees.search(rows, F.col("vec_id") % 100 == 0, k=10)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return dict(sql.QUERIES)
