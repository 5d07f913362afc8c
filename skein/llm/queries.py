"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, edit_embedding, langid, line_dedup, mixing, outliers, prefix_trie, quality, runs, simhash, suffix_dedup, token_count, url_filter
from .common import documents, held_out


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edits(documents(spark, sf_dir).select("doc_id", "text"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = documents(spark, sf_dir).select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model")
    found = langid.predict(docs.select("doc_id", "text"), vocabulary, langid.fit(docs, vocabulary))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(documents(spark, sf_dir).select("doc_id", "source", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_count.lengths(token_count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hexadecimal(simhash.classes(documents(spark, sf_dir).select("doc_id", "text")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text")))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find(runs.planted(documents(spark, sf_dir).select("doc_id", "text"))))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_outliers": op6_outliers,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_line_dedup": op12_line_dedup,
    "op13_runs": op13_runs,
}

SQL: dict[str, str] = {
    "op7_mixing": mixing.SQL,
    "op9_url_filter": url_filter.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_line_dedup": line_dedup.SQL,
}
