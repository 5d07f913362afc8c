"""The training corpus pipeline: each stage takes what the one before it kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, common, langid, mixing, simhash, suffix_dedup


#: Bytes from which a repeated string is cut out.  Passages of more than 50 words have 270 or more in every language of the tables.
REPEATED = 240


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return langid.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by five-word shingles, the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 240 bytes that occur again are cut out of all texts; n_chars follows.

    Documents of which nothing is left go.
    """
    whole = F.size("removed") == 0
    cut = suffix_dedup.dedup(docs, length=REPEATED, trim=True).where(whole | (F.length("text") > 0))
    return cut.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, checked by decoding them."""
    encoded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("repeats", remove_repeats),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The model of a language, chains of near copies and the merging of tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = common.documents(spark, sf_dir)
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
