"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.llm import bpe, decontam, merkle, mixing, near_dup, quality, ring, secrets, suffix_dedup, tiff, tokens, turns, warc_zip
from patternmill.llm.common import table
from patternmill.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = tokens.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85, bands=32, rows=6)


def op9_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return merkle.report(table(spark, sf_dir, "documents"))


def op12_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_tiff": op1_tiff,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_mix": op5_mix,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_near_dup": op8_near_dup,
    "op9_ring": op9_ring,
    "op10_secrets": op10_secrets,
    "op11_merkle": op11_merkle,
    "op12_decontam": op12_decontam,
    "op13_turns": op13_turns,
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op4_warc": warc_zip.ORACLE_SQL,
    "op6_quality": quality.ORACLE_SQL,
    "op8_near_dup": near_dup.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_decontam": decontam.ORACLE_SQL,
    "op13_turns": turns.ORACLE_SQL,
}
