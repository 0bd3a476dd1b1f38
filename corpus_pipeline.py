"""The corpus pipeline: documents in, token ids of the cleaned, mixed corpus out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet to the shared folder and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.llm import bpe, mixing, near_dup, quality, secrets
from patternmill.llm.common import table
from patternmill.llm.queries import tokenizer_path
from patternmill.session import forget, fresh_path, scratch, ship, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes; no rows give no rows."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its shingles of five words, that with the smallest doc_id."""
    ship(spark)
    return near_dup.kept_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked in their texts."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as the mix takes them: a document gives up to two rows, or none."""
    return mixing.mixed_texts(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, with digests of the ids and of the text decoded from them."""
    ship(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    both = bpe.recode_bpe(docs.select("doc_id", "lang", "source", "text"), path)
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]

#: The sketches, hashes, forest and tokenizer have no SQL form; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; what a stage wrote on the way, and the result before it, goes when its own is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            made = written(stage(spark, docs, sf_dir), path)
        if k:
            forget(docs)
        docs = made
    return docs
