"""Analysis of chunks: the offline analyzer, the quality gate, patterns from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.schema import LANGUAGES


def mock_analysis(content: str = "content", kind: str = "chunk_type", name: str = "name", path: str = "file_path") -> Column:
    """Classes and functions of over 200 characters are patterns of quality 6, all else has 3."""
    is_pattern = (F.length(content) > 200) & F.col(kind).isin("class", "function")
    return F.struct(
        is_pattern.alias("is_pattern"),
        F.concat(F.lit("Pattern from "), F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("code"))).alias("title"),
        F.concat(F.lit("A "), F.col(kind), F.lit(" extracted from "), F.col(path)).alias("description"),
        F.lit("other").alias("category"),
        F.when(is_pattern, 6).otherwise(3).alias("quality_score"),
        F.array(F.lit("General use")).alias("use_cases"),
    )


def quality_gate(df: DataFrame, min_quality: int = 5) -> DataFrame:
    """patterns of at least that quality; rows without analysis go."""
    return df.where(F.col("analysis.is_pattern") & (F.col("analysis.quality_score") >= min_quality))


def patterns(df: DataFrame) -> DataFrame:
    """Analyzed chunks as patterns."""
    return df.select(
        "ingest_seq", F.col("content").alias("document"), "analysis.title", "analysis.description", "analysis.category", "language", "analysis.quality_score", F.col("repo").alias("source_repo"), F.col("file_path").alias("source_path"), "analysis.use_cases"
    )


def fallback_patterns(df: DataFrame) -> DataFrame:
    """Chunks as patterns without analysis."""
    return df.select(
        "ingest_seq",
        F.col("content").alias("document"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Pattern from "), F.col("file_path"))).alias("title"),
        F.concat(F.lit("Code "), F.col("chunk_type"), F.lit(" from "), F.col("file_path")).alias("description"),
        F.lit("other").alias("category"),
        "language",
        F.lit(5).alias("quality_score"),
        F.col("repo").alias("source_repo"),
        F.col("file_path").alias("source_path"),
        F.array().cast("array<string>").alias("use_cases"),
    )


def patterns_or_fallback(chunks: DataFrame, analysis: Column | None, min_quality: int = 5, fallback: str = "on_error") -> DataFrame:
    """Patterns of the chunks; with fallback on_empty also all chunks as they are if no chunk passes the gate."""
    if analysis is None:
        return fallback_patterns(chunks)
    found = patterns(quality_gate(chunks.withColumn("analysis", analysis), min_quality))
    if fallback == "on_empty" and not found.limit(1).count():
        return fallback_patterns(chunks)
    return found


def chunk_of(bank: DataFrame) -> DataFrame:
    """Bank rows as chunks for another analysis."""
    return bank.select(
        "*",
        F.col("document").alias("content"),
        F.coalesce("source_path", F.lit("")).alias("file_path"),
        F.lit("unknown").alias("chunk_type"),
        F.col("title").alias("name"),
        F.when(F.col("language").isin(LANGUAGES), F.col("language")).otherwise("unknown").alias("chunk_language"),
    )
