"""From files to the bank: chunk, analyze, gate, project, id, upsert, and the summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.operators.analyze import fallback_patterns, mock_analysis, patterns, quality_gate
from patternmill.operators.bank import point_id, upsert
from patternmill.operators.scanners import Chunker, extracted

Analyzer = Callable[[], Column]


def points(patterns_: DataFrame) -> DataFrame:
    """Give patterns their ids."""
    return patterns_.withColumn("point_id", point_id(F.col("source_repo"), F.col("source_path"), F.col("document")))


def tried(files: DataFrame, chunker: Chunker | None = None, retries: int = 1, delay: float = 1.0) -> DataFrame:
    """Chunks of files (repo, file_path, language, content, ingest_seq), and a row with an error for each file that gave up.

    Empty files (F11) and empty chunks give none. ingest_seq numbers the chunks of a file in order: that of the file
    times 2^20 plus the chunk's number.
    """
    rows = extracted(files.where(F.length("content") > 0), chunker=chunker, retries=retries, delay=delay)
    return rows.withColumn("ingest_seq", F.shiftleft(F.col("ingest_seq").cast("long"), 20) + F.coalesce("chunk_no", F.lit(0)))


def chunked(files: DataFrame) -> DataFrame:
    """The chunks of tried alone."""
    return tried(files).where("error IS NULL").drop("error")


def failures(rows: DataFrame) -> DataFrame:
    """(repo, file_path, error) of the files that gave up."""
    return rows.where("error IS NOT NULL").select("repo", "file_path", "error")


def found_in(chunks: DataFrame, analyzer: Analyzer | None = mock_analysis, min_quality: int = 5) -> DataFrame:
    """The points of chunks; without an analyzer all chunks become points as they are."""
    if analyzer is None:
        return points(fallback_patterns(chunks))
    return points(patterns(quality_gate(chunks.withColumn("analysis", analyzer()), min_quality)))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(file_path, change) of all files (file_path, digest) now and before: same, new, changed or gone."""
    old = before.select(F.col("file_path").alias("__path"), F.col("digest").alias("__digest"))
    joined = now.select("file_path", "digest").join(old, F.col("file_path") == F.col("__path"), "full_outer")
    change = F.when(F.col("__path").isNull(), "new").when(F.col("file_path").isNull(), "gone").when(F.col("digest") == F.col("__digest"), "same").otherwise("changed")
    return joined.select(F.coalesce("file_path", "__path").alias("file_path"), change.alias("change"))


def sync(files: DataFrame, bank: DataFrame, analyzer: Analyzer | None = mock_analysis, min_quality: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new bank, the points written, and the chunks, as plans; PatternBank.sync writes each step once."""
    chunks = chunked(files)
    new = found_in(chunks, analyzer, min_quality)
    return upsert(bank, new), new, chunks


def summary(files: DataFrame, chunks: DataFrame, new: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Per repository files, chunks, writes and distinct points, and failed files where they are given."""
    one = files.groupBy("repo").agg(F.count("*").alias("files"))
    two = chunks.groupBy("repo").agg(F.count("*").alias("chunks"))
    three = new.groupBy(F.col("source_repo").alias("repo")).agg(F.count("*").alias("stored"), F.count_distinct("point_id").alias("distinct_points"))
    out = one.join(two, "repo", "left").join(three, "repo", "left")
    if failed is not None:
        out = out.join(failed.groupBy("repo").agg(F.count("*").alias("failed")), "repo", "left")
    return out.na.fill(0)
