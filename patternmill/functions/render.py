"""Text for people, as columns: search results, repositories, prompts, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.schema import PREVIEW


def search_result(rank: str = "rank") -> Column:
    """Title, else description, else the number; missing parts are left out."""
    title = F.coalesce("title", "description", F.concat(F.lit("Pattern "), F.col(rank).cast("string")))
    lang = F.coalesce("language", F.lit("unknown"))
    part = lambda label, c, end="": F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c, F.lit(end))).otherwise("")
    return F.concat(
        F.lit("### "), F.col(rank).cast("string"), F.lit(". "), title, F.lit("\n**Language:** "), lang, part(" | **Category:** ", F.col("category")),
        part(" | **Quality:** ", F.col("quality_score").cast("string"), "/10"), part("\n**Source:** ", F.coalesce("source_repo", "source_path")),
        F.lit("\n\n```"), lang, F.lit("\n"), F.col("document"), F.lit("\n```\n\n---\n\n"),
    )


def repo_entry() -> Column:
    """X17."""
    known = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return F.concat(
        F.lit("**"), F.col("full_name"), F.lit("** ("), F.when(F.col("is_private"), "[PRIVATE]").otherwise("[PUBLIC]"), F.lit(")\n  Language: "), known("language", "Unknown"),
        F.lit(" | Branch: "), F.col("default_branch"), F.lit("\n  "), known("description", "No description"), F.lit("\n\n"),
    )


def prompt_pattern(rank: str = "rank") -> Column:
    """One reference pattern with a preview of its document."""
    n = F.col(rank).cast("string")
    title = F.coalesce("title", "description", F.concat(F.lit("Pattern "), n))
    return F.concat(
        F.lit("### Pattern "), n, F.lit(": "), title, F.lit(" ("), F.coalesce("language", F.lit("unknown")), F.lit(")\n```\n"), F.substring("document", 1, PREVIEW), F.lit("...\n```\n")
    )


def elapsed(seconds: Column) -> Column:
    """X18."""
    return F.when(seconds >= 60, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.format_string("%.1f", seconds), F.lit("s")))


def with_progress(df: DataFrame) -> DataFrame:
    """Percent and estimated seconds left of (total_files, processed_files, elapsed_s)."""
    done, total = F.col("processed_files"), F.col("total_files")
    percent = F.when(total > 0, F.bround(done * 100.0 / total, 1)).otherwise(0.0)
    left = F.when(done > 0, F.bround(F.col("elapsed_s") / done * (total - done), 1)).otherwise(0.0)
    return df.withColumn("percent", percent).withColumn("eta_s", left)


def progress_report() -> Column:
    """One line of (repo_name, total_files, processed_files, percent, eta_s), or that there is none."""
    told = F.format_string("%s: %d of %d files (%.1f%%), about %s left", "repo_name", "processed_files", "total_files", "percent", elapsed(F.col("eta_s")))
    return F.when(F.col("repo_name").isNull(), "No progress found").otherwise(told)


def stats_lines(counts: DataFrame) -> DataFrame:
    """A line of text per dimension and value, most frequent first; one line that says so if there is none."""
    told = counts.select("dimension", "n", "value", F.format_string("%s | %s: %d", "dimension", "value", "n").alias("line"))
    none = counts.groupBy().agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("dimension"), "n", F.lit("").alias("value"), F.lit("The bank is empty: sync a repository or store a pattern").alias("line"))
    return told.unionByName(none).orderBy("dimension", F.desc("n"), "value").select("line")


def analysis_prompt(template: str) -> Column:
    """Fill {language}, {code}, {context} and {file_path} of a template from the chunk's columns."""
    out = F.lit(template)
    for name, c in (("language", F.col("language")), ("file_path", F.col("file_path")), ("context", F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit("N/A"))), ("code", F.col("content"))):
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out
