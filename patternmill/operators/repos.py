"""Repositories and their files: visibility, exclusions, routing, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternmill.functions.paths import matches_any
from patternmill.schema import BATCH_FILES, EXCLUDED_REPOS, LARGE_REPO_FILES


RAW_REPO = "full_name string, name string, description string, language string, private boolean, default_branch string, html_url string, owner struct<login: string>"


def repo_info(raw: DataFrame) -> DataFrame:
    """Repositories as the service describes them (RAW_REPO) as rows of their own; a missing private flag counts as public."""
    return raw.select("full_name", "name", "description", "language", F.coalesce("private", F.lit(False)).alias("is_private"), F.coalesce("default_branch", F.lit("main")).alias("default_branch"), F.col("html_url").alias("url"), F.col("owner.login").alias("owner"))


def repo_listing(spark: SparkSession, path: str) -> DataFrame:
    """A dump of repositories as JSON lines; lines that are broken are left out."""
    return repo_info(spark.read.schema(RAW_REPO).json(path).where("full_name IS NOT NULL"))


def listed(repos: DataFrame, me: str | None = None, include_private: bool = True, include_orgs: bool = True, excluded: list[str] | None = None) -> DataFrame:
    """Repositories by visibility and owner, without those whose name matches an excluded pattern."""
    if not include_private:
        repos = repos.where(~F.col("is_private"))
    if not include_orgs:
        repos = repos.where(F.col("owner") == me)
    return repos.where(~matches_any(F.col("name"), EXCLUDED_REPOS if excluded is None else excluded))


def routes(files: DataFrame, repo: str = "repo", limit: int = LARGE_REPO_FILES) -> DataFrame:
    """the number of files of each repository, and batch for those of over the limit."""
    counts = files.groupBy(repo).agg(F.count("*").alias("n_files"))
    return counts.withColumn("route", F.when(F.col("n_files") > limit, "batch").otherwise("single"))


def batches(files: DataFrame, repo: str = "repo", order: str = "ingest_seq", size: int = BATCH_FILES, block: int = 4096) -> DataFrame:
    """Number consecutive files of a repository in batches; order holds whole numbers.

    Numbered within blocks of the order and then by how many files earlier blocks hold, so that no task sorts all
    files of a very large repository. Nulls in repo are a repository of their own.
    """
    cut = files.withColumn("__block", F.floor(F.col(order) / block))
    before = Window.partitionBy("__repo").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy(F.col(repo).alias("__repo"), F.col("__block").alias("__b")).agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(repo, "__block").orderBy(order)) - 1
    numbered = cut.withColumn("__k", within).join(bases, F.col(repo).eqNullSafe(F.col("__repo")) & F.col("__block").eqNullSafe(F.col("__b")))
    return numbered.withColumn("batch_no", F.floor((F.col("__base") + F.col("__k")) / size).cast("int")).select(*files.columns, "batch_no")
