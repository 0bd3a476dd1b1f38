"""Statistics and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dimension_counts(bank: DataFrame) -> DataFrame:
    """A2: counts by language, category and source_repo in one scan and one aggregate; missing values are left out."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("language", "category", "source_repo")])
    return bank.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def bar(percent: Column, width: int = 20) -> Column:
    """X16."""
    n = (percent / 5).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def category_distribution(bank: DataFrame) -> DataFrame:
    """Counts by category, null as unknown, with the share of all."""
    counts = bank.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", share).withColumn("bar", bar(F.col("percent"))).withColumn("percent", F.round("percent", 6))


def relabelled(bank: DataFrame, analysis: Column) -> DataFrame:
    """F8 to F16: each row's outcome when it is analyzed again.

    outcome: skipped for an empty document, failed for no analysis, else updated or unchanged by the category.
    """
    old = F.coalesce("category", F.lit("unknown"))
    outcome = (
        F.when(F.coalesce(F.length("document"), F.lit(0)) == 0, "skipped")
        .when(F.col("analysis").isNull(), "failed")
        .when(F.col("analysis.category") != F.col("old_category"), "updated")
        .otherwise("unchanged")
    )
    return bank.withColumn("analysis", analysis).withColumn("old_category", old).withColumn("outcome", outcome)


def outcome_counts(df: DataFrame) -> DataFrame:
    """A5: processed is the sum of the others."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return df.agg(F.count("*").alias("processed"), *[count(o) for o in ("updated", "unchanged", "skipped", "failed")])


def transitions(df: DataFrame) -> DataFrame:
    """Changes of category with their number and rank, most frequent first. There are no more rows than pairs of categories."""
    changed = df.where("outcome = 'updated'")
    counts = changed.groupBy(F.concat("old_category", F.lit(" -> "), "analysis.category").alias("transition")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "transition"))).orderBy("rank")


def ranked_counts(bank: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """dimension_counts with a rank within the dimension, most frequent first, ties by who came first."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("language", "category", "source_repo")])
    counts = bank.select(order, F.explode(pairs).alias("p")).where("p.value IS NOT NULL").groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"), F.min(order).alias("first_seq"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "first_seq", "value"))).drop("first_seq")
