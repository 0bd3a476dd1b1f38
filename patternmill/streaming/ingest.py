"""Resumable ingestion in small batches with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patternmill.operators.analyze import mock_analysis
from patternmill.plans.sync import Analyzer, chunked, found_in
from patternmill.schema import BATCH_FILES
from patternmill.session import delete

FILES = "repo string, file_path string, language string, content string, ingest_seq long"


def ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, analyzer: Analyzer | None = mock_analysis, min_quality: int = 5, files_per_batch: int = BATCH_FILES, on_batch: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Read new Parquet files of file rows from source, write their points below target, then stop.

    The checkpoint remembers which files are done, so a restart goes on where the last run ended and does none twice:
    each batch writes to a folder of its own number, and one that is run again replaces it.
    """
    rows = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        found_in(chunked(batch), analyzer, min_quality).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch:
            on_batch(batch, number)

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The points that ingest has written, the last of each id."""
    from patternmill.operators.bank import latest

    return latest(spark.read.parquet(target).drop("batch"))


def progress(query: StreamingQuery) -> list[dict]:
    """Batch number and rows of each batch."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]


def remaining(files: DataFrame, done: DataFrame) -> DataFrame:
    """The files that are not done yet."""
    return files.join(done.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")


def sampled(df: DataFrame, every: int, order: str) -> DataFrame:
    """Each n-th step of a progress log, counted from 0."""
    return df.where(F.col(order) % every == 0)


PROGRESS = "repo_name string, total_files long, processed_files long, failed_files array<struct<path: string, error: string>>, elapsed_s double"


def progress_of(files: DataFrame, done: DataFrame, failed: DataFrame, elapsed_s: float) -> DataFrame:
    """Per repository how far an ingestion is, with its failures (repo, file_path, error), five of them and how many more."""
    total = files.groupBy("repo").agg(F.count("*").alias("total_files"))
    processed = done.select("repo", "file_path").distinct().groupBy("repo").agg(F.count("*").alias("processed_files"))
    joined = total.join(processed, "repo", "left").join(first_failures(failed), "repo", "left")
    return joined.select(F.col("repo").alias("repo_name"), "total_files", F.coalesce("processed_files", F.lit(0)).alias("processed_files"), "failed_files", F.coalesce("more_failed", F.lit(0)).alias("more_failed"), F.lit(float(elapsed_s)).alias("elapsed_s"))


def first_failures(failed: DataFrame, order: str = "file_path", n: int = 5) -> DataFrame:
    """Per repository the first failures (repo, file_path, error) by an order, as failed_files, and how many more there are."""
    ranked = failed.withColumn("__n", F.row_number().over(Window.partitionBy("repo").orderBy(order))).where(F.col("__n") <= n)
    few = ranked.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("__n", F.struct(F.col("file_path").alias("path"), "error").alias("f")))).alias("__few"))
    count = failed.groupBy("repo").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more_failed"))
    return few.select("repo", F.transform("__few", lambda x: x["f"]).alias("failed_files")).join(count, "repo")


LOG = "repo string, file_path string, chunks long, stored long, error string, finished_at double"


def logged(files: DataFrame, tried: DataFrame, new: DataFrame, finished_at: float) -> DataFrame:
    """A row (LOG) for each file of a batch: how many chunks and points it gave, or why it failed."""
    names = ["repo", "file_path"]
    one = tried.groupBy(*names).agg(F.count("chunk_no").alias("chunks"), F.max("error").alias("error"))
    two = new.groupBy(F.col("source_repo").alias("repo"), F.col("source_path").alias("file_path")).agg(F.count("*").alias("stored"))
    joined = files.select(*names).distinct().join(one, names, "left").join(two, names, "left")
    return joined.select(*names, F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("stored", F.lit(0)).alias("stored"), "error", F.lit(float(finished_at)).alias("finished_at"))


def progress_from(log: DataFrame, total_files: int, started_at: float) -> DataFrame:
    """T4: how far each repository in a log is: files, chunks and points so far, its first failures, and the seconds it took.

    A file that was done more than once, as it changed, counts once, with what its last time gave.
    """
    last = log.groupBy("repo", "file_path").agg(F.max_by(F.struct("chunks", "stored", "error", "finished_at"), "finished_at").alias("l")).select("repo", "file_path", "l.*")
    sums = last.groupBy("repo").agg(F.count("*").alias("processed_files"), F.sum("chunks").alias("total_chunks"), F.sum("stored").alias("stored_patterns"), (F.max("finished_at") - started_at).alias("elapsed_s"))
    joined = sums.join(first_failures(last.where("error IS NOT NULL")), "repo", "left")
    return joined.select(
        F.col("repo").alias("repo_name"), F.lit(total_files).cast("long").alias("total_files"), "processed_files", "total_chunks", "stored_patterns", "failed_files", F.coalesce("more_failed", F.lit(0)).alias("more_failed"), "elapsed_s"
    )


def clear(spark: SparkSession, checkpoint: str) -> bool:
    """T4: forget what is done, so the next run starts anew; whether there was anything."""
    return delete(spark, checkpoint)
