"""The bank's methods in one place; each returns a DataFrame, and errors are exceptions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternmill.config import Config
from patternmill.functions import render
from patternmill.operators import analyze, bank as bank_ops, cache, repos, scaffold, search, stats, validate
from patternmill.operators.embed import Embedder, HashEmbedder
from patternmill.operators.scanners import Chunker
from patternmill.plans import sync as plan
from patternmill.schema import CATEGORIES, EXTENSIONS, MODELS
from patternmill.session import delete, exists, forget, ship, stored
from patternmill.sources.files import code_files, discovered, local_files, tree
from patternmill.sources.derived import ClusteredBank
from patternmill.sources.tables import BankTable, FileTable
from patternmill.sources.vector_index import VectorIndex
from patternmill.streaming import ingest
from patternmill.streaming.progress import Progress, Watch


def _now() -> int:
    """Milliseconds; orders what several syncs write."""
    return int(time.time() * 1000)


class PatternBank:
    """A pattern bank at a path. The configuration sets weights, limits, batches and ignored folders; analyzer and embedder are plug-points."""

    def __init__(self, spark: SparkSession, path: str, analyzer: plan.Analyzer | None = analyze.mock_analysis, config: Config = Config(), embedder: Embedder | None = None):
        ship(spark)
        self.spark, self.table, self.config = spark, BankTable(spark, path), config
        self.index = VectorIndex(spark, f"{self.table.path}/_index")
        self.clustered = ClusteredBank(spark, f"{self.table.path}/_clustered")
        self.analyzer = analyzer if config.batch.analyze else None
        self.embedder = embedder or HashEmbedder()
        self.table.create()

    def read(self) -> DataFrame:
        return self.table.read()

    def _embedded(self, new: DataFrame, seen: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The points with their vectors, written once, where the bank's next version has them."""
        return self.table.staged(new.withColumn("embedding", self.embedder.column(F.col("document"))), seen)

    def store(self, rows: DataFrame, dedup: bool = False) -> DataFrame:
        """Add patterns (content, title, description, category, language, quality_score, ...); returns the rows that were refused.

        Without dedup each row is a point of its own, as ids are random.
        """
        told = rows.withColumn("errors", validate.store_errors("quality_score" in rows.columns))
        bad, good = told.where(F.size("errors") > 0), told.where(F.size("errors") == 0)
        default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)
        new = good.select(
            F.col("content").alias("document"), "title", "description", F.lower("category").alias("category"), F.lower("language").alias("language"),
            default("quality_score", 5).cast("int").alias("quality_score"), default("source_repo", "manual").alias("source_repo"), default("source_path", "").alias("source_path"),
            F.lit(_now() << 20).cast("long").alias("ingest_seq"),
        )
        new = bank_ops.latest(plan.points(new)) if dedup else new.withColumn("point_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))
        new = self._embedded(new)
        self.table.merge(new)
        self.table.unstage(new)
        return bad

    def build_index(self, cells: int | None = None) -> int:
        """Index the vectors of all patterns; searches use the index from then on, and take over what has changed."""
        return self.index.build(self.table, cells)

    def build_clusters(self) -> int:
        """Lay the patterns out by language and category too; filtered searches without an index read that from then on."""
        return self.clustered.build(self.table)

    def search(
        self, query: str, language: str | None = None, category: str | None = None, min_quality: int = 5, limit: int = 10, candidate_cap: int | None = -1, hybrid: bool | None = None, probes: int | None = None
    ) -> DataFrame:
        """The best patterns with their scores, rank and rendered text; cap and hybrid are the configuration's unless given.

        With an index, probes limits the cells that are read; without probes the answer is that of a whole scan.
        """
        row = self.spark.createDataFrame([(query, limit, min_quality, language, category)], "query string, limit int, min_quality int, language string, category string")
        if errors := row.select(validate.search_errors().alias("e")).first()["e"]:
            raise ValueError(f"not valid: {', '.join(errors)}")
        own, vector = self.config.search, self.embedder.query(query)
        cap, enabled = own.candidate_cap if candidate_cap == -1 else candidate_cap, own.enabled if hybrid is None else hybrid
        if self.index.built():
            self.index.refresh(self.table)
            n = limit if not enabled else search.OVERFETCH * limit if cap is None else min(search.OVERFETCH * limit, cap)
            found = self.index.candidates(vector, n, probes, lambda rows: search.matching(rows, language, category, min_quality)).drop("cell", "closeness", "digest")
        elif self.clustered.built():
            self.clustered.refresh(self.table)
            found = search.matching(self.clustered.candidates(language, category, min_quality), language, category, min_quality)
        else:
            found = search.matching(self.read(), language, category, min_quality)
        top = search.hybrid_top(found, query, vector, limit, cap, enabled, own.semantic_weight, own.keyword_weight)
        return top.withColumn("rendered", render.search_result())

    def gather_patterns(self, kind: str, stack: list[str], limit: int = 5) -> DataFrame:
        """The patterns nearest to a project's kind and stack, without filter or reranking; none if that cannot be asked."""
        told = self.spark.range(1).select(search.scaffold_query(F.lit(kind), F.array(*[F.lit(s) for s in stack]).cast("array<string>")).alias("q")).first()["q"]
        top = search.semantic_top(self.read(), self.embedder.query(told), limit)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("semantic"), "point_id")))

    def sync(self, files: DataFrame, min_quality: int | None = None, chunker: Chunker | None = None) -> DataFrame:
        """Chunk, analyze and upsert files (repo, file_path, language, content, ingest_seq); returns the summary, with failed files.

        Chunks and points are written once, only new points are embedded, and only the bank's buckets that they fall in
        are written anew.
        """
        own = self.config.batch
        tried = stored(plan.tried(files, chunker, own.max_retries, own.retry_delay), "chunks")
        chunks = tried.where("error IS NULL").drop("error")
        new = self._embedded(plan.found_in(chunks, self.analyzer, own.min_quality if min_quality is None else min_quality))
        self.table.merge(new)
        told = stored(plan.summary(files, chunks, new, plan.failures(tried)), "summary")
        forget(tried)
        self.table.unstage(new)
        return told

    def sync_folder(self, root: str, repo: str, min_quality: int | None = None) -> DataFrame:
        """sync for the code files below a folder; of several syncs the last one wins."""
        found = code_files(tree(self.spark, root, self.config.ignored_dirs, list(EXTENSIONS)))
        return self.sync(found.select(F.lit(repo).alias("repo"), F.col("path").alias("file_path"), "language", "content", F.lit(_now()).cast("long").alias("ingest_seq")), min_quality)

    def resync(self, files: DataFrame, repo: str, min_quality: int | None = None, chunker: Chunker | None = None) -> DataFrame:
        """Make the bank hold what a repository's files are now: files (as for sync) are all of them; one row of counts.

        Digests of the files of the last time tell which are new, changed or gone; only new and changed ones are chunked,
        analyzed and embedded. Points of such files whose chunk is no longer there are deleted, in the same version that
        adds the new ones. A file that fails keeps its points and is tried again the next time. Of rows with the same
        path the last one counts. Digests are written after the bank: what ends in between is done again, to the same end.
        """
        own, digests = self.config.batch, FileTable(self.spark, f"{self._sync_home(repo)}-files")
        digests.create()
        held = files.where(F.col("repo") == repo).select("file_path", "repo", "language", "content", "ingest_seq")
        written = stored(held.withColumn("digest", F.md5(F.coalesce("content", F.lit("")))), "resync-files")
        now = bank_ops.last_rows(written, "file_path")
        base = digests.versions()[-1]
        before = digests.read(base)
        state = plan.changes(now.select("file_path", "digest"), before)
        told = stored(state, "resync-changes")
        counts = told.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("same", "new", "changed", "gone")])
        work = now.where("file_path IS NOT NULL") if told.where("change = 'same'").isEmpty() else now.join(told.where("change IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
        work = work.select("repo", "file_path", "language", "content", "ingest_seq")
        tried = stored(plan.tried(work, chunker, own.max_retries, own.retry_delay), "chunks")
        failed = plan.failures(tried).select("file_path").distinct()
        new = self._embedded(plan.found_in(tried.where("error IS NULL").drop("error"), self.analyzer, own.min_quality if min_quality is None else min_quality))
        done = told.where("change <> 'same'").join(failed, "file_path", "left_anti").select("file_path")
        old = self.read().where(F.col("source_repo") == repo).join(done.withColumnRenamed("file_path", "source_path"), "source_path", "left_semi").select("point_id")
        gone = stored(old.join(new.select("point_id"), "point_id", "left_anti").distinct(), "gone-points")
        self.table.merge(new, gone=gone)
        kept = now.join(failed, "file_path", "left_anti").select("file_path", "digest").unionByName(before.join(failed, "file_path", "left_semi"))
        digests.replace(kept, base)
        made = [d.agg(F.count("*").alias(n)) for d, n in ((failed, "failed"), (new.select("point_id").distinct(), "points"), (gone, "deleted"))]
        out = stored(counts.crossJoin(made[0]).crossJoin(made[1]).crossJoin(made[2]), "resync-counts")
        forget(written, told, tried, gone)
        self.table.unstage(new)
        return out

    def _sync_home(self, repo: str) -> str:
        name = self.spark.range(1).select(cache.short_name(F.lit(repo)).alias("n")).first()["n"]
        return f"{self.table.path}/_sync/{name}"

    def sync_stream(self, source: str, repo: str, resume: bool = True, chunker: Chunker | None = None, min_quality: int | None = None, on_batch: Callable[[DataFrame], None] | None = None, on_progress: Callable[[Progress], None] | None = None) -> DataFrame:
        """Sync the files of a repository from Parquet files of file rows in small batches; returns the progress.

        A batch is batch_size new Parquet files. What is done stays done: a later call goes on where the last one ended,
        also after a failure, unless resume is false. A file that fails after all its attempts is a row of the progress
        and stops nothing. on_batch gets the progress after each batch; on_progress is told of each batch, and of each 50
        patterns more, what the writes themselves have counted.
        """
        own, home = self.config.batch, self._sync_home(repo)
        quality = own.min_quality if min_quality is None else min_quality
        if not resume:
            self.clear_progress(repo)
        meta = self.spark.read.parquet(f"{home}/meta").first() if exists(self.spark, f"{home}/meta/_SUCCESS") else None
        total = self.spark.read.schema(ingest.FILES).parquet(source).where(F.col("repo") == repo).select("file_path").distinct().count()
        started = meta["started_at"] if meta else time.time()
        self.spark.createDataFrame([(repo, total, started)], "repo string, total_files long, started_at double").coalesce(1).write.mode("overwrite").parquet(f"{home}/meta")

        before = self.progress(repo).agg(F.sum("stored_patterns")).first()[0] or 0
        watch = Watch(on_progress, before)

        def write(batch: DataFrame, number: int) -> None:
            files = batch.where(F.col("repo") == repo)
            tried = stored(watch.observed(plan.tried(files, chunker, own.max_retries, own.retry_delay), "tried", chunks="chunk_no", failed="error"), "chunks")
            new = self._embedded(plan.found_in(tried.where("error IS NULL").drop("error"), self.analyzer, quality), lambda df: watch.observed(df, "new", stored="*"))
            self.table.merge(new)
            watch.observed(ingest.logged(files, tried, new, time.time()), "log", files="*").write.mode("overwrite").parquet(f"{home}/files/batch={number}")
            forget(tried)
            self.table.unstage(new)
            watch.done(number)
            if on_batch:
                on_batch(self.progress(repo))
            if own.delay > 0:
                time.sleep(own.delay)

        rows = self.spark.readStream.schema(ingest.FILES).option("maxFilesPerTrigger", own.batch_size).parquet(source)
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.progress(repo)

    def progress(self, repo: str) -> DataFrame:
        """How far the sync of a repository is, with percent, seconds left and a line of text; no row if there is none."""
        home = self._sync_home(repo)
        meta = self.spark.read.parquet(f"{home}/meta").first() if exists(self.spark, f"{home}/meta/_SUCCESS") else None
        log = self.spark.read.schema(ingest.LOG).parquet(f"{home}/files") if exists(self.spark, f"{home}/files") else self.spark.createDataFrame([], ingest.LOG)
        told = ingest.progress_from(log, meta["total_files"] if meta else 0, meta["started_at"] if meta else 0.0)
        return render.with_progress(told).withColumn("rendered", render.progress_report())

    def clear_progress(self, repo: str) -> bool:
        """T4: forget how far the sync of a repository is, so that the next one starts anew; whether there was anything."""
        return delete(self.spark, self._sync_home(repo))

    def discover(self, root: str) -> int:
        """Each code file below a folder becomes a point of its own; returns how many points there are."""
        new = stored(discovered(local_files(self.spark, root)), "discovered")
        self.table.merge(new.withColumn("ingest_seq", F.lit(_now() << 20).cast("long")))
        forget(new)
        return self.table.count()

    def stats(self) -> DataFrame:
        return stats.dimension_counts(self.read()).orderBy("dimension", F.desc("n"), "value")

    def category_stats(self) -> DataFrame:
        return stats.category_distribution(self.read()).orderBy(F.desc("n"), "category")

    def recategorize(self, from_category: str | None = None, dry_run: bool = True) -> DataFrame:
        """Analyze the rows of a category again; writes unless it is a dry run. Returns the outcome counts."""
        if from_category not in (None, "", "all") and from_category not in CATEGORIES:
            raise ValueError(f"{from_category} is no category")
        if self.analyzer is None:
            raise ValueError("there is no analyzer")
        chunks = analyze.chunk_of(search.in_category(self.read(), from_category))
        told = stats.relabelled(chunks, self.analyzer())
        if not dry_run:
            new = stored(told.where("outcome = 'updated'").select("point_id", "analysis.title", "analysis.description", "analysis.category", "analysis.quality_score", "analysis.use_cases"), "relabelled")
            counts = stored(stats.outcome_counts(told), "outcomes")
            self.table.change(new.select(self.table.bucket().alias("bucket")), lambda old: bank_ops.partial_update(old, new))
            forget(new)
            return counts
        return stats.outcome_counts(told)

    def rebuild(self) -> int:
        """Embed all rows anew as a new version."""
        return self.table.replace(self.read().withColumn("embedding", self.embedder.column(F.col("document"))))

    def scaffold(self, name: str, kind: str, stack: str, folder: str | None = None, ask: Callable[[str], str] | None = None, prompt: str = scaffold.PROMPT) -> DataFrame:
        """A new project's folders and files, from a model's reply to the prompt with the nearest patterns where there is one, else from the template."""
        split = [s.strip() for s in stack.split(",")]
        filled = ""
        if ask is not None:
            shown = self.gather_patterns(kind, split).orderBy("rank").select(render.prompt_pattern().alias("p")).collect()
            filled = scaffold.filled(prompt, name, kind, split, [r["p"] for r in shown])
        made = scaffold.structure_from(self.spark, name, kind, split, ask, filled)
        if folder is not None:
            scaffold.write_project(made, folder)
        return scaffold.listing(made)

    def list_repos(self, listed: DataFrame, me: str | None = None) -> DataFrame:
        """The listed repositories that the configuration lets through, with their text; listed is what repos.repo_listing reads."""
        own = self.config.repos
        return repos.listed(listed, me, include_private=own.include_private, include_orgs=own.include_orgs, excluded=own.excluded).withColumn("rendered", render.repo_entry())

    def stats_text(self) -> DataFrame:
        """The statistics as lines of text."""
        return render.stats_lines(stats.dimension_counts(self.read()))


def embedding_info(spark: SparkSession) -> DataFrame:
    """The known models and their sizes."""
    return spark.createDataFrame(list(MODELS.items()), "model string, vector_size int")
