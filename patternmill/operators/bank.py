"""The bank: ids, payload, upserts, partial updates, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.schema import CATEGORIES, PREVIEW


def point_id(repo: Column, path: Column, content: Column) -> Column:
    """md5 of repository, path and the start of the content's md5; nulls count as empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat(e(repo), F.lit(":"), e(path), F.lit(":"), F.substring(F.md5(e(content)), 1, 8)))


def document_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank that the documents and labels tables stand for; no quality where there is no label."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    told = labels.select(F.col("doc_id"), F.lit(True).alias("__labelled"))
    joined = docs.join(told, "doc_id", "left")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("doc_id") % 10 + 1).cast("int"))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return joined.select(
        F.col("doc_id").alias("ingest_seq"),
        point_id(F.col("source"), path, F.col("text")).alias("point_id"),
        F.col("text").alias("document"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("language"),
        category.alias("category"),
        F.when(F.col("__labelled"), (1 + F.col("n_chars") % 10).cast("int")).alias("quality_score"),
        F.col("source").alias("source_repo"),
        path.alias("source_path"),
    )


def preview(c: Column) -> Column:
    """P10."""
    return F.substring(c, 1, PREVIEW)


def latest(df: DataFrame, key: str = "point_id", order: str = "ingest_seq") -> DataFrame:
    """The last row of each key; a partial aggregate, so repeated keys shrink before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select(key, "__last.*").select(*df.columns)


#: Keys that are broadcast at most, so that whole rows need not be shuffled for them.
FEW_KEYS = 100_000


def last_rows(df: DataFrame, key: str = "point_id", order: str = "ingest_seq") -> DataFrame:
    """latest for a written table: its keys are shuffled first, and of whole rows only those whose key is there more than once. df itself if none is."""
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__key"))
    n = repeated.limit(FEW_KEYS + 1).count()
    if n == 0:
        return df
    if n > FEW_KEYS:
        return latest(df, key, order)
    same = F.col(key).eqNullSafe(F.col("__key"))
    return df.join(F.broadcast(repeated), same, "left_anti").unionByName(latest(df.join(F.broadcast(repeated), same, "left_semi"), key, order))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "point_id", order: str = "ingest_seq") -> DataFrame:
    """Rows of existing without a newer one, and the last incoming row of each key."""
    new = latest(incoming, key, order)
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def partial_update(existing: DataFrame, updates: DataFrame, key: str = "point_id") -> DataFrame:
    """Where the category changes, take title, description, category, quality_score and use_cases; empty new values keep the old."""
    fields = [c for c in ("title", "description", "category", "quality_score", "use_cases") if c in updates.columns and c in existing.columns]
    told = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = existing.join(told, F.col(key) == F.col("__key"), "left")
    changed = F.col("__key").isNotNull() & (F.col("__category") != F.coalesce("category", F.lit("unknown")))

    def new(c: str) -> Column:
        n, kind = F.col(f"__{c}"), existing.schema[c].dataType.simpleString()
        if kind == "string":
            n = F.when(F.length(n) > 0, n)
        elif kind.startswith("array"):
            n = F.when(F.size(n) > 0, n)
        elif c == "quality_score":
            n = F.when(n != 0, n)
        return F.when(changed, F.coalesce(n, F.col(c))).otherwise(F.col(c))

    return joined.select(*[new(c).alias(c) if c in fields else F.col(c) for c in existing.columns])


def scroll(bank: DataFrame, after: str | None, limit: int, columns: list[str] | None = None) -> DataFrame:
    """One page in the order of point_id, after the given one."""
    page = bank if after is None else bank.where(F.col("point_id") > after)
    return (page.select(*columns) if columns else page).orderBy("point_id").limit(limit)


def payload(bank: DataFrame) -> DataFrame:
    """The payload columns and a preview."""
    return bank.select("ingest_seq", "title", "category", "language", "quality_score", "source_repo", "source_path", preview(F.col("document")).alias("preview"))
