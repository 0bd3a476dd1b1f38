"""A key-value cache with time to live and least-recently-used eviction, as table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.schema import DEFAULT_TTL, TTL


def key_of(prefix: str | Column, *parts: Column) -> Column:
    """Prefix and parts joined by colons; booleans as True and False; null parts are empty."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat_ws(":", head, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def flag(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def ttl_of(kind: Column, default: float = DEFAULT_TTL) -> Column:
    """X31."""
    table = F.create_map(*[F.lit(x) for pair in TTL.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(default))


def valid(cache: DataFrame, now: float) -> DataFrame:
    """an entry ends when now is past its time."""
    return cache.where(F.col("expires_at") >= now)


def lookup(cache: DataFrame, key: str, now: float) -> DataFrame:
    """C1."""
    return valid(cache, now).where(F.col("key") == key)


def keep_recent(cache: DataFrame, size: int) -> DataFrame:
    """The entries used last; a top-k, so no sort of all rows."""
    if size < 1:
        raise ValueError("a cache holds one entry at least")
    return cache.orderBy(F.desc("access_seq"), "key").limit(size)


def put(cache: DataFrame, entries: DataFrame, size: int) -> DataFrame:
    """Entries replace those of the same key; then the least recently used go."""
    return keep_recent(cache.join(entries.select("key"), "key", "left_anti").unionByName(entries), size)


def load_valid(cache: DataFrame, now: float, size: int) -> DataFrame:
    """What a restart takes over: valid entries, up to the size."""
    return keep_recent(valid(cache, now), size)


def without_key(cache: DataFrame, key: str) -> DataFrame:
    return cache.where(F.col("key") != key)


def without_prefix(cache: DataFrame, prefix: str) -> DataFrame:
    """Without the keys below the prefix, in memory or not."""
    return cache.where(~F.col("key").startswith(prefix + ":"))


def without_repo(cache: DataFrame, repo: str) -> DataFrame:
    """Without the tree and the contents of a repository."""
    return without_prefix(without_key(without_prefix(cache, f"tree:{repo}"), f"tree:{repo}"), f"content:{repo}")


def stats(cache: DataFrame, now: float) -> DataFrame:
    """C4, A8."""
    return cache.agg(F.count("*").alias("size"), F.count_if(F.col("expires_at") < now).alias("expired"))


def read_through(wanted: DataFrame, cache: DataFrame, origin: DataFrame, now: float) -> DataFrame:
    """For each wanted key the cached value if it is valid, else that of the origin."""
    cached = valid(cache, now).select("key", F.col("value").alias("cached"))
    fresh = origin.select("key", F.col("value").alias("fresh"))
    joined = wanted.join(cached, "key", "left").join(fresh, "key", "left")
    return joined.select("key", F.coalesce("cached", "fresh").alias("value"), F.col("cached").isNotNull().alias("hit"))


def file_name(key: Column) -> Column:
    """The file of a cache entry."""
    return F.concat(F.md5(key), F.lit(".json"))


def short_name(repo: Column) -> Column:
    """The name under which the progress of a repository is kept."""
    return F.substring(F.md5(repo), 1, 12)
