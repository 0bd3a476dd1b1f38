"""A cache kept on disk: what operators/cache says about tables, on a versioned one."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.config import CacheConfig
from patternmill.operators import cache
from patternmill.session import forget, put_bytes, ship, stored
from patternmill.sources.tables import CacheTable, Conflict


#: Hits after which the order of use is written; until then it is kept in the process.
TOUCHES = 256


class CacheStore:
    """C1 to C7, S15. Times are seconds; now is the clock unless it is given. A disabled cache holds and finds nothing.

    A read looks at the one bucket of its key and writes nothing: which entries were used since is kept in the process,
    and goes to the table with the next write, after TOUCHES hits, or by flush. A process that ends before loses that
    order of use, and nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, config: CacheConfig = CacheConfig()):
        ship(spark)
        self.spark, self.config, self.table = spark, config, CacheTable(spark, path)
        self.table.create()
        self._used: dict[str, int] = {}
        self._last: int | None = None

    def entries(self, now: float | None = None) -> DataFrame:
        """The valid entries, no more than the cache holds."""
        self.flush()
        return cache.load_valid(self.table.read(), time.time() if now is None else now, self.config.max_size)

    def get(self, key: str, now: float | None = None) -> str | None:
        """The value, or None where there is none or it has ended. A hit is used last from now on."""
        if not self.config.enabled:
            return None
        row = cache.lookup(self.table.read_buckets([self.table.bucket_of(key)]), key, time.time() if now is None else now).first()
        if row is None:
            return None
        self._used[key] = self._next()
        if len(self._used) >= TOUCHES:
            self.flush()
        return row["value"]

    def _next(self) -> int:
        """A number above all that are in use; the table is asked once."""
        if self._last is None:
            self._last = self.table.read().agg(F.max("access_seq")).first()[0] or 0
        self._last += 1
        return self._last

    def flush(self) -> None:
        """Write the order of use; only the buckets of the keys used are written anew."""
        if not self._used:
            return
        used = self.spark.createDataFrame(list(self._used.items()), "key string, __seq long")
        seq = F.greatest("access_seq", "__seq").alias("access_seq")
        self.table.change_buckets({self.table.bucket_of(k) for k in self._used}, lambda old: old.join(F.broadcast(used), "key", "left").select("key", "value", "expires_at", seq))
        self._used = {}

    def put(self, entries: DataFrame, kind: str = "other", now: float | None = None) -> None:
        """Entries (key, value) with the time to live of their kind replace those of the same key; then the least recently used go."""
        if not self.config.enabled:
            return
        self.flush()
        at, first = time.time() if now is None else now, self._next()
        told = stored(entries.groupBy("key").agg(F.max("value").alias("value")).select("key", "value", F.lit(at + self.config.ttl_of(kind)).alias("expires_at"), F.lit(first).cast("long").alias("access_seq")), "cache-entries")
        self.table.merge(told, order="access_seq")
        if self.table.count() > self.config.max_size:
            self._rewrite(lambda rows: cache.keep_recent(rows, self.config.max_size))
        forget(told)

    def _rewrite(self, make: Callable[[DataFrame], DataFrame], attempts: int = 10) -> None:
        """Replace the table by what make gives for its rows; again if another process wrote meanwhile."""
        for _ in range(attempts):
            base = self.table.versions()[-1]
            try:
                self.table.replace(make(self.table.read(base)), base)
                return
            except Conflict:
                continue
        raise Conflict(f"others kept writing to {self.table.path}")

    def invalidate(self, key: str | None = None, prefix: str | None = None, repo: str | None = None) -> None:
        """Forget a key, all keys below a prefix, or what is held of a repository; all entries if nothing is named."""
        self.flush()

        def left(rows: DataFrame) -> DataFrame:
            if key is not None:
                rows = cache.without_key(rows, key)
            if prefix is not None:
                rows = cache.without_prefix(rows, prefix)
            if repo is not None:
                rows = cache.without_repo(rows, repo)
            return rows.limit(0) if key is prefix is repo is None else rows

        if key is not None and prefix is repo is None:
            self.table.change_buckets({self.table.bucket_of(key)}, left)
        else:
            self._rewrite(left)

    def stats(self, now: float | None = None) -> dict:
        """C4: how many entries there are, how many of them have ended, and how many there can be."""
        return cache.stats(self.table.read(), time.time() if now is None else now).first().asDict() | {"max_size": self.config.max_size}

    def import_files(self, folder: str, now: float | None = None) -> int:
        """Take over a folder of JSON files, an entry (key, value, expires_at) each; those that have ended or are broken are left out."""
        raw = self.spark.read.schema("key string, value string, expires_at double").option("multiLine", "true").json(folder)
        held = cache.valid(raw.where("key IS NOT NULL"), time.time() if now is None else now).withColumn("access_seq", F.lit(self._next()).cast("long"))
        told = stored(held.groupBy("key").agg(F.max_by(F.struct("value", "expires_at", "access_seq"), "expires_at").alias("e")).select("key", "e.*"), "cache-entries")
        n = told.count()
        self.flush()
        self._rewrite(lambda rows: cache.put(rows, told, self.config.max_size))
        forget(told)
        return n

    def export_files(self, folder: str, now: float | None = None) -> int:
        """Write the valid entries as such files; there are no more than the cache holds."""
        rows = self.entries(now).select(cache.file_name(F.col("key")).alias("name"), F.to_json(F.struct("key", "value", "expires_at")).alias("text")).collect()
        for r in rows:
            put_bytes(self.spark, f"{folder.rstrip('/')}/{r['name']}", r["text"].encode())
        return len(rows)
