"""A cache as streaming state, with a time to live and the least recently used going first."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ANSWER = "key string, seq long, op string, value string, hit boolean"
ENTRY = "value string, expires_us long, used long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shards of a cache where requests do not name theirs; each holds its share of the entries.
SHARDS = 16


class Shard:
    """The entries of one shard by their last use. What has ended never counts, so it does not matter when it is removed."""

    def __init__(self, capacity: int, ttl_us: int):
        self.capacity, self.ttl = capacity, ttl_us
        self.held: OrderedDict[str, tuple[str | None, int]] = OrderedDict()
        self.ends: list[tuple[int, str]] = []

    def load(self, entries: Iterator[tuple[str, str | None, int, int]]) -> None:
        for key, value, expires, _ in sorted(entries, key=lambda e: e[3]):
            self.held[key] = (value, expires)
            self.ends.append((expires, key))
        heapq.heapify(self.ends)

    def purge(self, now: int) -> None:
        """Remove the entries whose time is before now."""
        while self.ends and self.ends[0][0] < now:
            expires, key = heapq.heappop(self.ends)
            if key in self.held and self.held[key][1] == expires:
                del self.held[key]

    def ask(self, op: str, key: str, value: str | None, now: int) -> tuple[str | None, bool]:
        """Do one request; the value and whether it is a hit. A put that finds the shard full lets the entry go that was used first."""
        self.purge(now)
        if op == "put":
            self.held[key] = (value, now + self.ttl)
            self.held.move_to_end(key)
            heapq.heappush(self.ends, (now + self.ttl, key))
            while len(self.held) > self.capacity:
                self.held.popitem(last=False)
        elif op == "drop":
            self.held.pop(key, None)
        elif op == "get" and key in self.held:
            self.held.move_to_end(key)
        found = self.held.get(key)
        return (found[0], op == "get") if found and op != "drop" else (None, False)


class CacheProcessor(StatefulProcessor):
    """State of a shard: a map of its entries, never more than its capacity, and one timer for the first of them to end.

    A batch of requests reads the map once and writes what has changed. When the watermark passes a timer, the entries
    that have ended leave the state, and the next timer is set.
    """

    def __init__(self, capacity: int, ttl_us: int):
        self.capacity, self.ttl = capacity, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", ENTRY)
        self.clock = handle.getValueState("clock", "used long, timer_ms long")

    def _shard(self) -> tuple[Shard, dict[str, tuple]]:
        stored = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        shard = Shard(self.capacity, self.ttl)
        shard.load((k, *v) for k, v in stored.items())
        return shard, stored

    def _save(self, shard: Shard, before: dict[str, tuple], used: dict[str, int], last: int, watermark_ms: int) -> None:
        for key in before.keys() - shard.held.keys():
            self.entries.removeKey((key,))
        for key, (value, expires) in shard.held.items():
            now = (value, expires, used.get(key, before[key][2] if key in before else last))
            if before.get(key) != now:
                self.entries.updateValue((key,), now)
        old = self.clock.get()[1] if self.clock.exists() else -1
        first = min((e for _, e in shard.held.values()), default=None)
        timer = -1 if first is None else max(first // 1000 + 1, watermark_ms + 1)
        if timer != old:
            if old > watermark_ms:
                self.handle.deleteTimer(old)
            if timer > 0:
                self.handle.registerTimer(timer)
        self.clock.update((last, timer))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        shard, before = self._shard()
        last = self.clock.get()[0] if self.clock.exists() else 0
        used: dict[str, int] = {}
        out = []
        told = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        for name, seq, op, value, at in zip(told["key"], told["seq"], told["op"], told["value"], told["at"], strict=True):
            last += 1
            value, hit = shard.ask(op, name, value if isinstance(value, str) else None, at.value // 1000)
            if hit or op == "put":
                used[name] = last
            out.append((name, seq, op, value, hit))
        self._save(shard, before, used, last, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["key", "seq", "op", "value", "hit"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        shard, before = self._shard()
        watermark = timerValues.getCurrentWatermarkInMs()
        shard.purge(watermark * 1000)
        last = self.clock.get()[0] if self.clock.exists() else 0
        self._save(shard, before, {}, last, watermark)
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "op": pd.Series([], dtype=str), "value": pd.Series([], dtype=str), "hit": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl_s: float, delay: str = "0 seconds", capacity: int = 1000) -> DataFrame:
    """Answers (ANSWER) to a stream of requests (key, seq long, op, value, at timestamp, and maybe shard).

    op is put, get or drop; those of a shard go by at, then seq, within a batch. An entry ends ttl_s seconds after its
    put; a get then is no hit. A shard holds capacity entries: a put beyond lets the least recently used of those that
    have not ended go. Without a column shard, keys are dealt over SHARDS by their hash, and capacity is that of all.
    State is in RocksDB, which the session is set to. Requests without a key are left out, and those behind the watermark.
    """
    requests.sparkSession.conf.set(PROVIDER, ROCKSDB)
    own = "shard" in requests.columns
    shard = F.col("shard") if own else F.pmod(F.xxhash64("key"), F.lit(SHARDS))
    kept = requests.where("key IS NOT NULL").select(shard.alias("shard"), "key", "seq", "op", "value", "at").withWatermark("at", delay)
    size = capacity if own else max(1, capacity // SHARDS)
    return kept.groupBy("shard").transformWithStateInPandas(CacheProcessor(size, int(ttl_s * 1_000_000)), ANSWER, "append", "eventTime")
