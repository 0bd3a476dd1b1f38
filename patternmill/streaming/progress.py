"""Progress of a stream as it goes, from what its writes observe and from the session's listener; nothing is read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

#: Progress is told each time that so many more patterns are stored.
PATTERNS_A_STEP = 50


class Progress(NamedTuple):
    """What a batch did; patterns: a multiple of PATTERNS_A_STEP that has been passed, or none at the end of the batch."""

    batch: int
    files: int
    chunks: int
    failed: int
    stored: int
    total_stored: int
    patterns: int | None


def steps(before: int, after: int, every: int = PATTERNS_A_STEP) -> list[int]:
    """The multiples of `every` above before and up to after."""
    return list(range((before // every + 1) * every, after + 1, every))


class Watch:
    """Counts what the writes of a stream's batches make, and tells it: each step of patterns, then the batch."""

    def __init__(self, tell: Callable[[Progress], None] | None = None, stored: int = 0):
        self.tell, self.total = tell, stored
        self._held: dict[str, Observation] = {}

    def observed(self, df: DataFrame, name: str, **counts: str) -> DataFrame:
        """df, counting as it is written: of each named column the values that are not null, or all rows for *."""
        self._held[name] = Observation()
        return df.observe(self._held[name], *[F.count(F.lit(1) if c == "*" else F.col(c)).alias(k) for k, c in counts.items()])

    def count(self, name: str, key: str) -> int:
        """What was counted; the write must have been done."""
        return int(self._held[name].get[key])

    def done(self, batch: int) -> Progress:
        """Tell what the batch did, from its writes named tried, new and log."""
        before, stored = self.total, self.count("new", "stored")
        self.total += stored
        end = Progress(batch, self.count("log", "files"), self.count("tried", "chunks"), self.count("tried", "failed"), stored, self.total, None)
        if self.tell:
            for n in steps(before, self.total):
                self.tell(end._replace(patterns=n))
            self.tell(end)
        return end


class BatchListener(StreamingQueryListener):
    """Tells (query id, batch, rows, milliseconds) of each batch of the session's streams, and (query id, None, 0, error or None) at an end."""

    def __init__(self, tell: Callable[[str, int | None, int, object], None]):
        self.tell = tell

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.tell(str(p.id), p.batchId, p.numInputRows, p.batchDuration)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.tell(str(event.id), None, 0, event.exception)


@contextmanager
def listening(spark: SparkSession, tell: Callable[[str, int | None, int, object], None]) -> Iterator[None]:
    """Have a BatchListener for as long; what has been posted by then is told before it ends."""
    listener = BatchListener(tell)
    spark.streams.addListener(listener)
    try:
        yield
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
