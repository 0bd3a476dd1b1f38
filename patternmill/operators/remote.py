"""Analyzers behind a network: called per chunk in Arrow batches, with retries, never for a whole table at once."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.functions.render import analysis_prompt
from patternmill.functions.replies import analysis_of


class RateLimited(Exception):
    """What a call raises to be tried again later."""


def with_backoff(call: Callable[[str], str], retries: int = 5, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str | None]]:
    """(reply, error) of a prompt. A RateLimited call waits first, then twice as long each time, up to most; other errors end it."""

    def run(prompt: str) -> tuple[str | None, str | None]:
        delay = first
        for attempt in range(retries + 1):
            try:
                return call(prompt), None
            except RateLimited as e:
                if attempt == retries:
                    return None, f"rate limit: {e}"
                sleep(delay)
                delay = min(2 * delay, most)
            except Exception as e:  # noqa: BLE001  one chunk's failure must not end the task
                return None, str(e)
        return None, "no attempt"

    return run


class Quota:
    """A token bucket: take() waits until it may go on, `rate` times a second, evenly. It begins empty, so no start of a task adds to the rate."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.step, self.clock, self.sleep, self.lock = 1 / rate, clock, sleep, threading.Lock()
        self.next = clock() + self.step

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(self.next, now)
            self.next = at + self.step
        if at > now:
            self.sleep(at - now)


def analyzed(chunks: DataFrame, template: str, call: Callable[[str], str], concurrency: int = 1, rate: float | None = None, **options) -> DataFrame:
    """Chunks with analysis (null where there is none) and error, from the replies to the filled template.

    Each task has `concurrency` calls under way; rows stay in their order. rate: calls a second of all tasks together,
    attempts after a refusal too; each task that can run at once gets an equal share of it. call must be safe to use from
    several threads where concurrency is over 1.
    """
    share = None if rate is None else rate / max(1, chunks.sparkSession.sparkContext.defaultParallelism)
    prompted = chunks.withColumn("__prompt", analysis_prompt(template))
    at = prompted.columns.index("__prompt")
    names = [*chunks.columns, "__reply", "error"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields), "__reply string", "error string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quota = Quota(share) if share else None

        def limited(prompt: str) -> str:
            if quota:
                quota.take()
            return call(prompt)

        ask = with_backoff(limited, **options)
        tell = lambda p: ask(p) if p is not None else (None, "no prompt")
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for batch in batches:
                told = list(pool.map(tell, batch.column(at).to_pylist()))
                kept = [batch.column(k) for k in range(batch.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([r for r, _ in told], pa.string()), pa.array([e for _, e in told], pa.string())], names=names)

    return prompted.mapInArrow(run, ddl).withColumn("analysis", analysis_of(F.col("__reply"))).drop("__reply")
