"""Repositories and files from a service over HTTP, a page at a time: a data source for batches and streams.

A page is a partition, so pages are fetched by the executors and each once. A service that says how many calls are left
is waited for; a page or file that cannot be had is a row with an error, and stops nothing.
"""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from email.message import Message
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from patternmill.functions.paths import is_code_file, language_of
from patternmill.operators.repos import RAW_REPO, repo_info
from patternmill.session import ship

PAGE_SIZE, MOST_WAIT, ATTEMPTS = 100, 900.0, 5


class Failed(Exception):
    """A call that was not answered after all attempts."""


class Answer(NamedTuple):
    body: Any
    headers: Message


def _wait(headers: Message | None, attempt: int, most: float) -> float:
    """Seconds until a service may be asked again: what it says, else twice as long each time."""
    told = headers or {}
    if told.get("Retry-After", "").isdigit():
        return min(most, float(told["Retry-After"]))
    if told.get("X-RateLimit-Remaining") == "0" and told.get("X-RateLimit-Reset", "").isdigit():
        return min(most, max(0.0, float(told["X-RateLimit-Reset"]) - time.time()))
    return min(most, 2.0**attempt)


def ask(url: str, token: str | None = None, attempts: int = ATTEMPTS, most_wait: float = MOST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """GET a URL as JSON. A service that is over its quota or busy (403 with none left, 429, 5xx) is waited for and asked again; other answers fail at once."""
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    for attempt in range(max(1, attempts)):
        told: Message | None = None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:
                return Answer(json.loads(r.read()), r.headers)
        except urllib.error.HTTPError as e:
            busy = e.code == 429 or e.code >= 500 or e.code == 403 and e.headers.get("X-RateLimit-Remaining") == "0"
            problem, told = f"{e.code} {e.reason}", e.headers
            if not busy:
                raise Failed(problem) from e
        except (OSError, ValueError) as e:
            problem = f"{type(e).__name__}: {e}"
        if attempt + 1 < attempts:
            sleep(_wait(told, attempt, most_wait))
    raise Failed(problem)


def last_page(headers: Message) -> int:
    """The number of the last page that the Link header names; 1 without one."""
    for url, rel in re.findall(r"<([^>]*)>;\s*rel=\"?(\w+)", headers.get("Link", "")):
        if rel == "last":
            return int(urllib.parse.parse_qs(urllib.parse.urlparse(url).query).get("page", ["1"])[0])
    return 1


class Page(InputPartition):
    """A page, and which of its rows are wanted; held: its rows, where planning has fetched it already."""

    def __init__(self, number: int, low: int = 0, high: int | None = None, held: list | None = None):
        super().__init__((number, low, high))
        self.number, self.low, self.high, self.held = number, low, high, held


class _Service:
    def __init__(self, options: dict[str, str], schema: StructType):
        self.names = [f.name for f in schema.fields if f.name not in ("page", "error")]
        self.url, self.token, self.size = options["url"], options.get("token"), int(options.get("page_size", PAGE_SIZE))
        self.attempts, self.most_wait = int(options.get("attempts", ATTEMPTS)), float(options.get("most_wait", MOST_WAIT))

    def page(self, number: int) -> Answer:
        mark = "&" if "?" in self.url else "?"
        return ask(f"{self.url}{mark}page={number}&per_page={self.size}", self.token, self.attempts, self.most_wait)

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            rows = partition.held if partition.held is not None else self.page(partition.number).body
        except Failed as e:
            yield (*[None] * len(self.names), partition.number, str(e))
            return
        for row in rows[partition.low : partition.high]:
            owner = row.get("owner") or {}
            values = row | {"owner": {"login": owner.get("login")} if owner else None}
            yield (*[values.get(n) for n in self.names], partition.number, None)


class _Reader(_Service, DataSourceReader):
    def partitions(self) -> list[Page]:
        """All pages. The first is fetched here to learn how many there are, and travels with its partition; if that fails it is tried again there."""
        try:
            first = self.page(1)
        except Failed:
            return [Page(1)]
        return [Page(1, held=first.body), *(Page(k) for k in range(2, last_page(first.headers) + 1))]


class _Stream(_Service, DataSourceStreamReader):
    """Rows that come to the end of the list; an offset is how many rows there were."""

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        first = self.page(1)
        last = last_page(first.headers)
        rows = first.body if last == 1 else self.page(last).body
        return {"rows": (last - 1) * self.size + len(rows)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        low, high, n = start["rows"], end["rows"], self.size
        return [Page(k + 1, max(0, low - k * n), min(n, high - k * n)) for k in range(low // n, -(-high // n))] if high > low else []


class RepositoryService(DataSource):
    """Format repository_service: the repositories that a service lists (RAW_REPO), with page and error. Options: url, token, page_size, attempts, most_wait."""

    @classmethod
    def name(cls) -> str:
        return "repository_service"

    def schema(self) -> str:
        return RAW_REPO + ", page int, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(RepositoryService)


def repositories(spark: SparkSession, url: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(repositories, failures): what the service lists, as repos.repo_info gives it, and the pages (page, error) that could not be had."""
    register(spark)
    raw = spark.read.format("repository_service").option("url", url).options(**options).load()
    return repo_info(raw.where("error IS NULL")), raw.where("error IS NOT NULL").select("page", "error")


FILE = "repo string, file_path string, size long, content string, error string"


def repository_files(listed: DataFrame, url: str, token: str | None = None, attempts: int = ATTEMPTS, most_wait: float = MOST_WAIT, known_only: bool = True) -> DataFrame:
    """The files of repositories (full_name, default_branch), fetched where the rows are: (repo, file_path, size, content, error, language).

    A repository whose tree, or a file whose content cannot be had, gives a row with an error; content that is no UTF-8
    is null without one. known_only: files of known extensions alone are fetched.
    """

    def tree(repo: str, branch: str) -> Iterator[tuple]:
        base = f"{url.rstrip('/')}/repos/{urllib.parse.quote(repo)}"
        try:
            found = ask(f"{base}/git/trees/{urllib.parse.quote(branch, safe='')}?recursive=1", token, attempts, most_wait).body
        except Failed as e:
            yield repo, None, None, str(e)
            return
        for entry in found.get("tree", []):
            if entry.get("type") == "blob":
                yield repo, entry["path"], entry.get("size"), None

    def text(repo: str, path: str) -> tuple[str | None, str | None]:
        try:
            told = ask(f"{url.rstrip('/')}/repos/{urllib.parse.quote(repo)}/contents/{urllib.parse.quote(path)}", token, attempts, most_wait).body
            return base64.b64decode(told["content"]).decode(), None
        except UnicodeDecodeError:
            return None, None
        except (Failed, KeyError, TypeError, ValueError) as e:
            return None, str(e)

    def trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, branch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(tree(repo, branch or "main"))
                yield pa.RecordBatch.from_pylist([dict(zip(("repo", "file_path", "size", "error"), r, strict=True)) for r in rows], pa.schema([("repo", pa.string()), ("file_path", pa.string()), ("size", pa.int64()), ("error", pa.string())]))

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                content, error = (None, row["error"]) if row["error"] is not None else text(row["repo"], row["file_path"])
                yield pa.RecordBatch.from_pylist([row | {"content": content, "error": error}], pa.schema([("repo", pa.string()), ("file_path", pa.string()), ("size", pa.int64()), ("content", pa.string()), ("error", pa.string())]))

    ship(listed.sparkSession)
    found = listed.select("full_name", "default_branch").mapInArrow(trees, "repo string, file_path string, size long, error string")
    if known_only:
        found = found.where(F.col("error").isNotNull() | is_code_file(F.col("file_path")))
    # Files are dealt anew, as one repository may hold most of them.
    spread = found.repartition(F.xxhash64("repo", "file_path"))
    return spread.mapInArrow(texts, FILE).withColumn("language", language_of(F.col("file_path")))
