"""Tables as versioned folders: a write makes new folders, and a commit says which folders a version has."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from patternmill.operators.bank import last_rows, upsert  # noqa: F401
from patternmill.schema import BANK, CACHE
from patternmill.session import age_of, delete, exists, forget, names_in, put_if_absent, qualified, read_bytes, stored, writing
from patternmill.sources.files import place

#: Every so many versions the log holds all folders of one; between, commits say what changes.
CHECKPOINT = 10
#: Folders of a bucket at most; a merge that finds so many writes the bucket anew, as one.
MOST_FOLDERS = 8


class Conflict(RuntimeError):
    """Another writer changed the same part of a table first, again and again."""


class State(NamedTuple):
    """A version: its folders (of a bucket one, or several by commas) and what is known of their rows, by bucket, and what the table says about itself."""

    number: int
    folders: dict[int, str]
    stats: dict[int, dict]
    about: dict


class VersionedTable:
    """A table on disk in buckets by its key. No folder is changed once written, so readers and a failed write do no harm.

    A version is one folder or some for each bucket; a write that touches some buckets only makes new folders for those,
    and one that adds rows leaves the folders of the others beside its own, up to MOST_FOLDERS in a bucket. It becomes
    a version by its commit, a file by its number that is made only where there is none, so of two writers one comes
    first. The other one joins its folders to that version if they lie in other buckets, else does its work again on it.
    A version is read from the last checkpoint and the commits after it, CHECKPOINT + 1 files at most.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._log = f"{self.path}/_log"

    def _file(self, number: int, kind: str) -> str:
        return f"{self._log}/{number:020d}.{kind}.json"

    def _logged(self) -> tuple[list[int], list[int]]:
        """The numbers of all commits and of all checkpoints there are."""
        names = names_in(self.spark, self._log) if exists(self.spark, self._log) else []
        of = lambda kind: [int(n[:20]) for n in names if n.endswith(f".{kind}.json")]
        return of("commit"), of("checkpoint")

    def _get(self, number: int, kind: str) -> dict:
        return json.loads(read_bytes(self.spark, self._file(number, kind)))

    def log_files(self, number: int | None = None) -> list[tuple[int, str]]:
        """The files of the log that tell the folders of a version, in order; raises if there is no such version."""
        commits, points = self._logged()
        if not commits and not points:
            raise ValueError(f"there is no table at {self.path}")
        want = max(commits + points) if number is None else number
        base = max((p for p in points if p <= want), default=min(commits, default=-1) - 1)
        later = [c for c in sorted(commits) if base < c <= want]
        if (later[-1] if later else base) != want:
            raise ValueError(f"there is no version {want} at {self.path}")
        return [(p, "checkpoint") for p in points if p == base] + [(c, "commit") for c in later]

    def _state(self, number: int | None = None) -> State:
        parts: dict[int, list] = {}
        about: dict = {}
        last = -1
        for last, kind in self.log_files(number):
            told = self._get(last, kind)
            if told["whole"]:
                parts, about = {}, {}
            parts = {b: f for b, f in parts.items() if b not in told["drop"]} | {int(b): f for b, f in told["add"].items()}
            about |= told["about"]
        return State(last, {b: f for b, (f, _) in parts.items()}, {b: s for b, (_, s) in parts.items()}, about)

    def _folders(self, number: int | None = None) -> dict[int, str]:
        return self._state(number).folders

    def versions(self) -> list[int]:
        """The versions that can be read."""
        commits, points = self._logged()
        first = min(points, default=0) if 0 not in commits else 0
        return sorted({n for n in commits if n >= first} | {n for n in points if n == first})

    def create(self) -> None:
        """An empty first version if there is none."""
        if not exists(self.spark, self._log):
            self._commit(0, {}, {}, [], True, {})

    def _commit(self, number: int, add: dict[int, str], stats: dict[int, dict], drop: list[int], whole: bool, about: dict) -> bool:
        """Make the version of this number unless there is one; whole: nothing of the one before stays."""
        if not put_if_absent(self.spark, self._file(number, "commit"), self._told(add, stats, drop, whole, about)):
            return False
        if number and number % CHECKPOINT == 0:
            self._checkpoint(number)
        return True

    def _checkpoint(self, number: int) -> None:
        _, folders, stats, about = self._state(number)
        put_if_absent(self.spark, self._file(number, "checkpoint"), self._told(folders, stats, [], True, about))

    @staticmethod
    def _told(add: dict[int, str], stats: dict[int, dict], drop: list[int], whole: bool, about: dict) -> bytes:
        return json.dumps({"add": {str(b): [f, stats.get(b, {})] for b, f in sorted(add.items())}, "drop": sorted(drop), "whole": whole, "about": about}).encode()

    def _stats(self, rows: DataFrame) -> dict[int, dict]:
        """What a kind of table keeps of new rows by bucket, in its log."""
        return {}

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{part}" for f in folders for part in f.split(",")))

    def read(self, number: int | None = None) -> DataFrame:
        return self._load(list(self._state(number).folders.values()))

    def read_buckets(self, buckets: list[int], number: int | None = None) -> DataFrame:
        """The rows of some buckets; the others' folders are not looked at."""
        return self._load([f for b, f in self._state(number).folders.items() if b in set(buckets)])

    def bucket_of(self, key: str) -> int:
        """The bucket of one key, reckoned on the driver."""
        return self.spark.sql("SELECT CAST(pmod(xxhash64(:k), :n) AS INT)", args={"k": key, "n": self.buckets}).first()[0]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, seen: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[dict[int, str], dict[int, dict]]:
        """Write rows in the columns of the table, those missing as null; the new folders by bucket, and their stats."""
        kept = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields], self.bucket().alias("__bucket"))
        folder = f"v-{uuid.uuid4().hex}"
        with writing(self.spark):
            seen(kept.hint("rebalance", "__bucket")).write.option("compression", "zstd").partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        made = names_in(self.spark, f"{self.path}/{folder}", folders_only=True)
        if not made:
            delete(self.spark, f"{self.path}/{folder}")
        new = {int(name.partition("=")[2]): f"{folder}/{name}" for name in made}
        return new, self._stats(self._load(list(new.values()))) if new else {}

    def replace(self, df: DataFrame, base: int | None = None, attempts: int = 100, about: dict | None = None) -> int:
        """A new version of these rows alone. base: the version they were made from; raises Conflict if there is a newer one."""
        new, stats = self._write(df)
        number = base if base is not None else max(sum(self._logged(), []), default=-1)
        for k in range(1, (1 if base is not None else attempts) + 1):
            if self._commit(number + k, new, stats, [], True, about or {}):
                return number + k
        self._drop(new)
        raise Conflict(f"version {base} of {self.path} is no longer the newest" if base is not None else f"{attempts} others wrote to {self.path} meanwhile")

    def change(self, buckets: DataFrame, make: Callable[[DataFrame], DataFrame], attempts: int = 10) -> int:
        """A new version in which only the buckets named (column bucket) differ: make(rows of these) gives their new rows.

        make is called again on newer rows where another writer changed one of the buckets meanwhile; after so many
        attempts that raises Conflict.
        """
        return self.change_buckets({r["bucket"] for r in buckets.select("bucket").distinct().collect()}, make, attempts)

    def change_buckets(self, touched: set[int], make: Callable[[DataFrame], DataFrame], attempts: int = 10, about: dict | None = None) -> int:
        for _ in range(attempts):
            number, folders, _, _ = self._state()
            new, stats = self._write(make(self._load([f for b, f in folders.items() if b in touched])))
            gone = [b for b in folders if b in touched and b not in new]
            while True:
                number += 1
                if self._commit(number, new, stats, gone, False, about or {}):
                    return number
                other = self._get(number, "commit")
                if other["whole"] or touched & ({int(b) for b in other["add"]} | set(other["drop"])):
                    break
            self._drop(new)
        raise Conflict(f"others wrote to the same buckets of {self.path}, {attempts} times")

    def _drop(self, folders: dict[int, str]) -> None:
        """Delete what no version has: folders that were just written."""
        for root in {f.partition("/")[0] for f in folders.values()}:
            delete(self.spark, f"{self.path}/{root}")

    def staged(self, rows: DataFrame, seen: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Write rows where merge leaves them, and read them back; until then no version has them. seen may observe what is written."""
        new, _ = self._write(rows, seen)
        out = self._load(list(new.values()))
        out._patternmill_folders, out._patternmill_unused = new, False
        return out

    def unstage(self, rows: DataFrame) -> None:
        """Delete what staged wrote and no merge took over; rows cannot be read then."""
        if rows._patternmill_unused:
            self._drop(rows._patternmill_folders)

    def merge(self, rows: DataFrame, order: str = "ingest_seq", gone: DataFrame | None = None, attempts: int = 10) -> int:
        """Upsert; rows are those of staged, else they are written first. gone: a written table of further keys, whose rows go.

        New rows are written once. Only keys are compared; a bucket that holds a row to be replaced or to go is written
        anew, the others keep their folders beside the new ones.
        """
        own = not hasattr(rows, "_patternmill_folders")
        rows = self.staged(rows) if own else rows
        new, last = rows._patternmill_folders, last_rows(rows, self.key, order)
        if last is not rows:
            new, _ = self._write(last)
            rows._patternmill_unused = True
        if own:
            self.unstage(rows)
        at, keys = set(new), self._load(list(new.values())).select(self.key)
        if gone is not None:
            keys = keys.unionByName(gone.select(self.key))
            at |= {r["bucket"] for r in gone.select(self.bucket().alias("bucket")).distinct().collect()}
        for _ in range(attempts):
            number, folders, _, _ = self._state()
            full = {b for b in new if folders.get(b, "").count(",") + 1 >= MOST_FOLDERS}
            kept, anew = self._without([folders[b] for b in sorted(at) if b in folders], keys, full)
            whole = {b: [kept.get(b) if b in anew else folders.get(b), new.get(b)] for b in at}
            add = {b: ",".join(f for f in both if f) for b, both in whole.items() if b in new or b in kept}
            drop = [b for b in anew if b not in add]
            while True:
                number += 1
                if self._commit(number, add, {}, drop, False, {}):
                    return number
                other = self._get(number, "commit")
                if other["whole"] or at & ({int(b) for b in other["add"]} | set(other["drop"])):
                    break
            self._drop(kept)
        self._drop(new)
        raise Conflict(f"others wrote to the same buckets of {self.path}, {attempts} times")

    def _without(self, held: list[str], keys: DataFrame, full: set[int]) -> tuple[dict[int, str], set[int]]:
        """Write the rows of those buckets anew that hold any of the keys, without these, and of full ones; the new folders, and the buckets."""
        if not held:
            return {}, set()
        old = self._load(held)
        stale = stored(old.select(self.key).join(keys, self.key, "left_semi"), "stale-keys")
        anew = {r["bucket"] for r in stale.select(self.bucket().alias("bucket")).distinct().collect()} | full
        kept = {}
        if anew:
            rest = self._load([f for f in held if int(f.rpartition("=")[2]) in anew])
            kept, _ = self._write(rest.join(stale, self.key, "left_anti"))
        forget(stale)
        return kept, anew

    def restore(self, number: int, attempts: int = 100) -> int:
        """An earlier version becomes the newest one, without a copy."""
        (_, folders, stats, about), newest = self._state(number), self._state().number
        for k in range(1, attempts + 1):
            if self._commit(newest + k, folders, stats, [], True, about):
                return newest + k
        raise Conflict(f"{attempts} others wrote to {self.path} meanwhile")

    def vacuum(self, keep: int = 1, older_than_s: float = 7 * 86_400) -> int:
        """Delete the log before the last `keep` versions, and the folders of no version left; how many.

        Folders changed within older_than_s stay, as a writer may be about to commit them; a failed write's go then.
        """
        commits, points = self._logged()
        kept = self.versions()[-max(1, keep) :]
        if kept[0]:
            self._checkpoint(kept[0])
        for n, kind in [(c, "commit") for c in commits if c < kept[0]] + [(p, "checkpoint") for p in points if p < kept[0]]:
            delete(self.spark, self._file(n, kind))
        used = {part for n in kept for f in self._state(n).folders.values() for part in f.split(",")}
        gone = 0
        for root in names_in(self.spark, self.path, folders_only=True):
            if not root.startswith("v-") or age_of(self.spark, f"{self.path}/{root}") < older_than_s:
                continue
            parts = [f"{root}/{b}" for b in names_in(self.spark, f"{self.path}/{root}", folders_only=True)]
            stale = [p for p in parts if p not in used]
            if len(stale) == len(parts):
                stale = [root]
            gone += sum(delete(self.spark, f"{self.path}/{p}") for p in stale)
        return gone

    def export(self, folder: str, number: int | None = None) -> int:
        """Copy a version to another place, with the digest of each file in a manifest that is written last; the number of files.

        The copies are made where Spark reads the files. Tables that keep files besides their folders have no export.
        """
        folder, state = folder.rstrip("/"), self._state(number)
        if state.about:
            raise ValueError("this kind of table cannot be exported")
        if exists(self.spark, folder) and names_in(self.spark, folder):
            raise FileExistsError(folder)
        paths = {f"{self.path}/{part}": f"{b}" for b, f in state.folders.items() for part in f.split(",")}
        files = copied(self.spark, paths, folder) if paths else []
        told = {"number": state.number, "stats": {str(b): x for b, x in state.stats.items()}, "files": sorted(files)}
        if not put_if_absent(self.spark, f"{folder}/manifest.json", json.dumps(told).encode()):
            raise FileExistsError(f"{folder}/manifest.json")
        return len(files)

    def import_from(self, folder: str) -> int:
        """Make an exported version the newest one of this table. A file that is missing, more, or not as it was exported raises ValueError, and nothing changes."""
        folder = folder.rstrip("/")
        told = json.loads(read_bytes(self.spark, f"{folder}/manifest.json"))
        buckets = sorted({b for b, *_ in told["files"]})
        root = f"v-{uuid.uuid4().hex}"
        try:
            made = copied(self.spark, {f"{folder}/{b}": f"{root}/__bucket={b}" for b in buckets}, self.path) if buckets else []
        except AnalysisException as e:
            raise ValueError(f"the copy at {folder} is not whole") from e
        made = sorted([b.rpartition("=")[2], *rest] for b, *rest in made)
        if made != told["files"]:
            delete(self.spark, f"{self.path}/{root}")
            raise ValueError(f"the copy at {folder} is not what was exported")
        new, number = {int(b): f"{root}/__bucket={b}" for b in buckets}, max(sum(self._logged(), []), default=-1)
        while True:
            number += 1
            if self._commit(number, new, {int(b): x for b, x in told["stats"].items()}, [], True, {}):
                return number

    def count(self) -> int:
        return self.read().count()


def copied(spark: SparkSession, folders: dict[str, str], target: str) -> list[list]:
    """Copy the files right below folders to those named below target: [folder, name, bytes, SHA-256] of each, reckoned from what was read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(target)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                home, name, data = (batch.column(c)[k].as_py() for c in range(3))
                system.create_dir(f"{base}/{home}", recursive=True)
                held = f"{base}/{home}/_{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(held, compression=None) as out:
                    out.write(data)
                system.move(held, f"{base}/{home}/{name}")
                rows.append({"home": home, "name": name, "n": len(data), "digest": sha256(data).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("home", pa.string()), ("name", pa.string()), ("n", pa.int64()), ("digest", pa.string())]))

    own = {qualified(spark, source): to for source, to in folders.items()}
    home = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    # Spark spells a local path with one slash or three, so the folder is looked up as it is spelled here.
    spelled = F.regexp_replace("path", "^file:/+", "file:///")
    files = spark.read.format("binaryFile").load(list(own)).select(F.element_at(home, F.regexp_replace(spelled, "/[^/]*$", "")).alias("home"), F.substring_index("path", "/", -1).alias("name"), "content")
    return [list(r) for r in files.where(~F.col("name").startswith("_") & ~F.col("name").startswith(".")).mapInArrow(run, "home string, name string, n long, digest string").collect()]


class BankTable(VersionedTable):
    """A bank of patterns."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, BANK, "point_id", buckets)


class CacheTable(VersionedTable):
    """A cache that outlives its process."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        super().__init__(spark, path, CACHE, "key", buckets)


class FileTable(VersionedTable):
    """The digests of a repository's files, as they were taken over last."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        super().__init__(spark, path, StructType([StructField("file_path", StringType()), StructField("digest", StringType())]), "file_path", buckets)
