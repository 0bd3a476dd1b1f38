"""The log of versioned tables: writers at once, failures, checkpoints, vacuum."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from patternmill import session
from patternmill.sources import tables
from patternmill.sources.tables import BankTable, Conflict

ROW = "point_id string, document string, ingest_seq long"


@pytest.fixture
def bank(spark, tmp_path):
    t = BankTable(spark, f"file://{tmp_path}/bank", buckets=8)
    t.create()
    return t


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(pairs)], ROW)


def held(t, number=None):
    return {r["point_id"]: r["document"] for r in t.read(number).collect()}


def test_put_if_absent(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/x/a.json"
    assert session.put_if_absent(spark, path, b"1") and not session.put_if_absent(spark, path, b"2")
    assert session.read_bytes(spark, path) == b"1" and session.names_in(spark, f"file://{tmp_path}/x") == ["a.json"]
    session.put_bytes(spark, f"file://{tmp_path}/x/b", b"3")
    with pytest.raises(FileExistsError):
        session.renamed(spark, f"file://{tmp_path}/x/b", path)
    session.renamed(spark, f"file://{tmp_path}/x/b", f"file://{tmp_path}/x/c")
    assert session.read_bytes(spark, f"file://{tmp_path}/x/c") == b"3"


def test_two_writers_on_the_same_buckets(spark, bank):
    """The second merge reads before the first commits, and commits after it: both survive, also for one key."""
    bank.replace(rows(spark, ("a", "0"), ("b", "0")))
    other, calls = BankTable(spark, bank.path, 8), []

    def slow(old):
        if not calls:
            other.merge(spark.createDataFrame([("a", "first", 5), ("c", "first", 5)], ROW))
        calls.append(1)
        return tables.upsert(old, spark.createDataFrame([("a", "second", 6), ("d", "second", 6)], ROW), "point_id", "ingest_seq")

    keys = {bank.bucket_of(k) for k in ("a", "d")}
    bank.change_buckets(keys, slow)
    assert held(bank) == {"a": "second", "b": "0", "c": "first", "d": "second"} and len(calls) == 2
    assert len(bank.versions()) == 4


def test_two_writers_on_other_buckets_need_no_second_attempt(spark, bank):
    keys = [f"k{n}" for n in range(40)]
    one = keys[0]
    two = next(k for k in keys if bank.bucket_of(k) != bank.bucket_of(one))
    bank.replace(rows(spark, *[(k, "0") for k in keys]))
    other, calls = BankTable(spark, bank.path, 8), []

    def slow(old):
        calls.append(1)
        other.change_buckets({other.bucket_of(two)}, lambda old: old.withColumn("document", F.lit("other")))
        return old.withColumn("document", F.lit("own"))

    bank.change_buckets({bank.bucket_of(one)}, slow)
    now = held(bank)
    assert now[one] == "own" and now[two] == "other" and len(calls) == 1 and len(now) == 40


def test_conflicts_raise_in_the_end(spark, bank):
    bank.replace(rows(spark, ("a", "0")))
    other = BankTable(spark, bank.path, 8)

    def beaten(old):
        other.merge(rows(spark, ("a", "again")))
        return old

    with pytest.raises(Conflict):
        bank.change_buckets({bank.bucket_of("a")}, beaten, attempts=3)
    base = bank.versions()[-1]
    other.merge(rows(spark, ("b", "new")))
    with pytest.raises(Conflict):
        bank.replace(rows(spark, ("x", "lost")), base)
    assert held(bank) == {"a": "again", "b": "new"}
    used = {f.partition("/")[0] for n in bank.versions() for f in bank._state(n).folders.values()}
    assert {n for n in session.names_in(spark, bank.path, folders_only=True) if n.startswith("v-")} == used, "what was not committed is gone"


def test_versions_open_few_files(spark, bank):
    for n in range(25):
        bank.change_buckets({n % 8}, lambda old, n=n: old.unionByName(rows(spark, (f"k{n}", str(n))), allowMissingColumns=True))
    assert bank.versions() == list(range(26)) and max(len(bank.log_files(n)) for n in bank.versions()) <= tables.CHECKPOINT + 1
    assert len(held(bank)) > 0 and len(bank.log_files()) <= 6
    with pytest.raises(ValueError):
        bank.read(26)
    with pytest.raises(ValueError):
        BankTable(spark, bank.path + "-none").read()


def test_vacuum(spark, bank):
    for n in range(13):
        bank.merge(rows(spark, ("a", str(n)), (f"k{n}", "x")))
    want = {n: held(bank, n) for n in bank.versions()}
    assert bank.vacuum(keep=3) == 0, "young folders stay"
    assert bank.versions() == [11, 12, 13]
    before = len(session.names_in(spark, bank.path))
    assert bank.vacuum(keep=3, older_than_s=-1) > 0 and len(session.names_in(spark, bank.path)) < before
    assert {n: held(bank, n) for n in (11, 12, 13)} == {n: want[n] for n in (11, 12, 13)}
    with pytest.raises(ValueError):
        bank.read(5)
    assert bank.restore(11) == 14 and held(bank) == want[11] and bank.merge(rows(spark, ("z", "z"))) == 15 and held(bank)["z"] == "z"


def test_writer_killed_halfway(spark, bank):
    """A process that is killed after it has written its folders leaves the table as it was; the next write and vacuum go on."""
    bank.replace(rows(spark, ("a", "0")))
    script = textwrap.dedent(f"""
        import os, signal
        from pyspark.sql import SparkSession
        from patternmill.sources import tables
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        t = tables.BankTable(spark, {bank.path!r}, 8)
        t._commit = lambda *a: os.kill(os.getpid(), signal.SIGKILL)
        t.merge(spark.createDataFrame([("a", "lost", 9), ("b", "lost", 9)], {ROW!r}))
    """)
    run = subprocess.run([sys.executable, "-c", script], env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}, capture_output=True, timeout=120)
    assert run.returncode == -9
    folders = lambda: {n for n in session.names_in(spark, bank.path, folders_only=True) if n.startswith("v-")}
    assert held(bank) == {"a": "0"} and len(folders()) == 2
    bank.merge(rows(spark, ("b", "kept")))
    assert held(bank) == {"a": "0", "b": "kept"} and bank.vacuum(keep=9, older_than_s=-1) == 1 and len(folders()) == 2


def test_snapshots(spark, bank, tmp_path):
    """A version is copied elsewhere and back; a changed byte, a missing and an added file are refused."""
    import pathlib

    bank.replace(rows(spark, *[(f"k{n}", str(n)) for n in range(50)]))
    bank.merge(rows(spark, ("k1", "new")))
    there = f"file://{tmp_path}/copy"
    assert bank.export(there, 1) >= 8
    with pytest.raises(FileExistsError):
        bank.export(there)
    other = BankTable(spark, f"file://{tmp_path}/other bank", 8)
    other.create()
    other.merge(rows(spark, ("gone", "x")))
    assert other.import_from(there) == 2 and held(other) == held(bank, 1) and held(bank)["k1"] == "new"
    assert other.merge(rows(spark, ("k2", "later"))) == 3 and held(other)["k2"] == "later" and held(bank, 1)["k2"] == "2"
    file = sorted(pathlib.Path(tmp_path / "copy").rglob("*.parquet"))[0]
    data = file.read_bytes()
    folders = session.names_in(spark, other.path)
    for broken in (data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], data[:-1], None):
        file.unlink() if broken is None else file.write_bytes(broken)
        with pytest.raises(ValueError):
            other.import_from(there)
    file.write_bytes(data)
    (file.parent / "more.parquet").write_bytes(data)
    with pytest.raises(ValueError):
        other.import_from(there)
    assert other.versions() == [0, 1, 2, 3] and session.names_in(spark, other.path) == folders
    empty = BankTable(spark, f"file://{tmp_path}/empty", 8)
    empty.create()
    empty.export(f"file://{tmp_path}/nothing")
    assert other.import_from(f"file://{tmp_path}/nothing") == 4 and held(other) == {}


def test_merge_adds_beside_what_is_there(spark, bank):
    """Buckets without a replaced row keep their folders, so a merge writes its own rows; many folders of a bucket become one."""
    bank.replace(rows(spark, *[(f"k{n}", str(n)) for n in range(40)]))
    first = bank._folders()
    bank.merge(rows(spark, *[(f"m{n}", "new") for n in range(40)], ("m3", "last"), ("k7", "again")))
    now, seven = bank._folders(), bank.bucket_of("k7")
    assert all(now[b].startswith(f"{first[b]},") for b in first if b != seven) and first[seven] not in now[seven]
    assert bank.count() == 80 and held(bank)["m3"] == "last" and held(bank)["k7"] == "again"
    gone = session.stored(bank.read().where("point_id = 'k8'").select("point_id"), "gone")
    bank.merge(rows(spark, ("z", "z")), gone=gone)
    assert bank.count() == 80 and "k8" not in held(bank)
    for n in range(2 * tables.MOST_FOLDERS):
        bank.merge(rows(spark, *[(f"r{n}-{k}", "x") for k in range(40)]))
    assert max(f.count(",") + 1 for f in bank._folders().values()) <= tables.MOST_FOLDERS and bank.count() == 80 + 80 * tables.MOST_FOLDERS
    assert bank.vacuum(older_than_s=-1) > 0 and bank.count() == len(held(bank)) == 80 + 80 * tables.MOST_FOLDERS


def test_last_rows_is_latest(spark):
    """Rows whose key is there once are not shuffled; the last of the others counts, also for a null key."""
    from patternmill.operators import bank as bank_ops

    once = session.stored(rows(spark, ("a", "1"), ("b", "2")), "once")
    assert bank_ops.last_rows(once) is once
    twice = rows(spark, ("a", "1"), (None, "2"), ("b", "3"), ("a", "4"), (None, "5"))
    assert sorted((r["point_id"] or "", r["document"]) for r in bank_ops.last_rows(twice).collect()) == [("", "5"), ("a", "4"), ("b", "3")]
