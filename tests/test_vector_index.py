"""The index over vectors against a whole scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from patternmill.operators import search
from patternmill.session import stored
from patternmill.sources.tables import BankTable
from patternmill.sources.vector_index import NO_CELL, VectorIndex, recall

ROW = "point_id string, embedding array<float>, language string, ingest_seq long"
DIMS = 16


def vectors(n, seed=0):
    """Vectors around 12 centres, with copies, one of no length, one null, and one of another size."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(DIMS)] for _ in range(12)]
    out = [[x + rng.gauss(0, 0.3) for x in rng.choice(centres)] for _ in range(n)]
    out[5], out[6], out[7], out[8] = out[4], None, [0.0] * DIMS, [1.0] * 3
    return out


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    t = BankTable(spark, f"file://{tmp_path_factory.mktemp('index')}/bank", 8)
    rows = [(f"p{k:05}", v, "go" if k % 3 else "java", k) for k, v in enumerate(vectors(600))]
    t.replace(spark.createDataFrame(rows, ROW))
    return t


@pytest.fixture(scope="module")
def index(spark, bank):
    x = VectorIndex(spark, f"{bank.path}/_index")
    assert not x.built()
    x.build(bank)
    return x


def top(df):
    return [(r["point_id"], round(r["semantic"], 9)) for r in df.collect()]


def files(df):
    return df._jdf.inputFiles()


def test_every_point_has_one_cell(bank, index):
    rows = index.read().groupBy("point_id").agg(F.count("*").alias("n"), F.min("cell").alias("cell")).collect()
    assert len(rows) == 600 and all(r["n"] == 1 for r in rows) and {r["point_id"] for r in rows if r["cell"] == NO_CELL} == {"p00006", "p00007", "p00008"}
    assert len(index.centroids()) > 5


@pytest.mark.parametrize("k", [1, 10, 40])
def test_exact_search_equals_the_scan_and_reads_less(bank, index, k):
    read = []
    for n in range(0, 60, 9):
        q = vectors(600, n)[n]
        if q is None or len(q) != DIMS:
            continue
        found = index.candidates(q, k)
        assert top(search.semantic_top(found, q, k)) == top(search.semantic_top(bank.read().where("size(embedding) = 16 OR embedding IS NULL"), q, k))
        read.append(len(files(found)))
    assert min(read) < len(files(index.read())) and len(read) > 3


def test_probed_cells_alone_are_read(index):
    """The plan lists the folders of the probed cells, and no other."""
    q = vectors(600)[40]
    cells = index.cells_for(q, 2)
    found = index.search(q, 10, probes=2)
    folders = {f.rpartition("/")[0].rpartition("=")[2] for f in files(found)}
    assert folders == {str(c) for c in cells} and 0 < found.count() <= 10
    assert {r["cell"] for r in index.candidates(q, 10, 2).select("cell").distinct().collect()} == set(cells)


def test_filters_and_more_rows_than_there_are(bank, index):
    q = vectors(600)[40]
    where = lambda df: search.matching(df, "java")
    assert top(index.search(q, 10, where=where)) == top(search.semantic_top(where(bank.read().where("size(embedding) = 16 OR embedding IS NULL")), q, 10))
    assert index.search(q, 10**4).count() == 600
    assert index.search([0.0] * DIMS, 5).count() == 5 and index.search(q, 5, where=lambda df: df.limit(0)).count() == 0


def test_many_queries(spark, bank, index, monkeypatch):
    from patternmill.sources import vector_index

    asked = bank.read().where("ingest_seq % 20 = 0").select(F.col("ingest_seq").alias("query_id"), "embedding")
    want = {}
    for r in asked.collect():
        q = [float(x) for x in r["embedding"]]
        want[r["query_id"]] = [p for p, _ in top(search.semantic_top(bank.read().where("size(embedding) = 16 AND point_id <> 'p00007'").withColumn("embedding", F.col("embedding")), q, 7))]
    monkeypatch.setattr(vector_index, "PART_POINTS", 17)
    monkeypatch.setattr(vector_index, "PART_QUERIES", 4)
    got: dict = {}
    for r in index.search_many(asked, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["point_id"])
    same = sum(a == b for q in want for a, b in zip(got[q], want[q], strict=True))
    assert got.keys() == want.keys() and same >= 0.99 * 7 * len(want)
    some = recall(index.search_many(asked, 7, 8), index.search_many(asked, 7)).first()
    assert some["queries"] == 30 and some["recall"] > 0.9
    odd = spark.createDataFrame([(1, None), (2, [0.0] * DIMS), (3, [1.0])], "query_id long, embedding array<float>")
    assert index.search_many(odd, 5).count() == 0


def test_refresh_takes_over_changes_alone(spark, tmp_path):
    rows = [(f"p{k:05}", v, "go", k) for k, v in enumerate(vectors(300, 3))]
    bank = BankTable(spark, f"file://{tmp_path}/bank", 8)
    bank.replace(spark.createDataFrame(rows, ROW))
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    index.build(bank, 10)
    assert index.refresh(bank) == 0
    near = lambda: {r["point_id"] for r in index.read().collect()}
    bank.merge(spark.createDataFrame([("p00020", rows[30][1], "go", 999), ("new", rows[40][1], "rust", 1000)], ROW))
    touched = index.refresh(bank)
    assert 1 <= touched <= 4 and near() == {r[0] for r in rows} | {"new"} and index.refresh(bank) == 0
    moved = index.read().where("point_id IN ('p00020', 'p00030')").select("cell").distinct().collect()
    assert len(moved) == 1
    keys = {bank.bucket_of("p00001")}
    bank.change_buckets(keys, lambda old: old.where("point_id <> 'p00001'"))
    assert index.refresh(bank) == 1 and "p00001" not in near()
    plain = lambda df: sorted(map(repr, df.drop("cell", "closeness", "digest").collect()))
    assert plain(index.read()) == plain(bank.read())
    bank.replace(bank.read().limit(0))
    index.refresh(bank)
    assert near() == set() and index.search(rows[0][1], 5).count() == 0


def test_empty_banks_and_banks_without_vectors(spark, tmp_path):
    bank = BankTable(spark, f"file://{tmp_path}/bank", 8)
    bank.create()
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    index.build(bank)
    assert index.search([1.0] * DIMS, 5).count() == 0
    bank.replace(spark.createDataFrame([("a", None, "go", 1)], ROW))
    index.refresh(bank)
    assert index.search([1.0], 5).count() == 1


def test_search_through_the_bank(spark, tmp_path):
    from patternmill.plans.api import PatternBank

    b = PatternBank(spark, f"file://{tmp_path}/bank")
    form = lambda k: (f"def handler_{k}(request):\n    return retry(request, {k})  # " + "word " * (k % 7), f"Retry number {k}", f"Retries the request {k} times", "utilities", "python")
    schema = "content string, title string, description string, category string, language string"
    b.store(spark.createDataFrame([form(k) for k in range(60)], schema))
    ask = lambda **more: [(r["point_id"], round(r["hybrid"], 9)) for r in b.search("retry the request handler", min_quality=1, **more).orderBy("rank").collect()]
    plain = ask()
    b.build_index(6)
    assert ask() == plain and len(ask(probes=1)) <= 10
    b.store(spark.createDataFrame([(" retry the request handler retry the request handler", "Retry request handler", "retry the request handler", "utilities", "python")], schema))
    assert len(ask()) == 10 and ask()[0] not in plain


def test_a_query_goes_to_a_block_once(spark, bank, index, monkeypatch):
    """Small cells are one block, so as many rows are sent as there are queries, not as many for each cell; with probes too."""
    from patternmill.sources import vector_index

    sent = []
    monkeypatch.setattr(vector_index, "stored", lambda df, name: sent.append(stored(df, name)) or sent[-1])
    asked = bank.read().where("ingest_seq % 20 = 0").select(F.col("ingest_seq").alias("query_id"), "embedding")
    found = index.search_many(asked, 3), index.search_many(asked, 3, 4)
    assert len(index.centroids()) > 4 and [s.count() for s in sent] == [asked.count()] * 2
    assert recall(*found).first()["queries"] == recall(*reversed(found)).first()["queries"] == asked.count()
