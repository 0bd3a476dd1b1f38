"""The layout of a bank by language and category."""

from __future__ import annotations

import pytest

from patternmill.operators import search
from patternmill.sources.derived import ClusteredBank
from patternmill.sources.tables import BankTable

ROW = "point_id string, document string, language string, category string, quality_score int, ingest_seq long"


def rows(n, start=0):
    languages, categories = ["go", "java", "python", None], ["testing", "security", "logging", None]
    return [(f"p{k}", f"text {k}", languages[k % 4], categories[k // 4 % 4], None if k % 9 == 0 else k % 10, k) for k in range(start, start + n)]


def found(df, *where):
    return sorted(r["point_id"] for r in search.matching(df, *where).collect())


@pytest.mark.parametrize("where", [("go", None, 1), (None, "security", 1), ("JAVA", "Testing", 5), ("rust", None, 1), (None, None, 9), (None, None, 11), (None, None, 1)])
def test_same_answer_from_fewer_files(spark, tmp_path, where):
    bank, clusters = BankTable(spark, f"file://{tmp_path}/bank", 8), ClusteredBank(spark, f"file://{tmp_path}/clusters")
    bank.replace(spark.createDataFrame(rows(200), ROW))
    clusters.build(bank)
    some = clusters.candidates(*where)
    assert some.columns == bank.read().columns and found(some, *where) == found(bank.read(), *where)
    n, every = len(some._jdf.inputFiles()), len(clusters.read()._jdf.inputFiles())
    assert n <= every and (n < every or where in ((None, None, 1), (None, None, 9)))
    if where == ("JAVA", "Testing", 5):
        assert n <= 2


def test_refresh(spark, tmp_path):
    bank, clusters = BankTable(spark, f"file://{tmp_path}/bank", 8), ClusteredBank(spark, f"file://{tmp_path}/clusters")
    bank.replace(spark.createDataFrame(rows(100), ROW))
    clusters.build(bank)
    assert clusters.refresh(bank) == 0
    bank.merge(spark.createDataFrame([("p1", "moved", "rust", "testing", 10, 999)], ROW))
    assert clusters.refresh(bank) == 2 and found(clusters.candidates("rust"), "rust") == ["p1"] and "p1" not in found(clusters.candidates("java"), "java")
    assert clusters.read().count() == 100


def test_search_through_the_bank(spark, tmp_path):
    from patternmill.plans.api import PatternBank

    b = PatternBank(spark, f"file://{tmp_path}/bank")
    form = [(f"def handler_{k}(request):\n    return retry(request, {k})", f"Retry number {k}", f"Retries the request {k} times", ["utilities", "testing"][k % 2], ["python", "go"][k // 2 % 2]) for k in range(24)]
    schema = "content string, title string, description string, category string, language string"
    b.store(spark.createDataFrame(form, schema))
    ask = lambda: [r["title"] for r in b.search("retry the request handler", "go", "testing", 1).orderBy("rank").collect()]
    plain = ask()
    b.build_clusters()
    assert ask() == plain and len(plain) == 6
    b.store(spark.createDataFrame([("retry the request handler " * 3, "Newest of all", "retry the request handler", "testing", "go")], schema))
    assert len(ask()) == 7 and "Newest of all" in ask()
