"""The functions for users of SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patternmill.functions import paths, sql
from patternmill.functions.text import keyword_score
from patternmill.operators import bank, scanners, search

BODY = "import os\n\n\nclass Handler:\n" + "".join(f"    def step_{k}(self):\n        return {k}\n" for k in range(6))
FILES = [("r", "a.py", "python", BODY, 1), ("r", "src/.env", "unknown", "\n".join("x" * 3 for _ in range(400)), 2), (None, "b.JAVA", "java", None, 3), ("r", "c", None, "short", 4)]
SCHEMA = "repo string, file_path string, language string, content string, error int"


@pytest.fixture(scope="module")
def view(spark):
    assert set(sql.register(spark)) == {s[0] for s in sql.SCALARS} | {"chunk_file", "line_windows"}
    sql.register(spark)
    df = spark.createDataFrame(FILES, SCHEMA)
    df.createOrReplaceTempView("some_files")
    return df


def test_chunk_file_equals_the_operator(spark, view):
    """Columns that the function adds replace those of the table of the same name."""
    got = spark.sql("SELECT * FROM chunk_file(TABLE(some_files))")
    want = scanners.extracted(view.drop("error"))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 3


def test_partitioned_and_missing_columns(spark, view):
    n = spark.sql("SELECT count(*) AS n FROM chunk_file(TABLE(some_files) PARTITION BY language)").first()["n"]
    assert n == scanners.extracted(view.drop("error")).count()
    with pytest.raises(Exception, match="must have columns file_path"):
        spark.sql("SELECT * FROM chunk_file(TABLE(SELECT content, language FROM some_files))").collect()


def test_a_file_that_fails_is_a_row(spark, view, monkeypatch):
    def bad(*args):
        raise ValueError("no good")

    monkeypatch.setattr(sql, "chunks_of", bad)
    made = sql.ChunkFile()
    from pyspark.sql import Row

    assert list(made.eval(Row(content="x", file_path="p", language=None))) == [("p", None, *[None] * 7, "ValueError: no good")]


def test_line_windows(spark, view):
    rows = spark.sql("SELECT file_path, window_no, start_line, end_line FROM line_windows(TABLE(some_files), size => 100, overlap => 20) ORDER BY ALL").collect()
    assert [tuple(r)[1:] for r in rows if r["file_path"] == "src/.env"] == [(k, 80 * k + 1, min(80 * k + 100, 400)) for k in range(5)]
    assert spark.sql("SELECT count(*) AS n FROM line_windows(TABLE(some_files))").first()["n"] == 4
    with pytest.raises(Exception, match="overlap less than size"):
        spark.sql("SELECT * FROM line_windows(TABLE(some_files), size => 10, overlap => 10)").collect()


def test_scalars_equal_the_columns(spark, view):
    told = view.select(
        F.call_function("pattern_id", "repo", "file_path", "content").eqNullSafe(bank.point_id(F.col("repo"), F.col("file_path"), F.col("content"))).alias("a"),
        F.call_function("language_of", "file_path").eqNullSafe(paths.language_of(F.col("file_path"))).alias("b"),
        F.call_function("keyword_match", "content", F.array(F.lit("return"), F.lit("x"))).eqNullSafe(keyword_score(F.lower("content"), F.array(F.lit("return"), F.lit("x")))).alias("c"),
        F.call_function("pattern_preview", "content").eqNullSafe(bank.preview(F.col("content"))).alias("d"),
    ).collect()
    assert all(all(v is not False for v in r) for r in told)
    vectors = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in vectors.select(F.call_function("vector_cosine", F.col("v").cast("array<double>"), F.array(F.lit(2.0), F.lit(1.0)))).collect()] == [r[0] for r in vectors.select(search.cosine(F.col("v"), [2.0, 1.0])).collect()]
    assert "PythonUDF" not in spark.sql("SELECT vector_cosine(array(1D), array(2D)), language_of('a.py')")._jdf.queryExecution().optimizedPlan().toString()
