"""Keywords of texts, against a count word by word; in time that grows with the text."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from patternmill.functions import text


def keywords(spark, rows, n=10):
    got = text.top_keywords(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", n).orderBy("doc_id", "rank").collect()
    return [tuple(r) for r in got]


def test_ties_stop_words_and_other_scripts(spark):
    rows = [(1, "Zeta alpha ZETA the the def_x über12 äbc 12ab _ab\nalpha beta"), (2, None), (3, ""), (4, "größe naïve x́yz İstanbul ok okay")]
    assert keywords(spark, rows)[:5] == [(1, 1, "zeta", 2), (1, 2, "alpha", 2), (1, 3, "def_x", 1), (1, 4, "_ab", 1), (1, 5, "beta", 1)]
    assert {r[0] for r in keywords(spark, rows)} == {1, 4} and {"okay"} <= {r[2] for r in keywords(spark, rows) if r[0] == 4} <= {"okay", "stanbul"}
    assert keywords(spark, rows, 1)[0] == (1, 1, "zeta", 2)


def test_many_words_take_little_time(spark):
    """Two million words in 200 rows."""
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda k: F.concat(F.lit("word"), (k * 7919 % 5_003).cast("string")))).alias("text"))
    began = time.time()
    assert text.top_keywords(df, "doc_id", "text").where("hits = 2").count() > 0
    assert time.time() - began < 6
