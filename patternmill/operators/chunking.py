"""Chunks by columns alone: a file in parts (G9), windows of characters (X7), packed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.functions.paths import stem
from patternmill.functions.text import NON_BLANK, char_windows, lines, packed_lines
from patternmill.schema import MAX_LINES, MIN_LINES, OVERLAP_LINES


def file_parts(df: DataFrame, content: str = "content", path: str = "file_path") -> DataFrame:
    """G9 as columns: (other columns, chunk_no, content, start_line, end_line, chunk_type, name).

    A window starts every 140 lines; a running number over the valid windows of a file names them.
    """
    rest = [c for c in df.columns if c != content]
    split = df.select(*rest, lines(F.col(content)).alias("__lines")).where(F.col("__lines").isNotNull())
    n, step = F.size("__lines"), MAX_LINES - OVERLAP_LINES
    starts = F.when(n <= MAX_LINES, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - OVERLAP_LINES - 1, F.lit(step)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("__lines", s + 1, F.lit(MAX_LINES)).alias("held")))
    valid = F.filter(cut, lambda w: F.size(F.filter(w["held"], lambda x: x.rlike(NON_BLANK))) >= MIN_LINES)
    out = split.withColumn("__parts", F.size("__lines") > MAX_LINES).select(*rest, "__parts", F.posexplode(valid).alias("chunk_no", "__w"))
    name = F.when(F.col("__parts"), F.concat(stem(F.col(path)), F.lit("_part"), (F.col("chunk_no") + 1).cast("string"))).otherwise(stem(F.col(path)))
    return out.select(
        *rest, "chunk_no", F.array_join("__w.held", "\n").alias("content"), (F.col("__w.start") + 1).alias("start_line"), (F.col("__w.start") + F.size("__w.held")).alias("end_line"),
        F.when(F.col("__parts"), "file_part").otherwise("file").alias("chunk_type"), name.alias("name"),
    )


def window_rows(df: DataFrame, key: str, text: str, max_tokens: int = 512, overlap: int = 50) -> DataFrame:
    return df.select(key, F.explode(char_windows(F.col(text), max_tokens, overlap)).alias("w")).select(key, "w.*")


def packed_rows(df: DataFrame, key: str, text: str, max_tokens: int = 512, overlap: int = 50) -> DataFrame:
    packed = df.select(key, packed_lines(F.col(text), max_tokens, overlap).alias("p"))
    return packed.select(key, F.size("p").alias("total_chunks"), F.posexplode("p").alias("chunk_index", "text"))
