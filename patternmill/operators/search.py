"""Search: filters, cosine similarity, keyword reranking."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternmill.functions.text import keyword_score
from patternmill.schema import CANDIDATE_CAP, KEYWORD_WEIGHT, OVERFETCH, PROJECT_WORDS, SEMANTIC_WEIGHT, STOP_WORDS


_TOKENS, _NAME = re.compile(r"\w+"), re.compile(r"[a-z_][a-z0-9_]*")


def matching(df: DataFrame, language: str | None = None, category: str | None = None, min_quality: int = 1) -> DataFrame:
    """language and category are equal, quality at least min_quality; 1 is no limit, above it rows without one go."""
    if language:
        df = df.where(F.col("language") == language.lower())
    if category:
        df = df.where(F.col("category") == category.lower())
    return df.where(F.col("quality_score") >= min_quality) if min_quality > 1 else df


def in_category(df: DataFrame, category: str | None) -> DataFrame:
    """F8: all, none and empty are no limit."""
    return df if category in (None, "", "all") else df.where(F.col("category") == category)


def cosine(vector: Column, query: list[float]) -> Column:
    """R4 in doubles, folded in order; 0 where a norm is 0, null without a vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), zero, lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, zero, lambda a, x: a + x * x))
    other = F.sqrt(F.aggregate(q, zero, lambda a, x: a + x * x))
    return F.when(vector.isNotNull(), F.when(norm * other > 0, dot / (norm * other)).otherwise(zero))


def query_keywords(query: str, n: int = 10) -> list[str]:
    """X10 for one query, on the driver: most frequent first, ties by first occurrence."""
    found = [t for t in _TOKENS.findall(query.lower()) if _NAME.fullmatch(t) and t not in STOP_WORDS and len(t) > 2]
    return sorted(dict.fromkeys(found), key=lambda t: (-found.count(t), found.index(t)))[:n]


def semantic_top(df: DataFrame, query: list[float], k: int) -> DataFrame:
    """O1: the k rows of the highest similarity, ties by point_id."""
    return df.withColumn("semantic", cosine(F.col("embedding"), query)).orderBy(F.desc("semantic"), "point_id").limit(k)


def hybrid_top(
    df: DataFrame, query: str, vector: list[float], k: int, candidate_cap: int | None = CANDIDATE_CAP, enabled: bool = True, semantic_weight: float = SEMANTIC_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT
) -> DataFrame:
    """The candidates of the highest similarity, reranked with the keywords of the query by the weights, which need not add up to 1.

    Of min(3 k, candidate_cap) candidates; with a cap no more than that many rows come back, whatever k is. R7: a row
    without a similarity counts as 1 in the reranking, and comes last among the candidates.
    """
    n = OVERFETCH * k if candidate_cap is None else min(OVERFETCH * k, candidate_cap)
    if not enabled:
        top = semantic_top(df, vector, k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("semantic"), "point_id")))
    found = semantic_top(df, vector, n)
    ranked = found.withColumn("semantic_rank", F.row_number().over(Window.orderBy(F.desc("semantic"), "point_id")))
    words = query_keywords(query)
    keywords = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    scored = ranked.withColumn("lowered", F.lower("document")).withColumn("keyword", keyword_score(F.col("lowered"), keywords)).drop("lowered")
    hybrid = scored.withColumn("hybrid", F.lit(float(semantic_weight)) * F.coalesce("semantic", F.lit(1.0)) + F.lit(float(keyword_weight)) * F.col("keyword"))
    top = hybrid.orderBy(F.desc("hybrid"), "semantic_rank").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hybrid"), "semantic_rank")))


def scaffold_query(kind: Column, stack: Column) -> Column:
    """Kind, stack and the words of the kind; stack is an array."""
    words = F.create_map(*[F.lit(x) for pair in PROJECT_WORDS.items() for x in pair])
    return F.concat(kind, F.lit(" "), F.array_join(stack, " "), F.lit(" "), F.coalesce(F.element_at(words, kind), F.lit("")))


def split_stack(c: Column) -> Column:
    """X26."""
    return F.transform(F.split(c, ",", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def embed(texts: Iterable[str | None], dims: int = 64) -> list[list[float]]:
    """A deterministic stand-in for a model: counts of hashed tokens with hashed signs, of unit length; zeros without tokens."""
    out = []
    for t in texts:
        hashes = np.array([zlib.crc32(w.encode()) for w in _TOKENS.findall((t or "").lower()) if _NAME.fullmatch(w)], np.int64)
        raw = np.bincount(hashes % dims, np.where(hashes >> 31, 1.0, -1.0), dims) if len(hashes) else np.zeros(dims)
        norm = float(np.sqrt((raw * raw).sum()))
        out.append((raw / norm if norm else raw).tolist())
    return out


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """D3: embed as an Arrow-batched function; a model takes its place by the same shape. A fold over arrays in columns
    would copy the vector for each token.
    """

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(embed(values, dims))

    return run(text)


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]
