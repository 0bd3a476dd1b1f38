"""Checks of input rows as arrays of messages; a row is valid if it has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternmill.schema import CATEGORIES, LANGUAGES


def _errors(rules: dict[str, Column]) -> Column:
    told = F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items()])
    return F.filter(told, lambda x: x.isNotNull())


def _length(c: str, least: int, most: int | None = None) -> Column:
    n = F.length(c)
    return n < least if most is None else (n < least) | (n > most)


def store_errors(scored: bool = True) -> Column:
    """Content, title, description, category, language and, if there is one, quality_score of a pattern to store."""
    quality = F.coalesce(F.col("quality_score"), F.lit(5)) if scored else F.lit(5)
    return _errors(
        {
            "content": _length("content", 10),
            "title": _length("title", 3, 200),
            "description": _length("description", 10),
            "category": ~F.lower("category").isin(CATEGORIES),
            "language": ~F.lower("language").isin(LANGUAGES),
            "quality_score": ~quality.between(1, 10),
        }
    )


def search_errors() -> Column:
    """Query, limit, min_quality, and language and category where given."""
    return _errors(
        {
            "query": _length("query", 3),
            "limit": ~F.coalesce("limit", F.lit(10)).between(1, 100),
            "min_quality": ~F.coalesce("min_quality", F.lit(5)).between(1, 10),
            "language": F.col("language").isNotNull() & ~F.lower("language").isin(LANGUAGES),
            "category": F.col("category").isNotNull() & ~F.lower("category").isin(CATEGORIES),
        }
    )


def sync_errors() -> Column:
    return _errors({"repo_name": ~F.col("repo_name").rlike(r"(?U)\A[\w\-.]+/[\w\-.]+\z"), "min_quality": ~F.coalesce("min_quality", F.lit(5)).between(1, 10)})


def scaffold_errors() -> Column:
    return _errors({"project_name": ~F.col("project_name").rlike(r"\A[a-zA-Z0-9\-_]{1,100}\z"), "project_type": _length("project_type", 3), "tech_stack": _length("tech_stack", 3)})
