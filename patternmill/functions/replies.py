"""Replies of analyzers as JSON text: unwrapping, parsing, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternmill.schema import CATEGORIES

_RAW = "is_pattern string, title string, description string, category string, quality_score string, use_cases array<string>"
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def unwrap_fence(c: Column) -> Column:
    """The text within a code fence, without the fence's language name."""
    t = F.trim(F.regexp_replace(c, r"^[\s]+|[\s]+$", ""))
    inner = F.get(F.split(t, "```"), F.lit(1))
    inner = F.regexp_replace(inner, r"^(?:json|JSON)", "")
    t = F.when(t.startswith("```"), inner).otherwise(t)
    return F.regexp_replace(F.regexp_replace(t, r"```$", ""), r"^\s+|\s+$", "")


def parse_object(c: Column, schema: str) -> Column:
    """A JSON object or null; broken JSON and text behind the object make it null."""
    t = unwrap_fence(c)
    parsed = F.from_json(t, schema + ", _corrupt_record string", _STRICT)
    return F.when(t.rlike(r"^\{") & t.rlike(r"\}$") & parsed["_corrupt_record"].isNull(), parsed)


def analysis_of(c: Column) -> Column:
    """The reply as an analysis struct with defaults; null if it is none.

    A category in any case, unknown ones become other; a quality that is a number or a string of a whole number is cut
    to 1 to 10. An empty object, a null category or a quality that is no number gives null.
    """
    raw = parse_object(c, _RAW)
    t = unwrap_fence(c)
    has = lambda k: F.get_json_object(t, f"$.{k}").isNotNull()
    named_null = lambda k: t.rlike(rf'"{k}"\s*:\s*null')
    category = F.lower(raw["category"])
    category = F.when(category.isin(CATEGORIES), category).when(category.isNull() & ~named_null("category"), "other").when(category.isNotNull(), "other")
    text_number = t.rlike(r'"quality_score"\s*:\s*"')
    quality = F.when(~has("quality_score") & ~named_null("quality_score"), F.lit(5)).otherwise(
        F.when(text_number & raw["quality_score"].rlike(r"^\s*[+-]?\d+\s*$"), _clamped(F.trim(raw["quality_score"]).try_cast("double")))
        .when(raw["quality_score"].isin("true", "false") & ~text_number, F.lit(1))
        .when(~text_number, _clamped(raw["quality_score"].try_cast("double")))
    )
    # What counts as false: nothing, false, zero as a number, and empty texts, lists and objects.
    zero = t.rlike(r'"is_pattern"\s*:\s*-?0+(?:\.0*)?(?:[eE][+-]?\d+)?\s*[,}]')
    truthy = raw["is_pattern"].isNotNull() & ~raw["is_pattern"].isin("false", "", "[]", "{}") & ~zero
    out = F.struct(
        F.coalesce(truthy | t.rlike(r'"is_pattern"\s*:\s*"false"'), F.lit(False)).alias("is_pattern"),
        F.coalesce(raw["title"], F.lit("Untitled Pattern")).alias("title"),
        F.coalesce(raw["description"], F.lit("")).alias("description"),
        category.alias("category"),
        quality.alias("quality_score"),
        F.coalesce(raw["use_cases"], F.array().cast("array<string>")).alias("use_cases"),
    )
    empty = t.rlike(r"^\{\s*\}$")
    return F.when(raw.isNotNull() & ~empty & category.isNotNull() & quality.isNotNull(), out)


def _clamped(c: Column) -> Column:
    """Cut to 1 to 10 before the cast, which would stop at numbers beyond its range."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), c)).cast("int")


def structure_of(c: Column) -> Column:
    """(directories, files) of a project reply; missing keys are empty, an empty object is null."""
    raw = parse_object(c, "directories array<string>, files map<string,string>")
    made = F.struct(F.coalesce(raw["directories"], F.array().cast("array<string>")).alias("directories"), F.coalesce(raw["files"], F.create_map().cast("map<string,string>")).alias("files"))
    return F.when(raw.isNotNull() & ~unwrap_fence(c).rlike(r"^\{\s*\}$"), made)
