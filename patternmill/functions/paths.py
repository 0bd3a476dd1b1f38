"""Paths, extensions and name patterns."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternmill.schema import EXTENSIONS, IGNORED_DIRS


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """From the last dot on; none for names that start with their only dot."""
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = name_of(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def language_of(path: Column) -> Column:
    """By the extension in any case."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(suffix(path))), F.lit("unknown"))


def is_code_file(path: Column, is_dir: Column | None = None) -> Column:
    """the extension as it is written must be a known one."""
    known = suffix(path).isin(list(EXTENSIONS))
    return known if is_dir is None else ~is_dir & known


def ends_with_any(path: Column, endings: list[str]) -> Column:
    """F3."""
    out = F.lit(False)
    for e in endings:
        out = out | path.endswith(e)
    return out


def in_ignored_dir(path: Column, is_dir: Column | None = None, names: list[str] | None = None) -> Column:
    """whether a folder on the way has an ignored name; of a folder its own name counts too."""
    parts = F.split(path, "/", -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    if is_dir is not None:
        folders = F.when(is_dir, parts).otherwise(folders)
    return F.exists(folders, lambda x: x.isin(names or IGNORED_DIRS))


def glob_regex(pattern: str) -> str:
    """a name pattern with *, ? and [..] as a Java regex over the whole name."""
    return r"\A" + fnmatch.translate(pattern).replace(r"\Z", r"\z")


def matches_any(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    return out
