"""The bank's functions for users of SQL, registered in a session by one call.

Scalar functions are bodies in SQL, so Catalyst sees through them and they stay in compiled code. Table functions that
need Python (chunkers) take a TABLE argument and hand its other columns on, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from patternmill.operators.scanners import attempt, chunks_of
from patternmill.schema import CHUNK, EXTENSIONS, MAX_LINES, MIN_LINES, OVERLAP_LINES, PREVIEW
from patternmill.session import ship


#: analyze runs where there is no session to parse types.
_KINDS = {"int": IntegerType(), "string": StringType()}


def _string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ENDINGS = " ".join(f"WHEN {_string(e)} THEN {_string(lang)}" for e, lang in EXTENSIONS.items())
#: name, parameters, type, body. Vectors may hold floats or doubles; sums are in order and in doubles, as in operators/search.
SCALARS = [
    ("pattern_id", "repo STRING, path STRING, content STRING", "STRING", "md5(concat(coalesce(repo, ''), ':', coalesce(path, ''), ':', substring(md5(coalesce(content, '')), 1, 8)))"),
    ("pattern_preview", "content STRING", "STRING", f"substring(content, 1, {PREVIEW})"),
    ("language_of", "path STRING", "STRING", f"CASE lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+([.][^.]+)$', 1)) {_ENDINGS} ELSE 'unknown' END"),
    ("estimated_tokens", "content STRING", "DOUBLE", "length(content) / 4"),
    ("vector_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("vector_norm", "a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    (
        "vector_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN vector_norm(a) * vector_norm(b) > 0 THEN vector_dot(a, b) / (vector_norm(a) * vector_norm(b)) ELSE 0D END",
    ),
    (
        "keyword_match", "content STRING, words ARRAY<STRING>", "DOUBLE",
        "CASE WHEN size(words) > 0 THEN least(1D, aggregate(words, 0D, (s, w) -> s + least(1D, 0.3D * ((length(lower(content)) - length(replace(lower(content), w, ''))) DIV length(w)))) / size(words)) ELSE 0D END",
    ),
]


def _passed_on(row: AnalyzeArgument, *taken: str) -> StructType:
    """The columns of a TABLE argument that a function hands on; raises if one it needs is not there."""
    if not row.isTable:
        raise ValueError("the first argument must be a TABLE")
    kind = row.dataType
    assert isinstance(kind, StructType)
    missing = [c for c in taken if c not in kind.fieldNames()]
    if missing:
        raise ValueError(f"the table must have columns {', '.join(missing)}")
    return kind


def _with(kind: StructType, dropped: list[str], ddl: str) -> StructType:
    own = [StructField(name, _KINDS[of]) for name, _, of in (part.strip().partition(" ") for part in ddl.split(","))]
    names = {f.name.lower() for f in own}
    return StructType([f for f in kind.fields if f.name not in dropped and f.name.lower() not in names] + own)


class ChunkFile:
    """chunk_file(TABLE(files)): the chunks of each row (file_path, language, content), with its other columns; error in place of chunks where a file fails."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_with(_passed_on(rows, "content", "file_path", "language"), ["content"], CHUNK + ", error string"))

    def eval(self, rows: Row) -> Iterator[tuple[Any, ...]]:
        own = {"chunk_no", "content", "start_line", "end_line", "chunk_type", "name", "context", "error"}
        kept = tuple(v for k, v in rows.asDict(False).items() if k.lower() not in own)
        found, error = attempt(chunks_of, (rows["content"], rows["file_path"] or "", rows["language"] or "unknown"), 1, 0.0)
        for number, c in enumerate(found):
            yield (*kept, number, *c, None)
        if error is not None:
            yield (*kept, *[None] * 7, error)


class LineWindows:
    """G9 at any size: line_windows(TABLE(texts), size => 150, overlap => 10): windows of the lines of content, with the other columns; windows of few lines that are not blank are left out."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        n, o = (size.value if size else MAX_LINES), (overlap.value if overlap else OVERLAP_LINES)
        if n is None or o is None or not 0 <= o < n:
            raise ValueError("size and overlap must be numbers, and overlap less than size")
        return AnalyzeResult(_with(_passed_on(rows, "content"), ["content"], "window_no int, content string, start_line int, end_line int"))

    def eval(self, rows: Row, size: int = MAX_LINES, overlap: int = OVERLAP_LINES) -> Iterator[tuple[Any, ...]]:
        own = {"window_no", "content", "start_line", "end_line"}
        kept = tuple(v for k, v in rows.asDict(False).items() if k.lower() not in own)
        if rows["content"] is None:
            return
        lines, number = rows["content"].split("\n"), 0
        starts = [0] if len(lines) <= size else range(0, len(lines) - overlap, size - overlap)
        for start in starts:
            held = lines[start : start + size]
            if sum(1 for x in held if x.strip()) >= MIN_LINES:
                yield (*kept, number, "\n".join(held), start + 1, start + len(held))
                number += 1


TABLES = {"chunk_file": ChunkFile, "line_windows": LineWindows}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session's SQL, in place of older ones of the same name; their names."""
    ship(spark)
    for name, args, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, made in TABLES.items():
        spark.udtf.register(name, udtf(made))
    return [*(s[0] for s in SCALARS), *TABLES]
