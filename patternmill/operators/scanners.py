"""Chunks of source files by their blocks.

One scanner serves all languages; a dialect says which heads start a block, how a block ends, and what context its
chunks carry. The scanner runs in Arrow batches; everything around it is columns.
"""

from __future__ import annotations

import re
import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from patternmill.schema import CHUNK, MAX_LINES, MIN_LINES, OVERLAP_LINES

Ends = Callable[[int], int]


class Head(NamedTuple):
    pattern: re.Pattern[str]
    kind: str
    flush_left: bool = False  # only where the line at which the marks began is not indented


class Dialect(NamedTuple):
    heads: list[Head]
    ends: Callable[[list[str]], Ends]
    context: Callable[[list[str]], str]
    marks: bool  # lines that start with @ belong to the block below


class Chunk(NamedTuple):
    content: str
    start_line: int
    end_line: int
    chunk_type: str
    name: str | None
    context: str | None


def indent_ends(lines: list[str]) -> Ends:
    """The last line that is not blank before the next one indented as little as the head."""
    last, ends, before = -1, {}, []
    # Lines that still wait for one indented as little as they are, deeper ones on top.
    for k, x in enumerate(lines):
        if not (bare := x.strip()):
            continue
        depth = len(x) - len(x.lstrip()) if bare else 0
        while before and before[-1][1] >= depth:
            ends[before.pop()[0]] = last
        before.append((k, depth))
        last = k
    return lambda start: ends.get(start, max(last, start))


def brace_ends(lines: list[str]) -> Ends:
    """The first line at whose end all braces opened from the head on are closed; the last line if that never is."""
    opened = [0, *accumulate(x.count("{") for x in lines)]
    level = [0, *accumulate(x.count("{") - x.count("}") for x in lines)]

    at: dict[int, list[int]] = {}
    for k, depth in enumerate(level):
        at.setdefault(depth, []).append(k)

    def end(start: int) -> int:
        first = bisect_right(opened, opened[start])
        same = at[level[start]]
        k = bisect_left(same, first)
        return same[k] - 1 if k < len(same) else len(lines) - 1

    return end


def leading_imports(lines: list[str]) -> str:
    """Import lines up to the first other line after one of them; blank lines and comments do not count."""
    found: list[str] = []
    for x in lines:
        bare = x.strip()
        if bare.startswith(("import ", "from ")):
            found.append(x)
        elif found and bare and not bare.startswith(("#", "import", "from")):
            break
    return "\n".join(found)


def lines_starting(*starts: str) -> Callable[[list[str]], str]:
    return lambda lines: "\n".join(x for x in lines if x.strip().startswith(starts))


# The heads are fixed values: which lines start a block decides the chunks.
PYTHON = Dialect([Head(re.compile(r"^class\s+(\w+)"), "class"), Head(re.compile(r"^(?:async\s+)?def\s+(\w+)"), "function", True)], indent_ends, leading_imports, True)
JAVA = Dialect(
    [Head(re.compile(r"^(?:(?:public|private|protected)\s+)?(?:(?:abstract|final)\s+)?(?:class|interface|enum|record)\s+(\w+)"), "class")], brace_ends, lines_starting("package ", "import "), True
)
SCRIPT = Dialect(
    [
        Head(re.compile(r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), "class"),
        Head(re.compile(r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"), "function"),
        Head(re.compile(r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\("), "function"),
    ],
    brace_ends,
    lines_starting("import ", "require("),
    False,
)
DIALECTS = {"python": PYTHON, "java": JAVA, "javascript": SCRIPT, "typescript": SCRIPT}


def is_valid(lines: list[str]) -> bool:
    return sum(1 for x in lines if x.strip()) >= MIN_LINES


def blocks(lines: list[str], dialect: Dialect) -> Iterator[Chunk]:
    """The valid blocks; blocks that are too short are passed over whole."""
    end_of, context = dialect.ends(lines), dialect.context(lines)
    at = 0
    while at < len(lines):
        begin = at
        while dialect.marks and at < len(lines) and lines[at].strip().startswith("@"):
            at += 1
        bare = lines[at].strip() if at < len(lines) else ""
        indented = lines[begin].startswith((" ", "\t"))
        head = next(((h.kind, m[1]) for h in dialect.heads if not (h.flush_left and indented) and (m := h.pattern.match(bare))), None)
        if head is None:
            at += 1
            continue
        last = end_of(at)
        if is_valid(lines[begin : last + 1]):
            yield Chunk("\n".join(lines[begin : last + 1]), begin + 1, last + 1, *head, context)
        at = last + 1


def parts(lines: list[str], path: str) -> Iterator[Chunk]:
    """The whole file, or windows of lines that overlap; names count the valid windows."""
    name = path.rpartition("/")[2]
    stem = name.rpartition(".")[0] or name
    if len(lines) <= MAX_LINES:
        if is_valid(lines):
            yield Chunk("\n".join(lines), 1, len(lines), "file", stem, None)
        return
    step, number = MAX_LINES - OVERLAP_LINES, 0
    for start in range(0, len(lines) - OVERLAP_LINES, step):
        held = lines[start : start + MAX_LINES]
        if is_valid(held):
            number += 1
            yield Chunk("\n".join(held), start + 1, start + len(held), "file_part", f"{stem}_part{number}", None)


def chunks_of(content: str | None, path: str, language: str) -> list[Chunk]:
    """G1: blocks where the language has a dialect, else, or if there is none, the file in parts."""
    lines = (content or "").split("\n")
    found = list(blocks(lines, DIALECTS[language])) if language in DIALECTS else []
    return found or list(parts(lines, path))


Chunker = Callable[[str | None, str, str], Iterable[Chunk]]


def extract_chunks(files: DataFrame, content: str = "content", path: str = "file_path", language: str = "language") -> DataFrame:
    """The chunks of each file in place of its content, numbered from 0; the other columns stay on each chunk. No shuffle."""
    return extracted(files, content, path, language).drop("error")


def attempt(chunker: Chunker, args: tuple[str | None, str, str], retries: int, delay: float) -> tuple[list[Chunk], str | None]:
    """T5: the chunks of a file, or what went wrong at the last of `retries` attempts."""
    for k in range(max(1, retries)):
        try:
            return list(chunker(*args)), None
        except Exception as e:  # noqa: BLE001  one file must not end the task
            if k + 1 >= retries:
                return [], f"{type(e).__name__}: {e}"
            time.sleep(delay)
    return [], None


def extracted(files: DataFrame, content: str = "content", path: str = "file_path", language: str = "language", chunker: Chunker | None = None, retries: int = 1, delay: float = 1.0) -> DataFrame:
    """extract_chunks with a chunker of one's own, and a column error.

    A file whose chunker fails `retries` times, `delay` seconds apart, gives one row with the error and no chunk; the
    others go on.
    """
    keep = [c for c in files.columns if c != content]
    at = {c: k for k, c in enumerate(files.columns)}
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != content), CHUNK, "error string"])
    own = {"chunk_no": pa.int32(), "content": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "chunk_type": pa.string(), "name": pa.string(), "context": pa.string(), "error": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                rows, made = [], []
                told = zip(*(piece.column(at[c]).to_pylist() for c in (content, path, language)), strict=True)
                for row, (text, where, kind) in enumerate(told):
                    chunks, error = attempt(chunker or chunks_of, (text, where or "", kind or "unknown"), retries, delay)
                    for number, c in enumerate(chunks):
                        rows.append(row)
                        made.append((number, *c, None))
                    if error is not None:
                        rows.append(row)
                        made.append((None,) * 7 + (error,))
                taken = [piece.column(at[c]).take(pa.array(rows, pa.int32())) for c in keep]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array([m[k] for m in made], t) for k, t in enumerate(own.values()))], names=[*keep, *own])

    return files.mapInArrow(run, ddl)
