"""Text functions on columns: cleaning, tokens, keyword counts, windows of characters and lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.schema import MIN_LINES, STOP_WORDS

#: Not blank: as Unicode white space and U+001C to U+001F count as blank.
NON_BLANK = r"(?U)[^\s\x1c-\x1f]"
TOKEN_RUN = r"[\p{L}\p{N}_]+"
TOKEN_GAP = r"[^\p{L}\p{N}_]+"
TOKEN = r"^[a-zA-Z_][a-zA-Z0-9_]*$"


def lines(c: Column) -> Column:
    """Split at line feeds; a trailing empty line stays."""
    return F.split(c, "\n", -1)


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces become one space, indentation too; tabs stay."""
    return F.regexp_replace(c, " +", " ")


def unix_newlines(c: Column) -> Column:
    """X2."""
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def drop_blank_lines(c: Column) -> Column:
    """X3."""
    return F.array_join(F.filter(lines(c), lambda x: x.rlike(NON_BLANK)), "\n")


def strip_comments(c: Column) -> Column:
    """From // or # to the end of the line, wherever they stand, then /* ... */."""
    for pattern in (r"(?md)//.*?$", r"(?md)#.*?$", r"(?s)/\*.*?\*/"):
        c = F.regexp_replace(c, pattern, "")
    return c


def strip_docstrings(c: Column) -> Column:
    """X5."""
    return F.regexp_replace(F.regexp_replace(c, r'(?s)""".*?"""', ""), r"(?s)'''.*?'''", "")


def preprocess(c: Column, whitespace: bool = True, blank_lines: bool = False, comments: bool = False, docstrings: bool = False) -> Column:
    """The steps asked for, in a fixed order; null and empty texts stay as they are."""
    if whitespace:
        c = unix_newlines(collapse_spaces(c))
    if blank_lines:
        c = drop_blank_lines(c)
    if comments:
        c = strip_comments(c)
    if docstrings:
        c = strip_docstrings(c)
    return c


def is_valid_chunk(c: Column) -> Column:
    """at least five lines that are not blank."""
    return F.size(F.filter(lines(c), lambda x: x.rlike(NON_BLANK))) >= MIN_LINES


def should_chunk(c: Column, max_tokens: int = 512, enabled: bool = True) -> Column:
    """a token is taken for four characters."""
    return F.lit(enabled) & (F.length(c) / 4.0 > max_tokens)


def tokens(c: Column) -> Column:
    """Lower-case identifiers; runs of Unicode word characters that are ASCII identifiers."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RUN), F.lit(0)), lambda t: t.rlike(TOKEN))


def top_keywords(df: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """F17, X10 for a table: (key, rank, keyword, hits) of the tokens of over two characters that are no stop words, most frequent first, ties by first occurrence.

    Columns cut the text; words are counted row by row in Arrow batches, so nothing is shuffled.
    """
    is_name, stops = re.compile(TOKEN).match, frozenset(STOP_WORDS)
    told = df.select(key, F.regexp_replace(F.lower(text), TOKEN_GAP, " ").alias("words"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple[int, str, int]] = []
            for row, words in enumerate(batch.column(1).to_pylist()):
                # A counter holds words in the order of their first occurrence, and sorting keeps it.
                counts = Counter(words.split(" ")) if words else {}
                found = [t for t in counts if len(t) > 2 and t not in stops and is_name(t)]
                for rank, t in enumerate(sorted(found, key=counts.__getitem__, reverse=True)[:n]):
                    at.append(row)
                    rows.append((rank + 1, t, counts[t]))
            kept = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept, *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64())))], names=[key, "rank", "keyword", "hits"])

    return told.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, rank int, keyword string, hits long")


def occurrences(text: Column, word: Column) -> Column:
    """X11: how often word stands in text without overlap; an empty word nowhere."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")).otherwise(0)


def keyword_score(lowered: Column, keywords: Column) -> Column:
    """The mean over the keywords of 0.3 a hit, at most 1 each and in all; 0 without keywords. Folds in order."""
    zero, one = F.lit(0.0), F.lit(1.0)
    total = F.aggregate(keywords, zero, lambda a, k: a + F.least(one, occurrences(lowered, k) * F.lit(0.3)))
    return F.when(F.size(keywords) > 0, F.least(one, total / F.size(keywords))).otherwise(zero)


def char_windows(c: Column, max_tokens: int = 512, overlap: int = 50) -> Column:
    """Array of (chunk_index, total_chunks, start_char, end_char, text); one chunk where F12 says no.

    end_char is not cut at the end of the text, and the last window may be overlap alone.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be less than the window")
    size, step = 4 * max_tokens, 4 * (max_tokens - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(step))
    cut = F.transform(
        starts,
        lambda s, i: F.struct(i.alias("chunk_index"), F.size(starts).alias("total_chunks"), s.alias("start_char"), (s + size).alias("end_char"), F.substring(c, s + 1, F.lit(size)).alias("text")),
    )
    whole = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit(0).alias("start_char"), F.length(c).alias("end_char"), c.alias("text")))
    return F.when(should_chunk(c, max_tokens), cut).otherwise(whole)


def packed_lines(c: Column, max_tokens: int = 512, overlap: int = 50) -> Column:
    """Array of texts. Lines fill a chunk up to max_tokens (four characters a token, line ends free); the last
    max(1, overlap // 20) lines go over to the next; a line that is too long stays whole.
    """
    keep = max(1, overlap // 20)
    size = lambda x: F.length(x) / F.lit(4.0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + size(x))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("held"), F.lit(0.0).alias("size"))

    def step(a: Column, x: Column) -> Column:
        full = (a["size"] + size(x) > max_tokens) & (F.size(a["held"]) > 0)
        tail = F.slice(a["held"], F.greatest(F.size(a["held"]) - (keep - 1), F.lit(1)), F.lit(keep))
        flushed = F.struct(F.concat(a["done"], F.array(F.array_join(a["held"], "\n"))).alias("done"), F.concat(tail, F.array(x)).alias("held"), (total(tail) + size(x)).alias("size"))
        added = F.struct(a["done"].alias("done"), F.concat(a["held"], F.array(x)).alias("held"), (a["size"] + size(x)).alias("size"))
        return F.when(full, flushed).otherwise(added)

    packed = F.aggregate(lines(c), start, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(F.array_join(a["held"], "\n")))).otherwise(a["done"]))
    return F.when(should_chunk(c, max_tokens), packed).otherwise(F.array(c))
