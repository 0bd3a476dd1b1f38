"""Remove every byte that a string of a given length covers which also starts anywhere else.

Equal strings of the length hold the same anchor at the same offset (see anchors), so all that matters is decided
among the places with one anchor. Anchors that occur once go. Equal contexts of an anchor cover each other whole.
Where contexts of an anchor differ, the strings about it fall into ranges of neighbouring offsets; all strings of a
range hold a common core, and a piece is a core with the bytes about it that the range can reach. Pieces with the
same core go to one task, which writes the core as one symbol and builds the suffix array of the pieces by linear
grouping construction; two strings are equal where neighbours in the array share the core and the bytes about it.
Of a core that has very many pieces, alike ones go on as one. If too many kinds are left they are dealt anew by the half
of the bytes next to the core that each string must hold: these become part of a longer core, and so on until a core
is the whole string, of which there is one kind. So no task grows with a core.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.llm.anchors import GRAM, MOST_PART, PART, anchors, byte_hashes
from patternmill.llm.common import slices
from patternmill.llm.grouping import suffix_array
from patternmill.session import forget, stored

#: Strings in a range, and the pieces of one core that a task takes at most.
RANGE, CORE_PIECES = 35, 4_000
#: Symbols of one suffix array, about; cores are not cut.
ARRAY_SYMBOLS = 150_000
PIECE = ["gram", "core", "piece", "doc", "mark", "start", "single", "left", "right"]
KIND = ["gram", "core", "piece", "n", "single", "left", "right"]


def offset_ranges(length: int, gram: int, width: int) -> list[tuple[int, int]]:
    """Ranges [low, high] of the anchor's offset in a string; all hold `width` offsets, the last may overlap."""
    last = length - gram
    width = min(width, last + 1)
    return [(low := min(k, last + 1 - width), low + width - 1) for k in range(0, last + 1, width)]


def anchor_rows(docs: DataFrame, length: int, gram: int, part: int = PART) -> DataFrame:
    """Rows (doc, mark, spot, gram, context): spot is packed: place, bytes of the context before it and from it on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 2 << 20):
            ids, marks = (piece.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = [(t or "").encode() for t in piece.column(2).to_pylist()]
            # A text of over `part` bytes goes in parts that overlap by twice the length; each place belongs to one of
            # them, in which all strings about it lie whole.
            parts, owner, base, owned = [], [], [], []
            for k, t in enumerate(texts):
                ends = range(part, len(t), part - 2 * length) if len(t) > part else ()
                begins = [0, *(e - 2 * length for e in ends)]
                for begin in begins:
                    parts.append(t[begin : begin + part])
                    owner.append(k)
                    base.append(begin)
                    owned.append((length if begin else 0, part - length if begin + part < len(t) else part))
            for group in _groups(parts, part):
                number, place, low, high, key, context = anchors(parts[group], length, gram)
                bounds = np.array(owned[group])[number].reshape(-1, 2)
                mine = (place >= bounds[:, 0]) & (place < bounds[:, 1])
                number, place, low, high, key, context = (x[mine] for x in (number, place, low, high, key, context))
                if not len(number):
                    continue
                at = np.array(owner[group])[number]
                spot = ((place + np.array(base[group])[number]) << 30) | ((place - low) << 15) | (high - place)
                columns = (ids[at], marks[at], spot, key.view(np.int64), context.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "mark", "spot", "gram", "context"])

    return docs.select("doc", "mark", "text").mapInArrow(run, "doc long, mark long, spot long, gram long, context long")


def _groups(parts: list[bytes], limit: int) -> Iterator[slice]:
    start, held = 0, 0
    for k, p in enumerate(parts):
        if k > start and held + len(p) > limit:
            yield slice(start, k)
            start, held = k, 0
        held += len(p)
    if start < len(parts):
        yield slice(start, len(parts))


def piece_rows(docs: DataFrame, needed: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Rows (gram, core, piece, doc, mark, start, single, left, right): the pieces of the needed contexts of each document.

    gram and core together name the bytes of the core. A document's spots come as one list, which is never longer than
    its text.
    """
    ranges = offset_ranges(length, gram, width)
    told = needed.groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("spot", "gram", "single")).alias("spots"))
    held = docs.join(told, (F.col("doc") == F.col("__doc")) & (F.col("mark") == F.col("__mark")))
    types = [pa.int64()] * 6 + [pa.bool_(), pa.binary(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            out: list[list] = [[] for _ in types]
            for row in range(batch.num_rows):
                doc, mark = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                text = batch.column(2)[row].as_py().encode()
                told = batch.column(3)[row].values
                spots, grams, single = (told.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                place = spots >> 30
                low, high = place - (spots >> 15 & 0x7FFF), place + (spots & 0x7FFF)
                for r, (near, far) in enumerate(ranges):
                    first, last = np.maximum(place - far, low), np.minimum(place - near, high - length)
                    ok = np.flatnonzero(first <= last)
                    if not len(ok):
                        continue
                    begin, end = place[ok] - near, place[ok] - far + length
                    first, stop = first[ok], last[ok] + length
                    whole = byte_hashes(text, first, stop) ^ ((begin - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (stop - end).astype(np.uint64)
                    made = (
                        grams[ok].tolist(), byte_hashes(text, begin, end, 1 + r).view(np.int64).tolist(), whole.view(np.int64).tolist(), [doc] * len(ok), [mark] * len(ok), first.tolist(), single[ok].tolist(),
                        [text[a:b] for a, b in zip(first.tolist(), begin.tolist(), strict=True)], [text[a:b] for a, b in zip(end.tolist(), stop.tolist(), strict=True)],
                    )
                    for column, values in zip(out, made, strict=True):
                        column += values
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=PIECE)

    return held.select("doc", "mark", "text", "spots").mapInArrow(run, "gram long, core long, piece long, doc long, mark long, start long, single boolean, left binary, right binary")


def repeated_starts(pieces: list[tuple[bytes, int, bytes]], width: int) -> list[list[int]]:
    """For pieces (left, core number, right): the offsets into left at which a string starts that another piece holds too.

    A string is `width` symbols long, the core being one of them.
    """
    symbols: list[int] = []
    begins, owners = [], []
    for number, (left, core, right) in enumerate(pieces):
        at = len(symbols)
        for k in range(max(0, len(left) + 1 + len(right) - width + 1)):
            begins.append(at + k)
            owners.append(number)
        symbols += [b + 2 for b in left]
        symbols.append(258 + core)
        symbols += [b + 2 for b in right]
        symbols.append(1)
    symbols.append(0)
    out: list[list[int]] = [[] for _ in pieces]
    if not begins:
        return out
    owner = np.full(len(symbols), -1, np.int64)
    owner[begins] = owners
    order = np.array(suffix_array(symbols))
    order = order[owner[order] >= 0]
    values = np.array(symbols)
    windows = np.lib.stride_tricks.sliding_window_view(values, width)[order]
    same = (windows[1:] == windows[:-1]).all(axis=1)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    starts = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(a) + len(b) + 2 for a, _, b in pieces], out=starts[1:])
    for at in np.sort(order[hit]).tolist():
        out[owner[at]].append(at - int(starts[owner[at]]))
    return out


def longest_shared(strings: list[bytes]) -> list[int]:
    """For each string the length of the longest prefix that another one has too."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    best = [0] * len(strings)
    for a, b in zip(order, order[1:], strict=False):
        one, two = strings[a], strings[b]
        n = min(len(one), len(two))
        if one[:n] != two[:n]:
            n = next(k for k in range(n) if one[k] != two[k])
        best[a], best[b] = max(best[a], n), n
    return best


def comparable(pieces: list[tuple[bytes, bytes]], width: int) -> list[tuple[int, bytes, bytes]]:
    """(number, left, right) of the pieces of one core that may share a string with another, cut to what they may share.

    On each side no piece shares more with another than with its neighbours in order.
    """
    lefts, rights = longest_shared([a[::-1] for a, _ in pieces]), longest_shared([b for _, b in pieces])
    return [(k, left[len(left) - m :], right[:n]) for k, ((left, right), m, n) in enumerate(zip(pieces, lefts, rights, strict=True)) if m + n >= width - 1]


Core = tuple[int, int]


def shared_parts(held: dict[Core, dict[int, tuple[bytes, bytes]]], copies: dict[tuple[Core, int], int], wanted: Iterable[tuple[Core, int]], length: int, width: int) -> dict[tuple[Core, int], list[tuple[int, int]]]:
    """For each wanted piece the parts (low, high), from its first byte, that strings cover which another piece, or a copy, has too."""
    names, texts = [], []
    for number, (core, own) in enumerate(held.items()):
        keys = list(own)
        for k, left, right in comparable(list(own.values()), width) if len(own) > 1 else ():
            names.append((core, keys[k]))
            texts.append((left, number, right))
    starts = repeated_starts(texts, width)
    found = {name: [k + len(held[name[0]][name[1]][0]) - len(text[0]) for k in own] for name, text, own in zip(names, texts, starts, strict=True)}
    out: dict[tuple[Core, int], list[tuple[int, int]]] = {}
    for name in wanted:
        if copies[name] > 1:
            left, right = held[name[0]][name[1]]
            out[name] = [(0, len(left) + len(right) + length - (width - 1))]
            continue
        parts: list[tuple[int, int]] = []
        for k in found.get(name, ()):
            if parts and k + length - 1 == parts[-1][1]:
                parts[-1] = (parts[-1][0], k + length)
            else:
                parts.append((k, k + length))
        out[name] = parts
    return out


def compared_pieces(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """Intervals (doc, mark, low, high) of the single pieces that others hold too; rows with one core are in one task."""
    dealt = pieces.repartition("gram", "core").sortWithinPartitions("gram", "core")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Core, dict[int, tuple[bytes, bytes]]] = {}
        single: list[tuple[Core, int, int, int, int]] = []
        copies: dict[tuple[Core, int], int] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            parts = shared_parts(held, copies, {(core, piece) for core, piece, *_ in single}, length, width)
            rows = [(doc, mark, start + low, start + high) for core, piece, doc, mark, start in single for low, high in parts[core, piece]]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc", "mark", "low", "high"])

        for batch in batches:
            for gram, number, piece, doc, mark, start, alone, left, right in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                core = (gram, number)
                if core != last and size > ARRAY_SYMBOLS:
                    yield flush()
                    held, single, copies, size = {}, [], {}, 0
                last = core
                own = held.setdefault(core, {})
                if piece not in own:
                    own[piece] = (left, right)
                    size += len(left) + len(right) + 2
                copies[core, piece] = copies.get((core, piece), 0) + 1
                if alone:
                    single.append((core, piece, doc, mark, start))
        if single:
            yield flush()

    return dealt.select(*PIECE).mapInArrow(run, "doc long, mark long, low long, high long")


def compared_kinds(kinds: DataFrame, length: int, width: int) -> DataFrame:
    """The same for pieces without their places (KIND): (gram, core, piece, low, high), from the first byte of the piece."""
    dealt = kinds.repartition("gram", "core").sortWithinPartitions("gram", "core")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Core, dict[int, tuple[bytes, bytes]]] = {}
        copies: dict[tuple[Core, int], int] = {}
        wanted: list[tuple[Core, int]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            parts = shared_parts(held, copies, wanted, length, width)
            rows = [(*core, piece, low, high) for (core, piece), own in parts.items() for low, high in own]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["gram", "core", "piece", "low", "high"])

        for batch in batches:
            for gram, number, piece, n, single, left, right in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                core = (gram, number)
                if core != last and size > ARRAY_SYMBOLS:
                    yield flush()
                    held, copies, wanted, size = {}, {}, [], 0
                last = core
                held.setdefault(core, {})[piece] = (left, right)
                copies[core, piece] = n
                size += len(left) + len(right) + 2
                if single:
                    wanted.append((core, piece))
        if wanted:
            yield flush()

    return dealt.select(*KIND).mapInArrow(run, "gram long, core long, piece long, low long, high long")


def longer_cores(kinds: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The pieces with longer cores, each with the core, piece and place (of, part, shift) it is cut from, and how many symbols their strings have.

    A string holds width - 1 bytes about its core, so half of that to one side at least. A piece goes on with that half
    to its left as part of the core, and with that to its right, as far as it has them.
    """
    about = width - 1
    half = (about + 1) // 2
    rest = about - half
    part = lambda c, at, n: F.expr(f"substring({c}, {at}, {n})")
    last = lambda c, n: part(c, f"greatest(octet_length({c}) - {n}, 0) + 1", n)
    kept = ["gram", F.col("core").alias("of"), F.col("piece").alias("part"), "n", "single"]
    one = kinds.where(F.octet_length("left") >= half).select(
        *kept, F.xxhash64("core", F.lit("left"), last("left", half)).alias("core"), part("left", 1, f"octet_length(left) - {half}").alias("left"), part("right", 1, rest).alias("right")
    )
    two = kinds.where(F.octet_length("right") >= half).select(*kept, F.xxhash64("core", F.lit("right"), part("right", 1, half)).alias("core"), "left", part("right", half + 1, rest).alias("right"))
    both = one.unionByName(two).withColumn("shift", F.greatest(F.octet_length("left") - rest, F.lit(0))).withColumn("left", last("left", rest))
    both = both.where(F.octet_length("left") + F.octet_length("right") >= rest)
    return both.withColumn("piece", F.xxhash64("core", "left", "right")), rest + 1


def kinds_of(pieces: DataFrame, n: Column) -> DataFrame:
    """The different pieces of each core, with how many there are of each, and whether one of them is single."""
    return pieces.groupBy("gram", "core", "piece").agg(F.sum(n).alias("n"), F.max("single").alias("single"), F.first("left").alias("left"), F.first("right").alias("right")).select(*KIND)


def repeated_kinds(kinds: DataFrame, length: int, width: int, core_pieces: int) -> DataFrame:
    """Stored parts (gram, core, piece, low, high) of the single pieces that others hold too, whatever the number of pieces of a core. Forgets kinds.

    Where a core is the whole string it has one kind of piece, so this ends.
    """
    cores = stored(kinds.groupBy("gram", "core").agg(F.sum("n").alias("__n"), F.max("single").alias("__any"), (F.count("*") > core_pieces).alias("many")).where("__n > 1 AND __any").select("gram", "core", "many"), "cores")
    shared = stored(kinds.join(cores, ["gram", "core"]), "kinds-shared")
    forget(kinds, cores)
    found = stored(compared_kinds(shared.where("NOT many"), length, width), "found")
    many = shared.where("many").drop("many")
    if many.limit(1).count():
        rows, longer = longer_cores(many, width)
        rows = stored(rows, "kinds-cut")
        deeper = repeated_kinds(stored(kinds_of(rows, F.col("n")), "kinds"), length, longer, core_pieces)
        back = deeper.join(rows.select("gram", "core", "piece", "of", "part", "shift"), ["gram", "core", "piece"])
        back = back.select("gram", F.col("of").alias("core"), F.col("part").alias("piece"), (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high"))
        every = stored(found.unionByName(back).distinct(), "found")
        forget(found, rows, deeper)
        found = every
    forget(shared)
    return found


def repeated_pieces(pieces: DataFrame, length: int, width: int, core_pieces: int) -> list[DataFrame]:
    """Stored intervals (doc, mark, low, high) of the single pieces that others hold too. Forgets the pieces."""
    cores = pieces.groupBy("gram", "core").agg(F.count("*").alias("n"), F.max("single").alias("any")).where("n > 1 AND any")
    cores = stored(cores.select("gram", "core", (F.col("n") > core_pieces).alias("many")), "cores")
    shared = stored(pieces.join(cores, ["gram", "core"]), "pieces-shared")
    forget(pieces, cores)
    out = [stored(compared_pieces(shared.where("NOT many"), length, width).distinct(), "found")]
    many = shared.where("many").drop("many")
    if many.limit(1).count():
        # Pieces that are alike go on as one, and what is found in them comes back to all their places.
        found = repeated_kinds(stored(kinds_of(many, F.lit(1)), "kinds"), length, width, core_pieces)
        placed = many.where("single").join(found, ["gram", "core", "piece"])
        out.append(stored(placed.select("doc", "mark", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).distinct(), "found"))
        forget(found)
    forget(shared)
    return out


def repeated_intervals(docs: DataFrame, length: int, gram: int = GRAM, width: int = RANGE, core_pieces: int = CORE_PIECES, part: int = PART) -> DataFrame:
    """Stored rows (doc, mark, found): the intervals (low, high) of bytes that repeated strings cover, sorted; docs: (doc, mark, text)."""
    width = min(width, length - gram + 1)
    rows = stored(anchor_rows(docs, length, gram, part), "anchors")
    twice = stored(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "anchors-twice")
    some = stored(rows.join(twice, "gram"), "anchors-shared")
    forget(rows, twice)
    contexts = some.groupBy("gram", "context").agg(F.count("*").alias("n"), F.first("doc").alias("doc"), F.first("mark").alias("mark"), F.first("spot").alias("spot"))
    contexts = stored(contexts, "contexts")
    place, bits = F.shiftright("spot", 30), F.lit(0x7FFF)
    reach = [(place - F.shiftright("spot", 15).bitwiseAND(bits)).alias("low"), (place + F.col("spot").bitwiseAND(bits)).alias("high")]
    whole = stored(some.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"]).select("doc", "mark", *reach).distinct(), "covered")
    mixed = stored(contexts.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("gram"), "mixed")
    needed = stored(contexts.join(mixed, "gram").select("doc", "mark", "spot", "gram", (F.col("n") == 1).alias("single")), "needed")
    forget(some, contexts, mixed)
    pieces = stored(piece_rows(docs, needed, length, gram, width), "pieces")
    forget(needed)
    found = [whole, *repeated_pieces(pieces, length, width, core_pieces)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    per_doc = stored(every.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("found")), "intervals")
    forget(*found)
    return per_doc


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = GRAM, width: int = RANGE, core_pieces: int = CORE_PIECES, part: int = PART) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept) of each row: removed runs as [low, high) in bytes, and the bytes that stay.

    Texts are UTF-8; a null text is empty. Texts shorter than `length` lose nothing. Strings are judged on the input.
    Repeated rows count as repeats: each loses what they share. The key may be of any type that Spark can hash; a null
    key is a key, and a key with several texts is told apart by them, as rows go by 64-bit hashes of key and of text.
    kept is binary, as a run may begin or end within a character. `part` bytes of a text are looked at together;
    ValueError where it, or another parameter, is not of use.
    """
    if not 0 < gram <= length < 1 << 15:
        raise ValueError("0 < gram <= length < 32768 is needed")
    if not 2 * length < part <= MOST_PART:
        raise ValueError(f"2 * length < part <= {MOST_PART} is needed")
    if width < 1 or core_pieces < 1:
        raise ValueError("width and core_pieces must be 1 or more")
    t = F.coalesce(F.col(text), F.lit(""))
    told = docs.select(F.col(key).alias("__key"), F.xxhash64(F.col(key)).alias("doc"), F.xxhash64(t).alias("mark"), t.alias("text"))
    per_doc = repeated_intervals(told.select("doc", "mark", "text"), length, gram, width, core_pieces, part).withColumnsRenamed({"doc": "__doc", "mark": "__mark"})
    joined = told.join(per_doc, (F.col("doc") == F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left").select("__key", "text", "found")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 2 << 20):
            sizes, removed, spans, kept = [], [], [], []
            for raw, found in zip((s.encode() for s in piece.column(1).to_pylist()), piece.column(2), strict=True):
                runs: list[dict] = []
                if found.is_valid:
                    for low, high in zip(found.values.field(0).to_pylist(), found.values.field(1).to_pylist(), strict=True):
                        if runs and low <= runs[-1]["high"]:
                            runs[-1]["high"] = max(runs[-1]["high"], high)
                        else:
                            runs.append({"low": low, "high": high})
                at, rest = 0, []
                for r in runs:
                    rest.append(raw[at : r["low"]])
                    at = r["high"]
                rest.append(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(r["high"] - r["low"] for r in runs))
                spans.append(runs)
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["__key", "n_bytes", "n_removed", "spans", "kept"],
            )

    out = joined.mapInArrow(run, f"__key {kind}, n_bytes long, n_removed long, spans array<struct<low: long, high: long>>, kept binary")
    return out.withColumnRenamed("__key", key)


#: The same in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT rid, b, substr(h, 2 * b + 1, 2398) AS s FROM (SELECT rid, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT), 1000)) AS b FROM d)),
strings AS (SELECT rid, b + i AS pos, md5_number(substr(s, 2 * i + 1, 400)) AS k FROM (SELECT rid, b, s, unnest(range(0, least(1000, CAST(length(s) // 2 AS BIGINT) - 199))) AS i FROM blocks)),
starts AS (SELECT rid, pos FROM strings SEMI JOIN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1) USING (k)),
gaps AS (SELECT rid, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY rid ORDER BY pos) + 200 THEN 0 ELSE 1 END AS opens FROM starts),
runs AS (SELECT rid, min(pos) AS low, max(pos) + 200 AS high FROM (SELECT rid, pos, sum(opens) OVER (PARTITION BY rid ORDER BY pos) AS run FROM gaps) GROUP BY rid, run),
ends AS (SELECT rid, low, high, coalesce(lag(high) OVER (PARTITION BY rid ORDER BY low), 0) AS upto FROM runs),
cut AS (
  SELECT d.rid, CAST(count(low) AS BIGINT) AS n_spans, CAST(coalesce(sum(high - low), 0) AS BIGINT) AS n_removed,
    coalesce(string_agg(substr(h, 2 * upto + 1, 2 * (low - upto)), '' ORDER BY low), '') AS kept, coalesce(max(high), 0) AS last
  FROM d LEFT JOIN ends ON d.rid = ends.rid GROUP BY d.rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, n_removed, n_spans, sha256(unhex(concat(kept, substr(h, 2 * last + 1)))) AS kept_sha256 FROM d JOIN cut ON d.rid = cut.rid
"""
