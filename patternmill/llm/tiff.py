"""TIFF: write samples to pages and read pages back.

The reader walks the chain of image directories in either byte order, decodes strips or tiles that are stored plainly
or packed with PackBits, LZW or deflate, undoes the horizontal and the floating-point predictor, and puts tiles and
planes together. `tiff_pages` emits one row per page.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.llm.common import slices, without

# Fixed values of the TIFF 6.0 format and its technical notes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
CLEAR, END, FIRST, FULL = 256, 257, 258, 4094

_SINGLE = [bytes([k]) for k in range(256)] + [b"", b""]
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


class BadTiff(ValueError):
    """The bytes are no TIFF that this reader can decode."""


def _widths(n: int) -> np.ndarray:
    """Bits of the k-th code after a clear code; the width grows one code early."""
    free = FIRST + np.arange(n)
    return 9 + (free > 511).astype(np.int64) + (free > 1023) + (free > 2047)


_WIDTHS = _widths(1 << 16)
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw_encode(data: bytes) -> bytes:
    codes: list[int] = []
    marks = [0]
    put = codes.append
    if data:
        table: dict[int, int] = {}
        get, free, prefix = table.get, FIRST, data[0]
        for byte in data[1:]:
            key = prefix << 8 | byte
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            table[key] = free
            free += 1
            prefix = byte
            if free == FULL:
                put(CLEAR)
                marks.append(len(codes))
                table.clear()
                free = FIRST
        put(prefix)
    put(END)
    values = np.array(codes, np.int64)
    marks.append(len(codes))
    widths = np.concatenate([_WIDTHS[: b - a] for a, b in zip(marks, marks[1:], strict=False)])
    values, widths = np.concatenate([[CLEAR], values]), np.concatenate([[9], widths])
    left = (values << (16 - widths)).astype(">u2").view(np.uint8).reshape(-1, 2)
    bits = np.unpackbits(left, axis=1)
    return np.packbits(bits[np.arange(16) < widths[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, out, have = len(data) * 8, 0, [], 0
    if total >= 9 and (raw[0] << 1 | raw[1] >> 7) == CLEAR:
        at = 9
    while have < size:
        n = min(int(np.searchsorted(_STARTS, total - at, "right")) - 1, len(_WIDTHS))
        if n <= 0:
            raise BadTiff("LZW data ends early")
        begin, width = at + _STARTS[:n], _WIDTHS[:n]
        byte = begin >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (begin & 7) - width) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        if stop:
            table, put = list(_SINGLE), out.append
            listed = codes[:stop].tolist()
            if listed[0] > 255:
                raise BadTiff("LZW code out of range")
            last = table[listed[0]]
            put(last)
            have += 1
            for code in listed[1:]:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise BadTiff("LZW code out of range")
                table.append(last + entry[:1])
                put(entry)
                have += len(entry)
                last = entry
        if stop == n or codes[stop] == END:
            break
        at += int(_STARTS[stop + 1])
    return b"".join(out)[:size]


def packbits_encode(data: bytes, row: int) -> bytes:
    out = bytearray()
    for start in range(0, len(data), row):
        line = data[start : start + row]
        at = 0
        for run in _RUN.finditer(line):
            _literals(out, line, at, run.start())
            at = run.end()
            out.append(257 - (at - run.start()))
            out += run[1]
        _literals(out, line, at, len(line))
    return bytes(out)


def _literals(out: bytearray, line: bytes, at: int, end: int) -> None:
    while at < end:
        upto = min(end, at + 128)
        out.append(upto - at - 1)
        out += line[at:upto]
        at = upto


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += head + 2
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data[:size]
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from e
    else:
        raise BadTiff(f"compression {compression} is not known")
    if len(out) != size:
        raise BadTiff(f"a strip or tile holds {len(out)} of {size} bytes")
    return out


def pack(data: bytes, compression: int, row: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return packbits_encode(data, row)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 6)
    raise ValueError(f"compression {compression} is not known")


def undo_predictor(data: bytes, predictor: int, width: int, samples: int, size: int, order: str) -> bytes:
    """data: rows of `width` pixels with `samples` samples of `size` bytes each."""
    if predictor == 1:
        return data
    if predictor == 2:
        if size not in (1, 2, 4):
            raise BadTiff(f"horizontal predictor on {size} bytes")
        rows = np.frombuffer(data, np.dtype(f"{order}u{size}")).reshape(-1, width, samples)
        return np.cumsum(rows, axis=1, dtype=np.dtype(f"u{size}")).astype(rows.dtype).tobytes()
    if predictor == 3:
        rows = np.frombuffer(data, np.uint8).reshape(-1, width * size, samples)
        planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(-1, size, width * samples)
        big = planes.transpose(0, 2, 1)
        return np.ascontiguousarray(big if order == ">" else big[:, :, ::-1]).tobytes()
    raise BadTiff(f"predictor {predictor} is not known")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    if at + 2 > len(data):
        raise BadTiff("a directory lies outside the file")
    (n,) = struct.unpack_from(f"{order}H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise BadTiff("a directory lies outside the file")
    fields: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        form = f"{order}{count}{TYPES[kind]}"
        size = struct.calcsize(form)
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(f"{order}I", data, where)
        if where + size > len(data):
            raise BadTiff(f"the values of tag {tag} lie outside the file")
        fields[tag] = list(struct.unpack_from(form, data, where))
    (after,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return fields, after


def read_pages(data: bytes) -> Iterator[dict]:
    """One dict per image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise BadTiff("the directories form a ring")
        seen.add(at)
        tags, after = _directory(data, at, order)
        yield _page(data, tags, order)
        at = after


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> dict:
    try:
        width, height = tags[WIDTH][0], tags[LENGTH][0]
    except (KeyError, IndexError):
        raise BadTiff("a page without width or length") from None
    one = lambda tag, default: (tags.get(tag) or [default])[0]
    samples, bits, compression, predictor = one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if bits not in (8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, [])):
        raise BadTiff(f"{bits} bits a sample")
    size, planes = bits // 8, samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    tiled = TILE_OFFSETS in tags
    wide, tall = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height) or height, height))
    offsets = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, [])
    counts = tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, [])
    if not width or not height:
        return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": compression, "predictor": predictor, "layout": "empty", "data": b""}
    if not wide or not tall:
        raise BadTiff("tiles without a size")
    across, down = -(-width // wide), -(-height // tall)
    if len(offsets) != across * down * planes or len(counts) != len(offsets):
        raise BadTiff("strips or tiles are missing")
    image = np.zeros((planes, height, width, each * size), np.uint8)
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(k, across * down)
        row, column = divmod(rest, across)
        rows = tall if tiled else min(tall, height - row * tall)
        if offset + count > len(data):
            raise BadTiff("a strip or tile lies outside the file")
        raw = unpack(data[offset : offset + count], compression, rows * wide * each * size)
        raw = undo_predictor(raw, predictor, wide, each, size, order)
        block = np.frombuffer(raw, np.uint8).reshape(rows, wide, each * size)
        top, left = row * tall, column * wide
        part = image[plane, top : top + rows, left : left + wide]
        part[:] = block[: part.shape[0], : part.shape[1]]
    if planes > 1:
        image = image.transpose(1, 2, 0, 3)
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": compression, "predictor": predictor, "layout": "tiles" if tiled else "strips", "data": image.tobytes()}


def write_tiff(payload: bytes, width: int = 64, rows: int = 1024, band: int = 64) -> bytes:
    """Store a payload of a whole number of rows as 8-bit pages of at most `rows` rows.

    Compression, predictor and layout go round with the page, from a start that depends on the payload alone.
    """
    if not payload or len(payload) % width:
        raise ValueError(f"the payload must fill rows of {width} samples")
    turn = zlib.crc32(payload)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page, start in enumerate(range(0, len(payload), width * rows)):
        data = payload[start : start + width * rows]
        height = len(data) // width
        compression = (PACKBITS, LZW, DEFLATE)[(turn + page) % 3]
        predictor = 2 if compression != PACKBITS and (turn >> 8) + page & 1 else 1
        tiled = (turn >> 16) + page & 1
        offsets, counts = [], []
        for top in range(0, len(data), width * band):
            block = data[top : top + width * band]
            if tiled:
                block = block.ljust(width * band, b"\0")
            if predictor == 2:
                lines = np.frombuffer(block, np.uint8).reshape(-1, width)
                block = np.diff(lines, axis=1, prepend=np.uint8(0)).tobytes()
            packed = pack(block, compression, width)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tiled:
            fields += [(TILE_WIDTH, 4, [width]), (TILE_LENGTH, 4, [band]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            fields += [(ROWS_PER_STRIP, 4, [band]), (STRIP_OFFSETS, 4, offsets), (STRIP_COUNTS, 4, counts)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            held = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(held) > 4:
                where = len(out)
                out += held
                held = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, kind, len(values)) + held.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_payload(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of `unit`, and the length before that."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\0"), len(raw)


def _others(df: DataFrame, without: str) -> list:
    return [f for f in df.schema.fields if f.name != without]


def _ddl(fields: list, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *more])


def _encoded(batches: Iterable[pa.RecordBatch], columns: list[str], text: str) -> Iterator[pa.RecordBatch]:
    """Batches with n_bytes and media in place of the text."""
    at, keep = columns.index(text), [k for k, c in enumerate(columns) if c != text]
    for piece in slices(batches, text, 2 << 20):
        made = [(n, write_tiff(payload)) for payload, n in map(text_payload, piece.column(at).to_pylist())]
        yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=[*(columns[k] for k in keep), "n_bytes", "media"])


def encode_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Put n_bytes and media (the TIFF of the padded UTF-8) in place of the text column and of columns of these names; a null text is empty."""
    df = without(df, "n_bytes", "media")
    columns = df.columns
    return df.mapInArrow(lambda batches: _encoded(batches, columns, text), _ddl(_others(df, text), "n_bytes long", "media binary"))


PAGE = {"page_no": pa.int32(), "width": pa.int32(), "height": pa.int32(), "bits": pa.int32(), "samples": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "layout": pa.string(), "data": pa.binary(), "error": pa.string()}
_PAGE_DDL = ["page_no int", "width int", "height int", "bits int", "samples int", "compression int", "predictor int", "layout string", "data binary", "error string"]


def _paged(batches: Iterable[pa.RecordBatch], columns: list[str], media: str) -> Iterator[pa.RecordBatch]:
    """Batches of pages in place of the media."""
    at, keep = columns.index(media), [k for k, c in enumerate(columns) if c != media]

    def out() -> pa.RecordBatch:
        own = [pa.array([p.get(c) for p in pages], t) for c, t in PAGE.items()]
        return pa.RecordBatch.from_arrays([*(piece.column(k).take(pa.array(rows)) for k in keep), *own], names=[*(columns[k] for k in keep), *PAGE])

    for piece in slices(batches, media, 2 << 20):
        rows, pages, held = [], [], 0
        for row, value in enumerate(piece.column(at)):
            number = 0
            try:
                for page in read_pages(value.as_py() or b""):
                    rows.append(row)
                    pages.append(page | {"page_no": number})
                    number += 1
                    held += len(page["data"])
                    if held > 2 << 20:
                        yield out()
                        rows, pages, held = [], [], 0
                if not number:
                    raise BadTiff("no page")
            except (BadTiff, struct.error) as e:
                rows.append(row)
                pages.append({"page_no": number, "error": str(e)})
        if rows:
            yield out()


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page, the pages of an image one after the other from page_no 0; no shuffle.

    The media column goes, the other columns stay on each page. Null media, or bytes that cannot be decoded, give one
    last row whose error says why and whose data is null; pages before it stay. A file without directories gives such
    a row too. Columns that have the names in PAGE already are replaced. A worker holds one image and about 2 MB of pages.
    """
    df = without(df, *(c for c in PAGE if c != media))
    columns = df.columns
    return df.mapInArrow(lambda batches: _paged(batches, columns, media), _ddl(_others(df, media), *_PAGE_DDL))


FOLDED = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail": pa.binary(), "feature": pa.string()}
_FOLDED_DDL = ["payload_bytes long", "payload_sha256 string", "tail binary", "feature string"]


def _folded(batches: Iterable[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each image from batches of (carry, page_no, width, height, data)."""
    state, first = None, None

    def close() -> pa.RecordBatch:
        n, digest, tail, count, width, height, total, steps, broken = state
        own = [None] * 4 if broken else [n, digest.hexdigest(), tail, f"pages={count} width={width} rows={height} mean={total / max(n, 1):.4f} steps={steps}"]
        return pa.RecordBatch.from_arrays([*first, *(pa.array([v], t) for v, t in zip(own, FOLDED.values(), strict=True))], names=[*carry, *FOLDED])

    for batch in batches:
        done = []
        number, width, height, data = (batch.column(len(carry) + k) for k in range(4))
        for row in range(batch.num_rows):
            if number[row].as_py() == 0:
                if state:
                    done.append(close())
                state, first = [0, hashlib.sha256(), b"", 0, 0, 0, 0, 0, False], [batch.column(k).slice(row, 1) for k in range(len(carry))]
            page = data[row].as_py()
            if page is None:
                state[8] = True
                continue
            values = np.frombuffer(page, np.uint8)
            state[0] += len(page)
            state[1].update(page)
            state[2] = (state[2] + page[-64:])[-64:]
            state[3] += 1
            state[4] = width[row].as_py()
            state[5] += height[row].as_py()
            state[6] += int(values.sum())
            state[7] += int(np.count_nonzero(values[1:] != values[:-1]))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if state:
        yield close()


def fold_pages(pages: DataFrame, carry: list[str]) -> DataFrame:
    """Digest the pages of each image: one row per image with the columns `carry`.

    Takes the rows as tiff_pages emits them (the pages of an image follow each other in one partition, page 0 first),
    so nothing is shuffled and one page is held at a time. An image with an error gets null digests.
    """
    source = pages.select(*carry, "page_no", "width", "height", "data")
    return source.mapInArrow(lambda batches: _folded(batches, carry), _ddl([pages.schema[c] for c in carry], *_FOLDED_DDL))


def text_media(docs: DataFrame) -> DataFrame:
    """Round trip of the whole texts of documents through TIFF, with digests of what was read back; all steps in one worker."""
    source = docs.select("doc_id", "text")
    carry = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for b in _encoded(batches, ["doc_id", "text"], "text"):
                media = b.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), b.column(2)], names=[*carry, "media"])

        pages = _paged(told(), [*carry, "media"], "media")
        yield from _folded((b.select([*carry, "page_no", "width", "height", "data"]) for b in pages), carry)

    ddl = _ddl([source.schema["doc_id"]], "n_bytes long", "media_bytes long", "media_sha256 string", *_FOLDED_DDL)
    return source.mapInArrow(run, ddl).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.crc32("tail").cast("long").alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
