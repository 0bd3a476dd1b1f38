from __future__ import annotations

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patternmill.llm import tiff


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600))
def test_packings_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data, 64), len(data)) == data
    if data:
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("n", [1, 5_000, 200_000])
def test_lzw_resets_its_table(n):
    for data in (os.urandom(n), b"a" * n, bytes(random.Random(1).choice(b"ab ") for _ in range(n))):
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


def page(order, tags, blocks):
    """A TIFF of one page; blocks are put where the offsets point."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    offsets = []
    for b in blocks:
        offsets.append(len(out))
        out += b
    tags = {k: offsets if v == "offsets" else [len(b) for b in blocks] if v == "counts" else v for k, v in tags.items()}
    entries = b""
    for tag, values in sorted(tags.items()):
        held = struct.pack(f"{order}{len(values)}I", *values)
        if len(held) > 4:
            at = len(out)
            out += held
            held = struct.pack(f"{order}I", at)
        entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + held
    struct.pack_into(f"{order}I", out, 4, len(out))
    return bytes(out + struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 32946])
def test_tiles_with_planes_and_predictor(order, compression):
    """16-bit, three planes, 20 x 10 pixels in tiles of 16 x 16."""
    image = np.arange(3 * 10 * 20, dtype=np.uint16).reshape(3, 10, 20) * 77
    blocks = []
    for plane in image:
        for left in (0, 16):
            tile = np.zeros((16, 16), np.uint16)
            part = plane[:, left : left + 16]
            tile[:10, : part.shape[1]] = part
            raw = np.diff(tile, axis=1, prepend=np.uint16(0)).astype(f"{order}u2").tobytes()
            blocks.append(tiff.pack(raw, compression, 32))
    tags = {256: [20], 257: [10], 258: [16, 16, 16], 259: [compression], 277: [3], 284: [2], 317: [2], 322: [16], 323: [16], 324: "offsets", 325: "counts"}
    (got,) = tiff.read_pages(page(order, tags, blocks))
    assert np.array_equal(np.frombuffer(got["data"], f"{order}u2").reshape(10, 20, 3), image.transpose(1, 2, 0))


@pytest.mark.parametrize("order", ["<", ">"])
def test_floating_point_predictor(order):
    values = np.linspace(-3, 9, 40).astype(f"{order}f4").reshape(5, 8)
    big = values.astype(">f4").view(np.uint8).reshape(5, 8, 4).transpose(0, 2, 1).reshape(5, 32)
    raw = np.diff(big, axis=1, prepend=np.uint8(0)).tobytes()
    (got,) = tiff.read_pages(page(order, {256: [8], 257: [5], 258: [32], 259: [8], 277: [1], 278: [5], 317: [3], 273: "offsets", 279: "counts"}, [zlib.compress(raw)]))
    assert got["data"] == values.tobytes()


def test_broken_files_give_error_rows(llm):
    good = tiff.write_tiff(b"x" * 128)
    ring = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    struct.pack_into("<I", ring, at + 2 + 12 * struct.unpack_from("<H", good, at)[0], at)
    rows = [(1, good), (2, good[:30]), (3, None), (4, b""), (5, bytes(ring)), (6, b"II*\0\0\0\0\0")]
    out = tiff.tiff_pages(llm.createDataFrame(rows, "doc_id long, media binary")).collect()
    told = {(r["doc_id"], r["page_no"]): r["error"] for r in out}
    assert told[1, 0] is None and told[5, 0] is None
    assert all(told[k] for k in ((2, 0), (3, 0), (4, 0), (5, 1), (6, 0)))
    folded = tiff.fold_pages(tiff.tiff_pages(llm.createDataFrame(rows, "doc_id long, media binary").coalesce(1)), ["doc_id"]).collect()
    assert [r["doc_id"] for r in folded] == [1, 2, 3, 4, 5, 6] and [r["payload_bytes"] for r in folded] == [128, None, None, None, None, None]


def test_round_trip_of_texts(edges):
    rows = tiff.text_media(edges).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in edges.collect()]
    want = []
    for doc, raw in texts:
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        want.append((doc, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})
    assert any(r["feature"].startswith("pages=4 ") for r in rows)


def test_one_row_per_page_and_clashing_columns(edges, nothing):
    pages = tiff.tiff_pages(tiff.encode_texts(edges))
    assert pages.columns.count("data") == 1 and "__row" in pages.columns
    rows = pages.where("doc_id = 8").collect()
    assert [r["page_no"] for r in rows] == list(range(len(rows))) and len(rows) > 1
    assert tiff.text_media(nothing).count() == 0
