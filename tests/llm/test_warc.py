from __future__ import annotations

import hashlib
import zipfile

import pytest

from patternmill.llm import warc_zip as w

SCHEMA = "page_id long, url string, html string, digest int, payload string"


def rows():
    big, other = "<p>" + "x" * 200, "é" * 60
    return [(3, "http://a/1", big, 0, ""), (2, "http://a/2", big, 0, ""), (2, "http://a/2", big, 0, ""), (4, None, None, 0, ""), (5, "http://a/\n5", "", 0, ""), (6, " u\u2028\x85 v", "short", 0, ""), (7, "u", "short", 0, ""), (None, "u", big, 0, ""), (9, "u", other, 0, ""), (8, "u", other, 0, ""), (10, "u", "w" * 50_000, 0, "")]


def expected(table):
    first = {}
    for page, _, html, *_ in table:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(page, first.get(raw, page))
    out = []
    for page, _, html, *_ in table:
        raw = (html or "").encode()
        refers = first.get(raw) if first.get(raw) != page else None
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [1, 300, 1 << 20])
def test_round_trip(llm, archive_bytes):
    table = llm.createDataFrame(rows(), SCHEMA).repartition(3)
    got = [tuple(r)[:5] for r in w.round_trip(table, archive_bytes).collect()]
    assert sorted(got, key=repr) == expected(rows())


def test_text_ids(llm):
    """Ids of any text, the smallest by its own order; an empty one is no null."""
    big = "<p>" + "y" * 200
    table = [("b/ 9é", "u", big), ("a>10", "u", big), ("", "u", big), (None, "u", big), (None, "u", "z" * 300), ("%41", "u", "short")]
    got = [tuple(r)[:5] for r in w.round_trip(llm.createDataFrame(table, "page_id string, url string, html string")).collect()]
    assert sorted(got, key=repr) == expected(table) and ("b/ 9é", 203, hashlib.sha256(big.encode()).hexdigest(), "revisit", "") in got


def test_empty_table(llm):
    assert w.round_trip(llm.createDataFrame([], SCHEMA)).count() == 0


def archive(tmp_path, zip64):
    records = [w.make_record(k, f"http://a/{k}", b"p" * k, "d", None) for k in range(50)]
    data = w.pack_archive(records, [f"http://a/{k}" for k in range(50)], zip64)
    (tmp_path / "a.wacz").write_bytes(data)
    return f"file://{tmp_path}/a.wacz"


@pytest.mark.parametrize("zip64", [False, True])
def test_members_and_ranges(tmp_path, monkeypatch, zip64):
    if zip64:  # makes the writer use the ZIP64 end record and extra fields
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    uri = archive(tmp_path, zip64)
    source = w.Source(uri)
    names = [m.name for m in w.members(source)]
    assert names == [w.DATA, w.INDEX, w.PACKAGE]
    found = list(w.read_archive(uri, gap=100))
    assert [len(w.parse_http(r["block"])[1]) for r in found] == list(range(50))
    with zipfile.ZipFile(tmp_path / "a.wacz") as z:
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_broken_archives(tmp_path):
    uri = archive(tmp_path, False)
    data = (tmp_path / "a.wacz").read_bytes()
    for bad in (b"", b"x" * 100, data[:-30], data.replace(b"PK\1\2", b"PK\1\3")):
        (tmp_path / "b.wacz").write_bytes(bad)
        with pytest.raises(w.BadArchive):
            list(w.read_archive(f"file://{tmp_path}/b.wacz"))
    assert len(list(w.read_archive(uri))) == 50
    with zipfile.ZipFile(tmp_path / "c.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(w.INDEX, "x")
    with pytest.raises(w.BadArchive):
        list(w.read_archive(f"file://{tmp_path}/c.wacz"))
