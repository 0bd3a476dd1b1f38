"""WARC records in ZIP-packaged archives: write them, and read them back by ranges.

An archive is a ZIP file with stored members: archive/data.warc.gz (one gzip member per record), indexes/index.cdxj
(one line per record with offset and length) and datapackage.json. The reader parses the end record, the central
directory and their ZIP64 forms itself, finds where each stored member's bytes begin, reads the index and then only
the byte ranges of records; nothing is extracted.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.llm.common import joinable, slices
from patternmill.session import fresh_path, stored

# Fixed values of the ZIP format.
END_SIGN, END64_SIGN, LOCATOR_SIGN, CENTRAL_SIGN, LOCAL_SIGN = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, LOCATOR_SIZE, CENTRAL_SIZE, LOCAL_SIZE, ZIP64_EXTRA = 22, 20, 46, 30, 1
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
RECORD_URN, NO_URL, NO_PAGE = "urn:patternmill:page:", "urn:patternmill:none", "urn:patternmill:no-page"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload that a task reads back, about, and the most tasks for that.
TASK_BYTES, MOST_TASKS = 256 << 20, 50_000


class BadArchive(ValueError):
    """The bytes are no archive that this reader can use."""


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int


class Source:
    """Reads ranges of a file; counts the bytes."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.bytes_read = 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise BadArchive(f"bytes {at} to {at + n} lie outside a file of {self.size}")
        self.bytes_read += n
        return self.file.read_at(n, at) if n else b""

    def close(self) -> None:
        self.file.close()


def members(source: Source) -> list[Member]:
    """The entries of the central directory, ZIP64 or not."""
    tail_size = min(source.size, END_SIZE + MAX16)
    tail_at = source.size - tail_size
    tail = source.read(tail_at, tail_size)
    end = tail.rfind(END_SIGN)
    while end >= 0 and (end + END_SIZE > tail_size or end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] > tail_size):
        end = tail.rfind(END_SIGN, 0, end)
    if end < 0:
        raise BadArchive("no end of central directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if (count == MAX16 or size == MAX32 or at == MAX32) and tail_at + end >= LOCATOR_SIZE:
        locator = source.read(tail_at + end - LOCATOR_SIZE, LOCATOR_SIZE)
        if locator[:4] == LOCATOR_SIGN:
            (where,) = struct.unpack_from("<Q", locator, 8)
            end64 = source.read(where, 56)
            if end64[:4] != END64_SIGN:
                raise BadArchive("no ZIP64 end record where the locator points")
            count, size, at = struct.unpack_from("<QQQ", end64, 32)
    central, found, k = source.read(at, size), [], 0
    for _ in range(count):
        if central[k : k + 4] != CENTRAL_SIGN:
            raise BadArchive("a broken central directory")
        (method,) = struct.unpack_from("<H", central, k + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, k + 20)
        (header,) = struct.unpack_from("<I", central, k + 42)
        name = central[k + CENTRAL_SIZE : k + CENTRAL_SIZE + n_name].decode("utf-8", "replace")
        extra = central[k + CENTRAL_SIZE + n_name : k + CENTRAL_SIZE + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, e)
            if kind == ZIP64_EXTRA:
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = next(values, plain) if plain == MAX32 else plain
                packed = next(values, packed) if packed == MAX32 else packed
                header = next(values, header) if header == MAX32 else header
            e += 4 + length
        found.append(Member(name, method, plain, packed, header))
        k += CENTRAL_SIZE + n_name + n_extra + n_comment
    return found


def stored_start(source: Source, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != zipfile.ZIP_STORED:
        raise BadArchive(f"{member.name} is compressed; only stored members can be read by range")
    local = source.read(member.header, LOCAL_SIZE)
    if local[:4] != LOCAL_SIGN:
        raise BadArchive(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + LOCAL_SIZE + n_name + n_extra


def parse_record(raw: bytes) -> dict:
    """A WARC record (not gzipped): its headers in lower case, and the block."""
    head, sign, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sign or not lines[0].startswith("WARC/"):
        raise BadArchive("no WARC record at this offset")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return {"headers": headers, "block": block[: int(headers.get("content-length", 0))]}


def parse_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}, payload


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "\r\n") else value


def _urn(page_id: str | int | None) -> str:
    return NO_PAGE if page_id is None else RECORD_URN + quote(str(page_id), safe="")


def make_record(page_id: str | int | None, url: str | None, payload: bytes, digest: str, refers_to: str | int | None) -> bytes:
    """A response record, or a revisit record (HTTP headers only) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_urn(page_id)}>",
        f"WARC-Target-URI: {_clean(url) if url else NO_URL}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha-256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def pack_archive(records: list[bytes], urls: list[str], zip64: bool = False) -> bytes:
    """A ZIP file with the given records (each is gzipped by itself) and their index."""
    data, index = bytearray(), []
    for record, url in zip(records, urls, strict=True):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        index.append(f"{url.split(' ')[0]} {DATE} " + json.dumps({"offset": len(data), "length": len(packed), "filename": DATA}))
        data += packed
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        for name, held in ((DATA, bytes(data)), (INDEX, ("\n".join(index) + "\n" * bool(index)).encode()), (PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())):
            with archive.open(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                f.write(held)
    return out.getvalue()


def read_archive(uri: str, gap: int = 4 << 20) -> Iterator[dict]:
    """The records of one archive, in the order of its index; reads about `gap` bytes at once."""
    source = Source(uri)
    try:
        held = {m.name: m for m in members(source)}
        starts: dict[str, int] = {}
        for name in sorted(n for n in held if n.startswith("indexes/") and n.endswith(".cdxj")):
            lines = source.read(stored_start(source, held[name]), held[name].size).decode().split("\n")
            told = [json.loads(line.split(" ", 2)[2]) for line in lines if line.strip()]
            k = 0
            while k < len(told):
                data = told[k]["filename"]
                if data not in held:
                    raise BadArchive(f"the index names {data}, which is no member")
                if data not in starts:
                    starts[data] = stored_start(source, held[data])
                begin, end, upto = told[k]["offset"], told[k]["offset"] + told[k]["length"], k + 1
                while upto < len(told) and told[upto]["filename"] == data and told[upto]["offset"] == end and end - begin < gap:
                    end += told[upto]["length"]
                    upto += 1
                if end > held[data].size:
                    raise BadArchive("the index points outside its member")
                block = source.read(starts[data] + begin, end - begin)
                for x in told[k:upto]:
                    at = x["offset"] - begin
                    yield x | parse_record(zlib.decompress(block[at : at + x["length"]], 31))
                k = upto
    finally:
        source.close()


def _page(urn: str | None) -> str | None:
    name = (urn or "").strip("<>")
    return unquote(name.removeprefix(RECORD_URN)) if name.startswith(RECORD_URN) else None


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 16 << 20, zip64: bool = False) -> DataFrame:
    """Write rows of (page_id, url, payload binary, digest, refers_to) to archives; one row (uri, records, bytes of payload) per archive.

    page_id and refers_to are written as text. Each attempt of a task writes under names of its own, and only the archives in the returned table count, so a task
    that is run again does no harm. A worker holds `archive_bytes` of payload, or one payload that is larger.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        records, urls, size = [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(pack_archive(records, urls, zip64))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([size], pa.int64())], names=["uri", "records", "bytes"])

        for batch in slices(batches, "payload", archive_bytes):
            for row in batch.to_pylist():
                payload = row["payload"] or b""
                records.append(make_record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]))
                urls.append(_clean(row["url"]) if row["url"] else NO_URL)
                size += len(payload)
                if size >= archive_bytes:
                    yield flush()
                    records, urls, size = [], [], 0
        if records:
            yield flush()

    text = lambda c: F.col(c).cast("string").alias(c)
    return pages.select(text("page_id"), "url", "payload", "digest", text("refers_to")).mapInArrow(run, "uri string, records long, bytes long")


RECORD_FIELDS = {"uri": pa.string(), "offset": pa.int64(), "length": pa.int64(), "warc_type": pa.string(), "page_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "declared_bytes": pa.int64(), "declared_digest": pa.string(), "payload": pa.binary()}
RECORD_DDL = "uri string, offset long, length long, warc_type string, page_id string, refers_to string, target_uri string, declared_bytes long, declared_digest string, payload binary"


def read_records(archives: DataFrame, uri: str = "uri") -> DataFrame:
    """One row per WARC record of the archives that the column names; a revisit's payload is null. Null names are skipped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in RECORD_FIELDS.items()], names=[*RECORD_FIELDS])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for x in read_archive(name) if name else ():
                    headers = x["headers"]
                    http, payload = parse_http(x["block"])
                    if headers.get("warc-type") == "revisit":
                        payload = None
                    rows.append(
                        {
                            "uri": name, "offset": x["offset"], "length": x["length"], "warc_type": headers.get("warc-type"), "page_id": _page(headers.get("warc-record-id")),
                            "refers_to": _page(headers.get("warc-refers-to")), "target_uri": None if headers.get("warc-target-uri") == NO_URL else headers.get("warc-target-uri"),
                            "declared_bytes": int(http.get("content-length", 0)), "declared_digest": headers.get("warc-payload-digest", "").rpartition(":")[2], "payload": payload,
                        }
                    )
                    held += len(payload or b"")
                    if held > 2 << 20:
                        yield out()
                        rows, held = [], 0
                if rows:
                    yield out()

    return archives.select(uri).mapInArrow(run, RECORD_DDL)


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Add payload, digest and refers_to: of equal payloads of `least` bytes or more, all but the smallest page_id refer to it.

    page_id may be of any type that has an order. A null html is an empty payload. Rows that share the smallest page_id of their payload are all responses; a null
    page_id refers to the smallest one there is, and is a response if all are null. Only digests that occur twice are
    joined back, by broadcast if they are few, else by a shuffle that AQE can split.
    """
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = own.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 AND first_id IS NOT NULL").drop("copies")
    first = stored(first, "warc-first")
    joined = own.join(joinable(first), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def round_trip(pages: DataFrame, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write all pages to archives in the shared folder, then read the records back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url)."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    written = stored(write_archives(mark_revisits(pages), fresh_path(spark, "warc"), archive_bytes), "warc-archives")
    told = written.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = min(told["n"], MOST_TASKS, max(2 * spark.sparkContext.defaultParallelism, -(-(told["bytes"] or 0) // TASK_BYTES)))
    records = read_records(written.repartition(max(1, tasks)))
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.coalesce(F.octet_length("payload"), "declared_bytes").cast("long").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "declared_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )


#: The same in DuckDB's SQL.
ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT *, CAST(octet_length(b) AS BIGINT) AS n, sha256(b) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM k WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, k.digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, url
FROM k LEFT JOIN f ON k.digest = f.digest
"""
