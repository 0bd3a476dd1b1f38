"""Every registered query of the bank against its SQL, or its rows against a model where there is no SQL."""

from __future__ import annotations

import oracle
import pytest

from patternmill import queries
from patternmill.operators.scanners import chunks_of


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert not oracle.difference(got, con.execute(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark, sf):
    told = {r["what"]: r["n"] for r in queries.sync_stream_equals_batch(spark, sf).collect()}
    assert told["only_stream"] == told["only_batch"] == 0 < told["streamed"]


SMALL_TREE = {"a.py": b"x = 1\n", "src/B.PY": b"y = 2\n", "src/c.ts": "é\n".encode(), "node_modules/d.js": b"no", "lib/vendor/e.go": b"no", "bad.go": b"\xff\xfe", "empty.py": b"", "x.md": b"# x"}


def test_discovered_files(spark, tmp_path):
    from patternmill.sources import files

    root = files.write_tree(spark.createDataFrame(list(SMALL_TREE.items()), "path string, content binary"), f"file://{tmp_path}/tree")
    assert (tmp_path / "tree/bad.go").read_bytes() == b"\xff\xfe" and not [p for p in (tmp_path / "tree").rglob("_*") if p.is_file()]
    found = files.code_files(files.tree(spark, root)).collect()
    assert sorted((r["path"], r["language"], r["size"], len(r["content"])) for r in found) == [("a.py", "python", 6, 6), ("src/c.ts", "typescript", 3, 2)]
    points = {r["source_path"]: r["document"] for r in files.discovered(files.local_files(spark, root)).collect()}
    assert points == {"a.py": "x = 1\n", "bad.go": None, "src/c.ts": "é\n"}
    with pytest.raises(Exception, match="leads out"):
        files.write_tree(spark.createDataFrame([("../x", b"1")], "path string, content binary"), root)


def packed(text, most=512, overlap=50):
    """Greedy line packing as a loop."""
    if len(text) / 4 <= most:
        return [text]
    done, held, size = [], [], 0.0
    for line in text.split("\n"):
        if size + len(line) / 4 > most and held:
            done.append("\n".join(held))
            held = held[-max(1, overlap // 20) :]
            size = sum(len(x) / 4 for x in held)
        held.append(line)
        size += len(line) / 4
    return [*done, "\n".join(held)] if held else done


def test_line_packing_equals_a_loop(spark, sf):
    from patternmill.operators.chunking import packed_rows

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got: dict = {}
    for r in packed_rows(docs, "doc_id", "text").collect():
        got.setdefault(r["doc_id"], {})[r["chunk_index"]] = r["text"]
    for r in docs.collect():
        assert [got[r["doc_id"]][k] for k in sorted(got[r["doc_id"]])] == packed(r["text"])


def test_chunk_documents_equals_the_scanner(spark, sf):
    import hashlib

    files = queries.file_rows(spark, sf).collect()
    languages = ["python", "java", "javascript", "go"]
    want = {(r["ingest_seq"], k, hashlib.md5(c.content.encode()).hexdigest(), c.start_line, c.end_line) for r in files for k, c in enumerate(chunks_of(r["content"], r["path"], languages[r["ingest_seq"] % 4]))}
    got = {(r["ingest_seq"], r["chunk_no"], r["digest"], r["start_line"], r["end_line"]) for r in queries.chunk_documents(spark, sf).collect()}
    assert got == want


def test_hash_embedding_topk(spark, sf):
    """Against counts of signed hashes, token by token."""
    import math
    import re
    import zlib

    def vector(text):
        out = [0.0] * 64
        for w in re.findall(r"\w+", text.lower()):
            if re.fullmatch(r"[a-z_][a-z0-9_]*", w):
                h = zlib.crc32(w.encode())
                out[h % 64] += 1.0 if h >> 31 else -1.0
        return out

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    question = vector(queries.QUESTION)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted(((-round(cosine(vector(r["text"]), question), 9), str(r["doc_id"])) for r in docs))[:10]
    got = [(-r["semantic"], r["point_id"]) for r in queries.hash_embedding_topk(spark, sf).collect()]
    assert [p for _, p in got] == [p for _, p in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want])
