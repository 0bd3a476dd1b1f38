"""The Merkle manifest against a plain one, and against SQL."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import oracle
import pytest
from pyspark.sql import functions as F

from patternmill.llm import merkle
from patternmill.llm.queries import op11_merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
AZ = {c: c + 32 for c in range(65, 91)}


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Levels from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, spot):
    out = []
    for level in levels[:-1]:
        low = spot // 16 * 16
        out.append((level[low:spot], level[spot + 1 : low + 16]))
        spot //= 16
    return out


def brute(rows):
    """Rows of COLUMNS to those of the query."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for spot, (r, own) in enumerate(groups[s]):
            path = way(trees[s], spot) + way(top, at)
            now = leaf((*r[:4], r[4].translate(AZ))) if r[0] is not None and r[4] is not None and crc32(str(r[0]).encode()) % 5 == 0 else own
            for before, after in path:
                now = h(*before, now, *after)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(*(x for b, a in path for x in (*b, *a))), now, now == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, merkle.report(df).collect()), key=repr)


def test_sql(llm, sf):
    assert not oracle.difference(op11_merkle(llm, sf).toPandas(), oracle.connection(sf).execute(merkle.ORACLE_SQL).df())


def test_documents(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    rows = got(docs)
    assert rows == brute([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()])
    assert {r[-1] for r in rows} == {True, False} and len({r[3] for r in rows}) == 1


def test_edges(edges, nothing):
    assert got(edges) == brute([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in edges.collect()])
    assert got(nothing) == []


@pytest.mark.parametrize("sizes", [[1], [16, 17], [256, 257, 2], [4096, 4097, 1], [9000, 300, 15]])
def test_sizes_of_groups(llm, sizes):
    """One leaf, full and ragged levels, several blocks; a hot group, equal rows, and a null group."""
    rows = [(k // 3 if s == 0 else k, None if s == 2 else f"s{s}", "en", k, f"Text {k // 2}") for s, n in enumerate(sizes) for k in range(n)]
    df = llm.createDataFrame(rows, COLUMNS).repartition(7)
    assert got(df) == brute(rows)


def test_many_groups_and_partitions(llm):
    rows = [(k, f"host{k % 300}", None, None, "x" * (k % 5)) for k in range(2000)]
    df = llm.createDataFrame(rows, COLUMNS).repartition(5)
    before = llm.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 13):
            llm.conf.set("spark.sql.shuffle.partitions", n)
            assert got(df) == brute(rows)
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("cuts", [[0, 5000], [0, 1, 17, 300, 4096, 4097, 5000], [0, *range(3, 5000, 37), 5000], [0, 16, 32, 256, 512, 5000]])
def test_runs_cut_anywhere(cuts):
    """Whatever runs the tasks see, complete subtrees and ragged nodes hold each node once."""
    import pyarrow as pa

    n = 5000
    leaves = [h(str(k)) for k in range(n)]
    levels, seen = tree(leaves), {}
    for low, high in zip(cuts, cuts[1:]):
        batch = pa.RecordBatch.from_pydict({"grp": ["g"] * (high - low), "pos": list(range(low, high)), "n": [n] * (high - low), "leaf": leaves[low:high]})
        for out in merkle._subtrees([batch.slice(0, 1), batch.slice(1)]):
            for grp, width, level, idx, digest, ragged in zip(*(c.to_pylist() for c in out.columns)):
                assert levels[level][idx] == digest and (level, idx) not in seen
                seen[level, idx] = ragged
    count = sum(seen.values())
    assert count <= 2 * 15 * 4 * (len(cuts) - 1) and (count == 0) == (len(cuts) == 2)


def test_proofs_are_checked_without_the_data(llm):
    rows = [(k, f"s{k % 3}", "en", k, f"Text {k}") for k in range(500)]
    found = merkle.inclusion_proofs(llm.createDataFrame(rows, COLUMNS)).collect()
    for r in found:
        now = r["leaf"]
        for step in r["path"]:
            now = h(step["before"], now, step["after"])
        assert now == r["root"]
    assert len(found) == 500


def test_order_of_the_input_does_not_count(llm):
    rows = [(k % 40, "s", "en", k % 5, "t") for k in range(200)]
    one, two = (llm.createDataFrame(x, COLUMNS).repartition(3) for x in (rows, rows[::-1]))
    assert got(one) == got(two) and got(one.where(F.col("doc_id") > 0)) != got(one)
