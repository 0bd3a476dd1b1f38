from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import oracle
import pytest

from patternmill.llm import near_dup, queries
from patternmill.llm.graph import components


def sets_of(texts, size):
    out = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        n = min(size, len(words))
        out.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    return out


def brute(rows, size, percent):
    """Components of (key, text) rows by all pairs; the smallest key of each."""
    sets = sets_of([t for _, t in rows], size)
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    out = []
    for k, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((key, len(sets[k]), min(keys) if keys else None))
    return sorted(out, key=repr)


def got(df, **options):
    rows = near_dup.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["component_id"] is None) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


@pytest.mark.parametrize("size, percent, bands, rows", [(3, 85, 32, 6), (5, 80, 40, 5)])
def test_documents_equal_brute_force(llm, sf, size, percent, bands, rows):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    told = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(told, size, percent)
    assert got(docs, size=size, percent=percent, bands=bands, rows=rows) == want
    assert len({c for _, _, c in want}) < len(want)


def chain(n=60):
    """Texts of which each is like the next but not like those further on, near copies, copies, and strangers."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    texts, now = [], words[:120]
    for k in range(n):
        texts.append(" ".join(now))
        now = now[2:] + [f"n{k}", f"m{k}"]
    base = words[200:320]
    for _ in range(n):
        own = list(base)
        own[rng.randrange(120)] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 5 + [" ".join(base).upper()] + ["", " ", None, "one", "ONE", "two words", "two  words"]
    texts += [" ".join(rng.sample(words, 100)) for _ in range(20)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * k + 3, texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("task_shingles", [10**6, 700])
def test_chains_and_groups(llm, task_shingles):
    """With a small bound the groups go through pairs of blocks."""
    rows = chain()
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, size=3, percent=85, bands=32, rows=6, task_shingles=task_shingles) == brute(rows, 3, 85)


def test_edges(edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert got(edges, size=3, percent=85) == brute(rows, 3, 85)
    assert got(nothing) == []
    kept = near_dup.kept_documents(edges)
    assert kept.columns == edges.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 4, 5, 6, 7, 8, 9, 10, 11, None], key=repr)
    assert near_dup.kept_documents(nothing).count() == 0


def test_one_key_with_two_texts(llm):
    rows = [(1, "a b c d e f"), (1, "x y z u v w"), (2, "x y z u v w"), (3, "a b c d e f")]
    assert {r["component_id"] for r in near_dup.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 50, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n * 4 // 5], rng.integers(0, 1 << 63, n - n * 4 // 5).astype(np.uint64)])
        one, two = near_dup.sketches([np.unique(a), np.unique(b)], 192)
        assert not (one == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
        same = n * 4 // 5
        assert abs((one == two).mean() - same / (2 * n - same)) < 0.15


def test_components(llm):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 200)] + [(300, 300), (None, 5)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    rows = components(llm.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {x: find(x) for x in parent} and len(rows) == len(parent)
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_text_keys_and_rows_without_a_key(llm):
    """Keys of any order; a row without a key links the texts on both its sides."""
    words = [f"w{k}" for k in range(60)]
    near = lambda n: " ".join(words[n:] + [f"x{k}" for k in range(n)])
    rows = [("b", near(0)), (None, near(2)), ("a10", near(4)), ("a9", near(40)), (None, near(40)), (None, "nothing like it"), (None, "nothing like it"), ("z", None), ("z", "")]
    df = llm.createDataFrame(rows, "doc_id string, text string")
    assert got(df) == brute(rows, 5, 80) and ("b", 56, "a10") in got(df)
    kept = Counter((r["doc_id"], r["text"]) for r in near_dup.kept_documents(df).collect())
    assert kept == Counter([("a10", near(4)), ("a9", near(40)), (None, "nothing like it"), ("z", None), ("z", "")])


@pytest.mark.parametrize("seed", range(2))
def test_large_groups_of_several_components(llm, seed):
    """Clusters of unlike sizes that share passages; one block holds few sets."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(150)]
    rows = []
    for c in range(8):
        base = common[: rng.randrange(60, 150)] + [f"b{c}_{k}" for k in range(rng.randrange(10, 80))]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: len(own) - rng.randrange(20)])))
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 3, 85)
    assert 1 < len({c for *_, c in want}) < len(rows) / 2
    for task_shingles in (300, 3000):
        assert got(df, size=3, percent=85, bands=32, rows=6, task_shingles=task_shingles) == want


def test_recall_on_all_documents(llm, sf):
    """Links between different texts of 1,000 documents, found and in truth."""
    docs = llm.read.parquet(f"{os.path.dirname(sf.rstrip('/'))}/sf0.01/documents.parquet")
    told = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = sets_of([t for _, t in told], 3)
    holders: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    shared = Counter((a, b) for those in holders.values() if len(those) < 200 for i, a in enumerate(those) for b in those[:i])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    unlike = [(a, b) for a, b in links if sets[a] != sets[b]]
    component = {d: c for d, _, c in got(docs, size=3, percent=85, bands=32, rows=6)}
    assert len(unlike) > 10 and all(component[told[a][0]] == component[told[b][0]] for a, b in links)


@pytest.mark.parametrize("query", ["op3_suffix_dedup", "op4_warc", "op8_near_dup"])
def test_queries_equal_their_sql(llm, sf, query):
    assert not oracle.difference(queries.QUERIES[query](llm, sf).toPandas(), oracle.connection(sf).execute(queries.ORACLE_SQL[query]).df())


def test_linking_equals_all_pairs():
    """Random groups of sets, with labels known beforehand or without, at several limits."""
    rng = random.Random(3)
    names = lambda labels: [labels.index(x) for x in labels]
    for turn in range(600):
        many, percent = rng.choice([3, 8, 20, 60]), rng.choice([30, 50, 80, 85, 100])
        bases = [rng.sample(range(many), rng.randint(1, many)) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(1, 14)):
            one = set(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, many // 5))):
                one ^= {rng.randrange(many + 5)}
            sets.append(one or {1})
        known = [rng.randrange(6) for _ in sets] if turn % 3 == 0 else None
        label = list(known or range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label = [label[a] if x == label[b] else x for x in label]
        assert names(near_dup.linked([np.array(sorted(s), np.uint64) for s in sets], percent, known)) == names(label)
