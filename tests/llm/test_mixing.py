from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from patternmill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Share by weight; what is over a source's limit goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            return {s: 2 * sizes[s] if s in full else rest * weight[s] / total for s in order}
        full |= set(over)


def checked(df, near):
    docs = df.collect()
    rows = mixing.mix_documents(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    want = sorted(((r["doc_id"], size(r["text"]), r["source"]) for r in docs), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["source"]) for r in rows), key=repr) == want
    sizes: Counter = Counter()
    for r in docs:
        sizes[r["source"]] += size(r["text"])
    wanted, taken = targets(sizes), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= mixing.BLOCK_WORDS + near * wanted[s], s
    again = mixing.mix_documents(df.repartition(5)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    return rows


def test_documents(llm, sf):
    rows = checked(llm.read.parquet(f"{sf}/documents.parquet"), 0.01)
    assert len({r["taken"] / r["size"] for r in rows if r["size"]}) > 20


def test_edges(edges, nothing):
    checked(edges, 0.02)
    assert mixing.mix_documents(nothing).count() == 0
    out = mixing.mixed_texts(edges)
    assert out.columns == edges.columns and mixing.mixed_texts(nothing).count() == 0


def test_a_hot_source_and_empty_ones(llm, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_DOCS", 50)
    monkeypatch.setattr(mixing, "TASK_ROWS", 500)
    rows = [(k, "a" if k < 700 else f"s{k % 7}", "w " * (k % 90)) for k in range(1000)] + [(2000, "none", ""), (2001, None, None), (2002, "b", "one")]
    checked(llm.createDataFrame(rows, "doc_id long, source string, text string"), 0.02)


def test_permutation_is_one_to_one(llm):
    sizes = llm.createDataFrame([(n,) for n in (1, 2, 3, 7, 64, 1000)], "n long").withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    out = mixing.permuted(sizes.withColumn("w", F.col("v")), "w", "n", [F.lit(3), F.col("n")]).collect()
    held = defaultdict(list)
    for r in out:
        held[r["n"]].append(r["w"])
    assert all(sorted(v) == list(range(n)) for n, v in held.items())
    assert sum(r["v"] == r["w"] for r in out if r["n"] == 1000) < 20


def test_draws_are_spread_and_meet_the_quotas(llm):
    sources = llm.createDataFrame([(0, 9000), (1, 0), (2, 2500), (3, 500), (4, 1)], "source_no int, quota long")
    slots = mixing.draw_slots(sources, 5, 100).collect()
    ranks = defaultdict(list)
    for r in slots:
        ranks[r["source_no"]].append(r["rank"])
    assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(q)) for s, q in ((0, 9000), (2, 2500), (3, 500), (4, 1))}
    shards = Counter(r["shard"] for r in slots)
    assert len(shards) == 121 and all(shards[k] == 100 for k in range(120)) and shards[120] == 1
    each = Counter(r["shard"] for r in slots if r["source_no"] == 2)
    mean = 100 * 2500 / 12001
    spread = sum((each.get(k, 0) - mean) ** 2 for k in range(120)) / 120
    assert 0.5 * mean < spread < 1.5 * mean  # as a multinomial draw has it


def test_texts_follow_the_plan(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    plan = {r["doc_id"]: r for r in mixing.mix_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words: Counter = Counter()
    rows = mixing.mixed_texts(docs).collect()
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
        assert not Counter(WORD.findall(r["text"])) - Counter(WORD.findall(texts[r["doc_id"]]))
    assert words == Counter({d: r["taken"] for d, r in plan.items() if r["taken"]})
    assert max(Counter(r["doc_id"] for r in rows).values()) == 2
    assert any(r["text"] == texts[r["doc_id"]] for r in rows)
