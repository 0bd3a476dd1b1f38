"""Benchmark decontamination against a plain search, and against SQL."""

from __future__ import annotations

import hashlib
import re

import oracle
import pytest
from conftest import prose
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from patternmill.llm import decontam
from patternmill.llm.queries import op12_decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id string, text string, words int"


def words(text):
    return WORD.findall((text or "").translate(AZ))


def brute(docs, items, size=10):
    """(doc_id, text) and (item_id, text) rows to (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    cut = []
    for key, text in items:
        w = words(text)
        cut += [("" if key is None else str(key), w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, want in cut:
            n = len(want)
            for at in range(len(w) - n + 1):
                if w[at : at + n] == want:
                    hit |= set(range(at, at + n))
                    found.add(item)
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(docs, items):
    return sorted(map(tuple, decontam.report(docs, items).collect()), key=repr)


def test_sql(llm, sf):
    assert not oracle.difference(op12_decontam(llm, sf).toPandas(), oracle.connection(sf).execute(decontam.ORACLE_SQL).df())


def test_edges(edges, nothing, llm):
    passage = prose(30, 1)
    rows = [("b", passage, 1), ("a", passage.upper() + " more words here", 1), ("b", passage, 1), (None, prose(12, 5), 2), ("n", None, 3), ("e", " .,", 4), ("two", "one  TWO", 5), ("p", "日本😀", 6), ("q", prose(9, 4), 7), ("x", "never seen in any of the documents, not once at all", 8)]
    items = llm.createDataFrame(rows, ITEMS)
    docs = [(r["doc_id"], r["text"]) for r in edges.collect()]
    want = brute(docs, [r[:2] for r in rows])
    assert got(edges, items) == want and sum(w[-1] for w in want) >= 5
    assert got(nothing, items) == [] and got(edges, items.limit(0)) == brute(docs, [])
    assert got(edges, items.where("item_id IN ('n', 'e')")) == brute(docs, [])
    clean = decontam.clean_documents(edges, items)
    assert clean.columns == edges.columns and sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((w[0] for w in want if not w[-1]), key=repr)
    kept = decontam.with_contamination(edges, items)
    assert kept.columns.count("n_words") == 1 and kept.count() == edges.count()


def test_places_and_lengths(llm):
    """Windows at both ends, overlapping ones, and texts that are cut off within one."""
    w = [f"w{k}" for k in range(25)]
    texts = [" ".join(w), " ".join(w[:10]), " ".join(w[15:]), " ".join(w[16:]), "x " + " ".join(w[3:14]) + " y", " ".join(w[:9]) + " z " + " ".join(w[10:]), " ".join([*w[:12], *w[:12]]), "-".join(w[5:16]).upper()]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = llm.createDataFrame([("i", " ".join(w), 0), ("short", "w3 w4", 0)], ITEMS)
    assert got(docs, items) == brute(list(enumerate(texts)), [("i", " ".join(w)), ("short", "w3 w4")])
    spans = {(r["doc_id"], r["start"], r["n"]) for r in decontam.passages(docs, items).where("item = 'i'").collect()}
    assert {s for s in spans if s[0] == 4} == {(4, 1, 10), (4, 2, 10)} and (2, 0, 10) in spans and not {s for s in spans if s[0] == 3}


def test_benchmark_in_blocks(llm, monkeypatch):
    """A benchmark that is too large for one broadcast gives the same rows."""
    docs = [(k, prose(60, k % 7) + " " + prose(20, 100 + k)) for k in range(30)]
    items = [(str(k), prose(25, k)) for k in range(10)]
    frames = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame([(*i, 0) for i in items], ITEMS)
    want = brute(docs, items)
    assert got(*frames) == want and any(w[-1] for w in want)
    monkeypatch.setattr(decontam, "BLOCK_ROWS", 20)
    assert got(*frames) == want


def test_long_runs_of_hits(llm):
    """Hits over many words of 64 places, and a phrase that nearly all documents have."""
    phrase = "all rights reserved by the owners of this fine page today"
    long = " ".join([phrase] * 400)
    docs = [(0, long), *[(k, f"{phrase} {prose(5, k)} {phrase}") for k in range(1, 60)]]
    items = [("common", phrase), ("loop", phrase + " " + phrase)]
    assert got(llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame([(*i, 0) for i in items], ITEMS)) == brute(docs, items)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab É.\n", max_size=60), min_size=1, max_size=8), st.lists(st.text("aB É", max_size=30), min_size=1, max_size=4))
def test_any_texts(llm, texts, wanted):
    docs, items = list(enumerate(texts)), [(str(k), t) for k, t in enumerate(wanted)]
    assert got(llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame([(*i, 0) for i in items], ITEMS)) == brute(docs, items)


@pytest.mark.parametrize("text", ["ABC É", "ÀB", "", "İK Σ"])
def test_only_ascii_changes(llm, text):
    from pyspark.sql import functions as F

    assert llm.range(1).select(decontam.lowered(F.lit(text)).alias("t")).first()["t"] == text.translate(AZ)
