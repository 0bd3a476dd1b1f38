from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patternmill.llm import suffix_dedup
from patternmill.llm.grouping import suffix_array


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array(values):
    text = [*values, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_runs_and_bad_input():
    for text in ([1] * 500 + [0], [1, 2] * 300 + [0], list(range(300, -1, -1)), []):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    for bad in ([1, 1], [0, 1], [0, 2, 0]):
        with pytest.raises(ValueError):
            suffix_array(bad)


def brute(texts, length):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def got(df, **options):
    rows = suffix_dedup.without_repeats(df, **options).collect()
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows]


OPTIONS = [{}, {"core_pieces": 1, "part": 1500}, {"width": 1}, {"gram": 200}, {"gram": 32, "width": 60}]


@pytest.mark.parametrize("options", OPTIONS)
def test_removal_equals_brute_force_on_the_documents(llm, sf, options):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] for r in rows], 200), strict=True)]
    assert sorted(got(docs, **options)) == sorted(want)


def test_edges(edges, nothing):
    rows = edges.collect()
    want = [(r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] for r in rows], 200), strict=True)]
    assert sorted(got(edges), key=repr) == sorted(want, key=repr)
    assert got(nothing) == []


def test_short_alphabets_and_edits(llm):
    """Periodic texts, copies with edits, one key with two texts."""
    rng = random.Random(4)
    base = "".join(rng.choice("ab") for _ in range(900))
    texts = ["a" * 500, "ab" * 300, base, base[:300] + "X" + base[300:], base[200:700], base[::-1], "é" * 150, base[:199], base[100:299] + "q"]
    texts += [base[:k] + "Z" + base[k + 1 :] for k in range(0, 900, 150)]
    rows = [(k if k != 1 else 0, t) for k, t in enumerate(texts)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    want = sorted((k, *b) for (k, _), b in zip(rows, brute(texts, 200), strict=True))
    for options in OPTIONS:
        assert sorted(got(df, **options)) == want, options
    small = sorted((k, *b) for (k, _), b in zip(rows, brute(texts, 20), strict=True))
    assert sorted(got(df, length=20, gram=7, width=5, part=100)) == small


def thue_morse(n, one="a", two="b"):
    text = one
    while len(text) < n:
        text += text.translate(str.maketrans({one: two, two: one}))
    return text


def test_texts_that_break_rolling_hashes(llm):
    """A Thue-Morse text and its complement have equal polynomial hashes modulo 2^64, but share no long string."""
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    texts = ["q" * 64 + one + "r" * 100, "q" * 64 + two + "r" * 100, one[100:1500], "xy" + two[:700]]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, options in ((2048, {"width": 35}), (2048, {"gram": 1024}), (300, {}), (200, {"core_pieces": 2})):
        assert sorted(got(df, length=length, **options)) == sorted((k, *b) for k, b in enumerate(brute(texts, length))), (length, options)


@pytest.mark.parametrize("seed", range(6))
def test_random_parameters(llm, seed):
    """Texts made of a few blocks, so that strings repeat in many contexts; every core is split until it is small."""
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abcde") for _ in range(rng.randrange(5, 60))) for _ in range(8)] + ["z" * 50, "ab" * 30]
    texts = ["".join(rng.choice(blocks) for _ in range(rng.randrange(40))) for _ in range(40)]
    length = rng.randrange(20, 90)
    options = {"gram": rng.randrange(4, length + 1), "width": rng.randrange(1, 60), "core_pieces": rng.choice([1, 2, 5, 50]), "part": rng.randrange(2 * length + 1, 900)}
    df = llm.createDataFrame([(f"k{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    want = sorted((f"k{k}", *b) for k, b in enumerate(brute(texts, length)))
    assert sorted(got(df, length=length, **options)) == want, (length, options)


def test_rows_without_a_key_and_other_names(llm):
    rng = random.Random(7)
    base = "".join(rng.choice("abc") for _ in range(500))
    texts = [base, base[:250] + "-" * 10 + base[250:], base[::-1], base]
    df = llm.createDataFrame([(None, t, "x") for t in texts], "doc string, mark string, found string")
    rows = suffix_dedup.without_repeats(df, "doc", "mark").collect()
    want = sorted((n, removed) for n, removed, *_ in brute(texts, 200))
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == want and rows[0]["doc"] is None


def test_parameters(llm, nothing):
    for bad in ({"gram": 0}, {"gram": 201}, {"length": 1 << 15}, {"part": 400}, {"part": 300}, {"part": (1 << 24) + 1}, {"width": 0}, {"core_pieces": 0}):
        with pytest.raises(ValueError):
            suffix_dedup.without_repeats(nothing, **bad)
    assert suffix_dedup.offset_ranges(200, 64, 35) == [(0, 34), (35, 69), (70, 104), (102, 136)]
