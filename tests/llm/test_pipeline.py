"""The stages one after the other against brute force."""

from __future__ import annotations

import hashlib
import re

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from test_mixing import WORD
from test_near_dup import brute as components_of
from test_quality import judged

import corpus_pipeline
from patternmill.llm import mixing, secrets


@pytest.fixture(scope="module")
def home(llm, sf, tmp_path_factory):
    """The documents, and some of them again with a secret or a changed word."""
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    secret = F.concat("text", F.lit(' token = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('" and more'))
    more = docs.where("n_chars BETWEEN 600 AND 3000 AND doc_id % 4 = 0").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat(F.reverse("text"), secret))
    near = more.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat("text", F.lit(" changed")))
    folder = f"file://{tmp_path_factory.mktemp('docs')}"
    docs.unionByName(more).unionByName(near).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def steps(llm, home):
    docs = llm.read.parquet(f"{home}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, home).cache()
        out.append(docs.collect())
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "bpe_tokens"]
    for rows in steps[1:5]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(steps):
    want = {d: kept for d, *_, kept in judged([(r["doc_id"], r["source"], r["text"]) for r in steps[0]])}
    assert sorted(map(tuple, steps[1])) == sorted(tuple(r) for r in steps[0] if want[r["doc_id"]])


def test_near_duplicates(steps):
    want = {d for d, _, c in components_of([(r["doc_id"], r["text"]) for r in steps[1]], 5, 80) if d == c}
    assert sorted(map(tuple, steps[2])) == sorted(tuple(r) for r in steps[1] if r["doc_id"] in want) and len(steps[2]) < len(steps[1])


def test_secrets(llm, steps):
    planted = re.compile(r'(?i)(token = ")[0-9a-f]{40}(")')
    want = {r["doc_id"]: planted.sub(r"\g<1>[SECRET]\2", r["text"]) for r in steps[2]}
    assert {r["doc_id"]: r["text"] for r in steps[3]} == want and any("[SECRET]" in t for t in want.values())
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3])


def test_mix(llm, steps):
    docs = llm.createDataFrame(steps[3])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs).collect()}
    got: dict = {}
    for r in steps[4]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert got == {d: n for d, n in taken.items() if n}


def test_tokens(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in steps[4]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(r["text"]), ids))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in steps[5]) == sorted(want)


def test_run_agrees_with_its_stages(llm, home, steps):
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, corpus_pipeline.run(llm, home).collect())) == sorted(map(key, steps[5]))


def test_edges(llm, edges, nothing):
    for docs in (edges, nothing):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(llm, docs, "")
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](llm, docs, "").count() == docs.count()


def test_findings_of_the_scan_are_what_is_masked(llm, steps):
    docs = llm.createDataFrame(steps[2])
    n = secrets.report(docs).where("confirmed").count()
    assert sum(r["text"].count("[SECRET]") for r in steps[3]) == n


def test_rows_without_an_id_or_with_the_same_one(llm):
    """Several texts under a null doc_id and under a repeated one: each is masked and cut by what it holds itself."""
    from collections import Counter

    from conftest import prose

    texts, clean = [], []
    for k in range(24):
        key = hashlib.sha1(str(k).encode()).hexdigest()
        front, back = prose(20 + 7 * k, k).replace(" ", f"_{k} "), prose(40, 100 + k).replace(" ", f"_{k} ")
        texts.append(f'{front} token = "{key}" {back}' if k % 3 else f"{front} {back}")
        clean.append(texts[-1].replace(key, "[SECRET]"))
    rows = [(None if k % 2 else 5, t, "en", f"s{k % 4 // 2}", len(t)) for k, t in enumerate(texts)]
    docs = llm.createDataFrame(rows + rows[:2] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    masked = corpus_pipeline.secret_scan(llm, docs, "")
    assert Counter(r["text"] for r in masked.collect()) == Counter(clean + clean[:2] * 3)
    taken = mixing.mix_documents(masked)
    out = corpus_pipeline.source_mix(llm, masked, "").collect()
    assert sum(len(WORD.findall(r["text"])) for r in out) == taken.agg(F.sum("taken")).first()[0]
    size = {t: len(WORD.findall(t)) for t in clean}
    held: Counter = Counter()
    for r in out:
        words = Counter(WORD.findall(r["text"]))
        homes = [t for t in clean if not words - Counter(WORD.findall(t))]
        if len(homes) == 1:
            held[homes[0]] += sum(words.values())
        assert homes and r["n_chars"] == len(r["text"])
    assert all(n <= 2 * size[t] * (4 if t in clean[:2] else 1) for t, n in held.items())
