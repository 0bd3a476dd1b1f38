from __future__ import annotations

import re
from collections import Counter

import oracle
import pytest

from patternmill.llm import quality
from patternmill.llm.queries import op6_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    out = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def judged(rows):
    """(doc_id, source, text) rows to (doc_id, *rules, kept)."""
    told = [(d, s, rules(t)) for d, s, t in rows]
    n, f = Counter(s for _, s, _ in told), Counter(s for _, s, r in told if r[5])
    mean, k = sum(f.values()) / len(told), len(n)
    spread = sum((f[s] / n[s] - mean) ** 2 for s in n) / k - mean * (1 - mean) * sum(1 / n[s] for s in n) / k
    weight = quality.PRIOR_MOST if spread <= 0 else min(quality.PRIOR_MOST, max(quality.PRIOR_LEAST, mean * (1 - mean) / spread - 1))
    bad = {s for s in n if (f[s] + mean * weight) / (n[s] + weight) > quality.HOST_LIMIT}
    return sorted(((d, *r, not (r[5] or s in bad)) for d, s, r in told), key=repr)


def got(df):
    columns = ["doc_id", *quality.RULES, "kept"]
    return sorted((tuple(r[c] for c in columns) for r in quality.score_documents(df).collect()), key=repr)


def test_documents(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == judged([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()])


def test_sql(llm, sf):
    assert not oracle.difference(op6_quality(llm, sf).toPandas(), oracle.connection(sf).execute(quality.ORACLE_SQL).df())


def test_edges(edges, nothing):
    want = judged([(r["doc_id"], r["source"], r["text"]) for r in edges.collect()])
    assert got(edges) == want
    assert got(nothing) == []
    kept = quality.kept_documents(edges)
    assert kept.columns == edges.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((w[0] for w in want if w[-1]), key=repr)
    assert quality.kept_documents(nothing).count() == 0
    assert quality.document_rules(edges).columns.count("n_words") == 1


def test_bad_hosts_go_and_small_ones_get_the_benefit(llm):
    good, bad = " ".join(f"w{k}" for k in range(80)), "too short"
    rows = [(k, "bad", bad if k % 10 else good) for k in range(100)] + [(1000 + k, f"h{k % 20}", good) for k in range(400)] + [(9000, "tiny", good), (9001, "tiny", bad)]
    df = llm.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.score_documents(df).collect()}
    assert not any(kept[k] for k in range(100)) and all(kept[1000 + k] for k in range(400)) and kept[9000] and not kept[9001]
    assert got(df) == judged(rows)


def test_filters_do_not_repeat_the_work(llm, sf):
    """A filter on a rule must not be moved into the steps that build it."""
    rules = quality.document_rules(llm.read.parquet(f"{sf}/documents.parquet").select("text"))
    uses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert uses(rules.where("NOT base_failed AND n_words < 900")) == uses(rules)


@pytest.mark.parametrize("rates, weight", [([0.2] * 9, quality.PRIOR_MOST), ([0.0, 1.0] * 5, quality.PRIOR_LEAST)])
def test_prior(llm, rates, weight):
    hosts = llm.createDataFrame([(str(k), 100, int(100 * r)) for k, r in enumerate(rates)], "host string, host_docs long, host_failures long")
    prior = quality.fit_prior(hosts)
    assert prior.alpha + prior.beta == pytest.approx(weight)
    assert quality.fit_prior(hosts.limit(0)) == (1.0, 1.0)
