"""A repository that changes, against banks made anew."""

from __future__ import annotations

import pytest

from patternmill.config import BatchConfig, Config
from patternmill.operators.scanners import chunks_of
from patternmill.plans.api import PatternBank

FILES = "repo string, file_path string, language string, content string, ingest_seq long"
OWN = Config(batch=BatchConfig(max_retries=1, retry_delay=0.0))


def source(k, extra=""):
    return f"class A{k}:\n" + "".join(f"    def step_{j}(self):\n        return 'step {k} {j}{extra}'\n" for j in range(4)) + "\n\ndef run(a):\n" + "".join(f"    a += {k + j}\n" for j in range(6)) + "    return a\n"


@pytest.fixture
def bank(spark, tmp_path):
    return PatternBank(spark, f"file://{tmp_path}/bank", config=OWN)


def files(spark, held):
    return spark.createDataFrame([("me/app", p, "python", c, n) for n, (p, c) in enumerate(held.items())], FILES)


def held(b):
    return sorted((r["point_id"], r["source_path"], r["document"], r["title"]) for r in b.read().collect())


def test_edit_rename_delete(spark, bank, tmp_path):
    start = {f"src/f{k}.py": source(k) for k in range(12)}
    assert bank.resync(files(spark, start), "me/app").first().asDict() == {"same": 0, "new": 12, "changed": 0, "gone": 0, "failed": 0, "points": 12, "deleted": 0}
    bank.store(spark.createDataFrame([("def other(): return 1 # long enough", "Other", "of another source", "testing", "python")], "content string, title string, description string, category string, language string"))
    after = dict(start) | {"src/f1.py": source(1, " new"), "src/f2.py": source(2) + "\nx = 1\n", "src/f3.py": "", "lib/f4.py": source(4)}
    for p in ("src/f4.py", "src/f5.py"):
        del after[p]
    told = bank.resync(files(spark, after), "me/app").first().asDict()
    assert told == {"same": 7, "new": 1, "changed": 3, "gone": 2, "failed": 0, "points": told["points"], "deleted": told["deleted"]} and told["deleted"] == 4
    fresh = PatternBank(spark, f"file://{tmp_path}/fresh", config=OWN)
    fresh.resync(files(spark, after), "me/app")
    assert [r for r in held(bank) if r[1] != ""] == held(fresh) and len(held(bank)) == len(held(fresh)) + 1
    versions = bank.table.versions()[-1]
    assert bank.resync(files(spark, after), "me/app").first().asDict() == {"same": 11, "new": 0, "changed": 0, "gone": 0, "failed": 0, "points": 0, "deleted": 0}
    assert [r for r in held(bank) if r[1] != ""] == held(fresh) and bank.table.versions()[-1] == versions + 1


def test_other_repositories_stay(spark, bank):
    bank.resync(files(spark, {"a.py": source(1)}), "me/app")
    other = files(spark, {"a.py": source(1), "b.py": source(2)}).selectExpr("'me/lib' AS repo", "file_path", "language", "content", "ingest_seq")
    bank.resync(other, "me/lib")
    bank.resync(other.limit(0), "me/lib")
    assert {(r[1]) for r in held(bank)} == {"a.py"} and bank.read().select("source_repo").distinct().collect()[0][0] == "me/app"


def test_files_that_fail_keep_their_points_and_are_tried_again(spark, bank):
    bank.resync(files(spark, {"a.py": source(1), "b.py": source(2)}), "me/app")
    before = held(bank)
    now = files(spark, {"a.py": source(1, "x"), "b.py": source(2, "x")})

    def bad(content, path, language):
        if path == "a.py":
            raise ValueError("no good")
        return chunks_of(content, path, language)

    told = bank.resync(now, "me/app", chunker=bad).first()
    assert (told["failed"], told["changed"]) == (1, 2) and [r for r in held(bank) if r[1] == "a.py"] == [r for r in before if r[1] == "a.py"]
    assert bank.resync(now, "me/app").first()["changed"] == 1
    assert {r[2].count("x'") > 0 for r in held(bank) if "class" in r[2]} == {True}


def test_repeated_paths_and_embedding_of_new_files_alone(spark, tmp_path):
    from patternmill.operators.embed import CallEmbedder

    seen = spark.sparkContext.accumulator(0)

    def call(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    b = PatternBank(spark, f"file://{tmp_path}/bank", config=OWN, embedder=CallEmbedder(call, 1))
    start = {f"f{k}.py": source(k) for k in range(6)}
    b.resync(files(spark, start), "me/app")
    first = seen.value
    twice = files(spark, start).unionByName(files(spark, {"f0.py": source(0, "y")}).selectExpr("repo", "file_path", "language", "content", "ingest_seq + 100 AS ingest_seq"))
    assert b.resync(twice, "me/app").first()["changed"] == 1
    assert first == 6 and seen.value - first == 1 and sum("y'" in r[2] for r in held(b)) == 1
