"""Configuration, remote analyzers, progress and streaming."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from patternmill import config
from patternmill.functions import render
from patternmill.operators import cache, remote, scaffold
from patternmill.queries import sync_files
from patternmill.session import ship
from patternmill.streaming import ingest


def test_config():
    c = config.from_settings({"batch": {"batch_size": 3, "other": 1}, "search": None, "embeddings": {"model": "x"}, "unknown": 1, "github": {"excluded_repos": ["a*"]}})
    assert c.batch.batch_size == 3 and c.search.keyword_weight == 0.3 and c.embedding.dimensions() == 384 and c.repos.excluded == ["a*"]
    assert config.EmbeddingConfig().dimensions() == 768 and config.EmbeddingConfig(vector_size=5).dimensions() == 5
    with pytest.raises(ValueError):
        config.CacheConfig(max_size=0)


def test_backoff():
    waits, calls = [], []

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 4:
            raise remote.RateLimited("429")
        return "ok"

    assert remote.with_backoff(call, 5, 1.0, 3.0, waits.append)("p") == ("ok", None) and waits == [1.0, 2.0, 3.0]
    assert remote.with_backoff(lambda p: 1 / 0)("p") == (None, "division by zero")

    def limited(p):
        raise remote.RateLimited("x")

    assert remote.with_backoff(limited, 1, sleep=waits.append)("p") == (None, "rate limit: x")


def test_remote_analysis(spark):
    ship(spark)
    chunks = spark.createDataFrame([(1, "go", "a.go", None, "code"), (2, "go", "b.go", "ctx", "bad")], "n int, language string, file_path string, context string, content string")

    def call(prompt):
        if "bad" in prompt:
            raise ValueError("refused")
        return '{"is_pattern": true, "title": "' + prompt + '", "quality_score": 9}'

    rows = {r["n"]: r for r in remote.analyzed(chunks, "{language} {code} {context}", call).collect()}
    assert rows[1]["analysis"]["title"] == "go code N/A" and rows[1]["analysis"]["quality_score"] == 9 and rows[1]["error"] is None
    assert rows[2]["analysis"] is None and rows[2]["error"] == "refused"


def test_structure_from_a_model(spark):
    ask = lambda p: '{"directories": ["d"], "files": {"a": "b"}}'
    assert scaffold.structure_from(spark, "n", "api", ["go"], ask).first()["files"] == {"a": "b"}
    assert "README.md" in scaffold.structure_from(spark, "n", "api", ["go"], lambda p: 1 / 0).first()["files"]
    assert "README.md" in scaffold.structure_from(spark, "n", "api", ["go"]).first()["files"]
    with pytest.raises(ValueError):
        scaffold.structure_from(spark, "n", "api", ["go"], lambda p: "nope")


def test_cache_is_loaded_up_to_its_size(spark):
    rows = spark.createDataFrame([(f"k{k}", "v", float(k), k) for k in range(6)], "key string, value string, expires_at double, access_seq long")
    assert sorted(r["key"] for r in cache.load_valid(rows, 3.0, 2).collect()) == ["k4", "k5"]


def test_progress_rows_and_text(spark):
    files = spark.createDataFrame([("r", f"{k}.py") for k in range(10)] + [("s", "x.py")], "repo string, file_path string")
    failed = spark.createDataFrame([("r", f"{k}.py", "e") for k in range(7)], "repo string, file_path string, error string")
    rows = ingest.progress_of(files, files.where("repo = 'r' AND file_path < '4'"), failed, 80.0)
    told = {r["repo_name"]: r for r in rows.collect()}
    assert told["r"]["processed_files"] == 4 and len(told["r"]["failed_files"]) == 5 and told["r"]["more_failed"] == 2 and told["s"]["failed_files"] is None
    text = [r["x"] for r in render.with_progress(rows.where("repo_name = 'r'")).select(render.progress_report().alias("x")).collect()]
    assert text == ["r: 4 of 10 files (40.0%), about 2m 0s left"]
    counts = spark.createDataFrame([("a", "x", 1), ("a", "y", 3)], "dimension string, value string, n long")
    assert [r["line"] for r in render.stats_lines(counts).collect()] == ["a | y: 3", "a | x: 1"]


def test_ingestion_resumes_and_does_no_file_twice(spark, sf, tmp_path):
    ship(spark)
    source, target, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    files = sync_files(spark, sf).orderBy("ingest_seq").limit(40)
    files.where("ingest_seq < 20").repartition(5).write.parquet(source)
    batches = []
    query = ingest.ingest(spark, source, target, check, files_per_batch=2, on_batch=lambda df, n: batches.append((n, df.count())))
    assert len(batches) == 3 and sum(n for _, n in batches) == 20 and len(ingest.progress(query)) >= 3
    files.where("ingest_seq >= 20").repartition(3).write.mode("append").parquet(source)
    ingest.ingest(spark, source, target, check, files_per_batch=2, on_batch=lambda df, n: batches.append((n, df.count())))
    assert [n for n, _ in batches] == list(range(len(batches))) and sum(n for _, n in batches) == 40
    assert ingest.clear(spark, check) and not ingest.clear(spark, check)


def test_sampled(spark):
    assert ingest.sampled(spark.range(101).withColumnRenamed("id", "i"), 50, "i").count() == 3


def test_stack_of_columns(spark):
    from patternmill.operators.search import split_stack

    assert spark.range(1).select(split_stack(F.lit(" a, b ,c"))).first()[0] == ["a", "b", "c"]


def test_settings_files(tmp_path):
    """The nested keys of a settings file, as YAML and as JSON."""
    import json

    values = {
        "search": {"hybrid_enabled": False, "semantic_weight": 0.5, "keyword_weight": 0.5}, "github": {"include_private": False, "excluded_repos": ["x*"], "cache": {"max_size": 7, "ttl_file_content": 9}},
        "llm": {"provider": "mock", "min_quality_score": 3}, "batch": {"batch_size": 4, "delay_between_batches": 0.5}, "discovery": {"ignored_dirs": ["out"]}, "embeddings": {"model": "BAAI/bge-small-en-v1.5"}, "else": 1,
    }
    (tmp_path / "c.json").write_text(json.dumps(values))
    (tmp_path / "c.yaml").write_text(json.dumps(values))
    for c in (config.from_settings(values), config.from_file(str(tmp_path / "c.json")), config.from_file(str(tmp_path / "c.yaml"))):
        assert (c.search.enabled, c.search.semantic_weight, c.search.keyword_weight, c.search.candidate_cap) == (False, 0.5, 0.5, 50)
        assert (c.batch.batch_size, c.batch.delay, c.batch.max_retries, c.batch.analyze, c.batch.min_quality) == (4, 0.5, 3, False, 3)
        assert c.cache.max_size == 7 and c.cache.ttl_of("content") == 9 and c.cache.ttl_of("tree") == 600 and c.cache.ttl_of("zzz") == 300
        assert c.repos.excluded == ["x*"] and not c.repos.include_private and c.repos.include_orgs and c.ignored_dirs == ["out"] and c.embedding.dimensions() == 384
    assert config.from_settings(None) == config.Config()
    with pytest.raises(ValueError):
        config.BatchConfig(batch_size=0)


class CountingEmbedder:
    """Two dimensions; writes a line for each text it sees."""

    dims = 2

    def __init__(self, log):
        self.log = str(log)

    def column(self, text):
        log = self.log

        @F.pandas_udf("array<float>")
        def run(values: pd.Series) -> pd.Series:
            with open(log, "a") as f:
                f.write("x\n" * len(values))
            return values.map(lambda v: [float(len(v)), 1.0])

        return run(text)

    def query(self, text):
        return [1.0, 0.0]

    def seen(self):
        import os

        return len(open(self.log).readlines()) if os.path.exists(self.log) else 0


def file_rows(spark, sf, n=30):
    return sync_files(spark, sf).orderBy("ingest_seq").limit(n)


def test_sync_embeds_new_points_alone_and_leaves_other_buckets(spark, sf, tmp_path):
    from patternmill.plans.api import PatternBank

    ship(spark)
    counting = CountingEmbedder(tmp_path / "log")
    bank = PatternBank(spark, f"file://{tmp_path}/bank", embedder=counting)
    files = file_rows(spark, sf).cache()
    bank.sync(files)
    first = counting.seen()
    assert first == bank.read().count() > 20
    before = bank.table._folders()
    bank.sync(files.where("ingest_seq < 2"))
    after = bank.table._folders()
    assert counting.seen() == first + 2 and sum(before[b] != after[b] for b in before) <= 2
    assert bank.search("retry handler", limit=3).count() == 3 and len(bank.read().first()["embedding"]) == 2


def test_search_takes_its_weights_from_the_configuration(spark, sf, tmp_path):
    from patternmill.plans.api import PatternBank

    ship(spark)
    own = config.Config(search=config.SearchConfig(semantic_weight=0.2, keyword_weight=0.9, candidate_cap=4))
    bank = PatternBank(spark, f"file://{tmp_path}/bank", config=own)
    bank.sync(file_rows(spark, sf))
    rows = bank.search("import work return", limit=10).collect()
    assert len(rows) == 4 and all(r["hybrid"] == pytest.approx(0.2 * r["semantic"] + 0.9 * r["keyword"]) for r in rows)
    assert bank.search("import work return", limit=10, candidate_cap=None, hybrid=False).count() == 10
    plain = PatternBank(spark, f"file://{tmp_path}/plain", config=config.from_settings({"llm": {"provider": "mock"}}))
    plain.sync(file_rows(spark, sf, 3))
    assert {r["title"] for r in plain.read().collect()} == {"work"}


def test_stream_into_the_bank_with_failures_resume_and_clear(spark, sf, tmp_path):
    from patternmill.operators.scanners import chunks_of
    from patternmill.plans.api import PatternBank

    ship(spark)
    tries = str(tmp_path / "tries")

    def chunker(text, path, language):
        if path.endswith("/3.py"):
            with open(tries, "a") as f:
                f.write("x\n")
            raise ValueError("no good")
        return chunks_of(text, path, language)

    files = file_rows(spark, sf, 30).withColumn("repo", F.lit("me/app")).cache()
    source = f"file://{tmp_path}/in"
    files.where("ingest_seq < 18").repartition(6).write.parquet(source)
    own = config.Config(batch=config.BatchConfig(batch_size=2, max_retries=2, retry_delay=0.0))
    bank = PatternBank(spark, f"file://{tmp_path}/bank", config=own)
    assert bank.progress("me/app").count() == 0
    seen = []
    told = bank.sync_stream(source, "me/app", chunker=chunker, on_batch=lambda p: seen.append(p.first()["processed_files"])).first()
    assert (told["total_files"], told["processed_files"], told["percent"]) == (18, 18, 100.0) and len(seen) == 3 and seen[-1] == 18
    assert [tuple(f) for f in told["failed_files"]] == [("doc/3.py", "ValueError: no good")] and len(open(tries).readlines()) == 2
    assert told["stored_patterns"] == bank.read().count() > 10 and "18 of 18 files" in told["rendered"]
    assert bank.sync_stream(source, "me/app", on_batch=lambda p: seen.append(0)).first()["processed_files"] == 18 and len(seen) == 3
    files.where("ingest_seq >= 18").repartition(3).write.mode("append").parquet(source)
    assert bank.sync_stream(source, "me/app").first()["processed_files"] == 30
    ids = {r["point_id"] for r in bank.read().collect()}
    other = PatternBank(spark, f"file://{tmp_path}/other", config=own)
    other.sync(files.where("file_path <> 'doc/3.py'"))
    assert ids == {r["point_id"] for r in other.read().collect()}
    assert bank.clear_progress("me/app") and not bank.clear_progress("me/app") and bank.progress("me/app").count() == 0
    assert bank.sync_stream(source, "me/app", resume=False).first()["failed_files"] is None and bank.read().count() == len(ids) + 1


def test_a_stream_that_stops_goes_on_where_it_was(spark, sf, tmp_path):
    from patternmill.plans.api import PatternBank

    ship(spark)
    files = file_rows(spark, sf, 20).withColumn("repo", F.lit("r"))
    source = f"file://{tmp_path}/in"
    files.repartition(4).write.parquet(source)
    bank = PatternBank(spark, f"file://{tmp_path}/bank", config=config.Config(batch=config.BatchConfig(batch_size=1)))
    calls = []

    def stop(progress):
        calls.append(progress.first()["processed_files"])
        if len(calls) == 2:
            raise RuntimeError("stop")

    with pytest.raises(Exception, match="stop"):
        bank.sync_stream(source, "r", on_batch=stop)
    assert 0 < bank.progress("r").first()["processed_files"] < 20
    assert bank.sync_stream(source, "r").first()["processed_files"] == 20


def test_cache_store(spark, tmp_path):
    from patternmill.plans.cache_store import CacheStore

    store = CacheStore(spark, f"file://{tmp_path}/cache", config.CacheConfig(max_size=3, ttl={"tree": 10.0}, default_ttl=5.0))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "key string, value string")
    store.put(rows(("tree:a/b", "1"), ("content:a/b:x:1", "2")), "tree", now=100.0)
    store.put(rows(("repo:a", "3")), now=100.0)
    assert store.get("tree:a/b", now=104.0) == "1" and store.get("repo:a", now=105.1) is None and store.get("none", now=104.0) is None
    again = CacheStore(spark, f"file://{tmp_path}/cache", store.config)
    assert sorted(r["key"] for r in again.entries(now=106.0).collect()) == ["content:a/b:x:1", "tree:a/b"] and again.stats(now=106.0) == {"size": 3, "expired": 1, "max_size": 3}
    again.put(rows(("new", "4"), ("tree:a/b", "5")), now=106.0)
    assert {r["key"] for r in again.table.read().collect()} == {"new", "tree:a/b", "repo:a"} and again.get("tree:a/b", now=107.0) == "5"
    assert again.export_files(f"file://{tmp_path}/json", now=107.0) == 2
    (tmp_path / "json" / "bad.json").write_text("{nope")
    (tmp_path / "json" / "old.json").write_text('{"key": "old", "value": "x", "expires_at": 1.0}')
    third = CacheStore(spark, f"file://{tmp_path}/third")
    assert third.import_files(f"file://{tmp_path}/json", now=107.0) == 2 and third.get("new", now=107.0) == "4"
    again.invalidate(repo="a/b")
    assert {r["key"] for r in again.table.read().collect()} == {"new", "repo:a"}
    again.invalidate(prefix="repo")
    again.invalidate(key="new")
    assert again.stats()["size"] == 0
    again.put(rows(("x", "1")), now=1.0)
    again.invalidate()
    off = CacheStore(spark, f"file://{tmp_path}/off", config.CacheConfig(enabled=False))
    off.put(rows(("x", "1")))
    assert again.stats()["size"] == 0 and off.get("x") is None and off.stats()["size"] == 0


def test_cache_as_streaming_state(spark, tmp_path):
    from patternmill.streaming.cache_state import cached

    schema = "key string, seq long, op string, value string, at timestamp"
    batches = [
        [("a", 1, "get", None, 0), ("a", 2, "put", "v", 1), ("a", 3, "get", None, 9), ("b", 4, "put", "w", 2), (None, 5, "get", None, 3)], [("a", 6, "get", None, 11), ("a", 7, "get", None, 12), ("b", 8, "drop", None, 12), ("b", 9, "get", None, 12)],
        [("a", 10, "get", None, 40), ("a", 11, "put", "u", 41), ("a", 12, "get", None, 42)],
    ]
    ship(spark)
    for n, rows in enumerate(batches):
        told = spark.createDataFrame([(*r[:4], 1_000 + r[4]) for r in rows], "key string, seq long, op string, value string, s long")
        told.select("key", "seq", "op", "value", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        query = cached(stream, 10.0).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["seq"]: (r["hit"], r["value"]) for r in spark.read.parquet(f"file://{tmp_path}/out").where("op = 'get'").collect()}
    assert got == {1: (False, None), 3: (True, "v"), 6: (True, "v"), 7: (False, None), 9: (False, None), 10: (False, None), 12: (True, "u")}


def test_trees_by_any_spelling_of_the_root(spark, tmp_path, monkeypatch):
    import os

    from patternmill.sources import files

    home = tmp_path / "my src{1}"
    for path, data in (("a.py", b"x = 1\n"), ("my dir/b.py", b"y\n"), ("node_modules/d.js", b"no"), ("lib/vendor/e.go", b"no"), ("lib/f.ts", b"\xff"), ("i.png", b"\x89")):
        (home / path).parent.mkdir(parents=True, exist_ok=True)
        (home / path).write_bytes(data)
    want = ["a.py", "i.png", "lib/f.ts", "my dir/b.py"]
    for root in (str(home), f"{home}/", f"file:{home}", f"file://{home}", f"file:///{str(home)[1:]}/", os.path.relpath(home, os.getcwd())):
        assert sorted(r["path"] for r in files.tree(spark, root).collect()) == want, root
        assert sorted(r["path"] for r in files.listing(spark, root).collect()) == want, root
    told = {r["path"]: r for r in files.local_files(spark, str(home)).collect()}
    assert sorted(told) == ["a.py", "lib/f.ts", "my dir/b.py"] and told["lib/f.ts"]["error"] == "not UTF-8"
    (home / "none.go").write_bytes(b"")
    assert files.content_at(spark, str(home), "my dir/b.py") == "y\n" and files.content_at(spark, str(home), "none.go") == ""
    assert [files.content_at(spark, str(home), p) for p in ("lib/f.ts", "none.py", "../x", "/etc/hosts")] == [None] * 4
    (tmp_path / "none").mkdir()
    assert files.tree(spark, str(tmp_path / "none")).count() == 0 and files.listing(spark, str(tmp_path / "none")).count() == 0


def test_repository_dump(spark, tmp_path):
    from patternmill.operators import repos
    from patternmill.plans.api import PatternBank

    (tmp_path / "r.json").write_text('{"full_name": "me/a", "name": "a", "private": true, "html_url": "u", "owner": {"login": "me"}, "default_branch": "dev"}\nnope\n{"full_name": "me/dotfiles", "name": "dotfiles", "owner": {"login": "me"}}\n{"full_name": "o/b", "name": "b", "owner": {"login": "o"}}\n')
    rows = repos.repo_listing(spark, f"file://{tmp_path}/r.json")
    assert [tuple(r) for r in rows.where("name = 'a'").collect()] == [("me/a", "a", None, None, True, "dev", "u", "me")]
    bank = PatternBank(spark, f"file://{tmp_path}/bank", config=config.Config(repos=config.RepoConfig(include_orgs=False)))
    assert [r["name"] for r in bank.list_repos(rows, "me").collect()] == ["a"]
    wanted = spark.createDataFrame([("r", "x"), ("r", "y"), ("r", "x")], "repo string, file_path string")
    held = spark.createDataFrame([("r", "x", "old", 1), ("r", "x", "new", 2)], "repo string, file_path string, content string, ingest_seq long")
    from patternmill.sources.files import contents

    assert sorted((r["file_path"], r["content"] or "") for r in contents(held, wanted).collect()) == [("x", "new"), ("x", "new"), ("y", "")]


def test_scaffold_from_patterns_and_a_model(spark, sf, tmp_path):
    from patternmill.plans.api import PatternBank

    ship(spark)
    bank = PatternBank(spark, f"file://{tmp_path}/bank")
    prompts = []

    def ask(prompt):
        prompts.append(prompt)
        return '{"directories": ["d"], "files": {"a.txt": "b"}}'

    bank.scaffold("p", "api", "python, go", ask=ask)
    assert "None yet." in prompts[0] and bank.stats_text().first()["line"].startswith("The bank is empty")
    bank.sync(file_rows(spark, sf, 12))
    made = bank.scaffold("p", "api", "python, go", str(tmp_path / "made"), ask)
    assert [r["path"] for r in made.collect()] == ["d", "a.txt"] and (tmp_path / "made" / "p" / "a.txt").read_text() == "b"
    assert prompts[1].count("### Pattern ") == 5 and "Stack: python, go" in prompts[1]
    assert [r["rank"] for r in bank.gather_patterns("cli", ["go"], 3).orderBy("rank").collect()] == [1, 2, 3]


def test_ends_of_blocks_are_found_in_linear_time():
    import random
    import time

    from patternmill.operators import scanners

    def slow_indent(lines):
        depth = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]

        def end(start):
            last = start
            for k in range(start + 1, len(lines)):
                if depth[k] is not None:
                    if depth[k] <= depth[start]:
                        break
                    last = k
            return last

        return end

    def slow_brace(lines):
        def end(start):
            opened = level = 0
            for k in range(start, len(lines)):
                opened += lines[k].count("{")
                level += lines[k].count("{") - lines[k].count("}")
                if opened and not level:
                    return k
            return len(lines) - 1

        return end

    rng = random.Random(3)
    for _ in range(300):
        lines = [" " * rng.randrange(5) + rng.choice(["x", "", "y{", "}", "{}", "}{", "{{"]) for _ in range(rng.randrange(1, 25))]
        for fast, slow in ((scanners.indent_ends, slow_indent), (scanners.brace_ends, slow_brace)):
            one, two = fast(lines), slow(lines)
            assert all(one(k) == two(k) for k in range(len(lines)) if lines[k].strip()), lines
    text = "\n".join(f"def f{k}():\n    a = {{" for k in range(60_000))
    begin = time.time()
    scanners.chunks_of(text, "a.py", "python")
    scanners.chunks_of(text, "a.js", "javascript")
    assert time.time() - begin < 10


def test_files_that_fail_are_rows(spark):
    from patternmill.operators import scanners

    ship(spark)
    files = spark.createDataFrame([("a", "x\n" * 6), ("b", "bad"), ("c", None)], "file_path string, content string").withColumn("language", F.lit("go"))

    def chunker(text, path, language):
        if text == "bad":
            raise KeyError("odd")
        return scanners.chunks_of(text, path, language)

    rows = {r["file_path"]: r for r in scanners.extracted(files, chunker=chunker, retries=2, delay=0.0).collect()}
    assert rows["a"]["error"] is None and rows["a"]["chunk_type"] == "file" and rows["b"]["error"] == "KeyError: 'odd'" and rows["b"]["content"] is None and "c" not in rows


def test_generated_projects_hold_these_files():
    """The contents of generated files are fixed; a change of one shows here."""
    import hashlib
    import json

    told = {k: scaffold.template("my-app", kind, stack) for k, (kind, stack) in {"py": ("cli", ["python"]), "api": ("api", ["Python", "FastAPI"]), "node": ("web-app", ["node"]), "java": ("library", ["java"]), "none": ("x", ["rust"])}.items()}
    digest = hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
    assert told["api"][1]["requirements.txt"] == "fastapi>=0.100.0\nuvicorn>=0.23.0\n" and told["java"][1]["pom.xml"].count("my-app") == 1
    assert digest == "cafbf93db0e83f294665f0230892d3e1ab393250974217efef264d26d5f811a5"


def test_replies_that_stopped_the_job(spark):
    from patternmill.functions import replies

    told = ['{"title": "T", "quality_score": 99999999999}', '{"title": "T", "quality_score": -1e30, "is_pattern": 1}', '{"title": "T", "is_pattern": 0}', '{"title": "T", "is_pattern": "false", "quality_score": true}', '{"title": "T", "is_pattern": []}', '{"title": "T", "is_pattern": null}']
    rows = spark.createDataFrame([(t,) for t in told], "t string").select(replies.analysis_of(F.col("t")).alias("a")).select("a.quality_score", "a.is_pattern").collect()
    assert [tuple(r) for r in rows] == [(10, False), (1, True), (5, False), (1, True), (5, False), (5, False)]
