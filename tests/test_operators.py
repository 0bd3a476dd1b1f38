"""Operators on small tables: edges, order of steps, invariants."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patternmill.functions import paths, render, text
from patternmill.operators import analyze, bank, cache, repos, scaffold, search, stats, validate
from patternmill.operators.scanners import SCRIPT, blocks, brace_ends, chunks_of, indent_ends
from patternmill.plans import sync as plan
from patternmill.plans.api import PatternBank, embedding_info
from patternmill.sources.tables import BankTable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_brace_block_ends():
    assert brace_ends(["f {", "x", "}"])(0) == 2
    assert brace_ends(["a {", " if {", "  x", " }", " b", "c", "}", "d"])(0) == 6
    assert brace_ends(["f {", "x", "y"])(0) == 2
    assert brace_ends(["f", "x"])(0) == 1
    assert brace_ends(["s = '{'", "x", "}", "y"])(0) == 2


def test_indent_block_ends():
    assert indent_ends(["def a():", "  x", "", "", "b"])(0) == 1
    assert indent_ends(["def a():", "", ""])(0) == 0


def test_a_short_block_is_passed_over_whole():
    lines = ["function a() {", "  class B {", "  }", "}", "function c() {", "1", "2", "3", "}"]
    assert [(c.name, c.start_line) for c in blocks(lines, SCRIPT)] == [("c", 5)]


@pytest.mark.parametrize("n", [4, 5, 150, 151, 160, 290, 291, 431])
def test_file_parts_cover_all_lines(n):
    found = chunks_of("\n".join(f"line {k}" for k in range(n)), "x/a.b.go", "go")
    assert bool(found) == (n >= 5)
    if n >= 5:
        assert found[0].start_line == 1 and found[-1].end_line == n
        assert all(b.start_line == a.start_line + 140 for a, b in zip(found, found[1:], strict=False))
        assert found[0].name == ("a.b" if n <= 150 else "a.b_part1")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}@ \nabc():", max_size=80), st.sampled_from(["python", "java", "javascript", "go"]))
def test_chunks_are_slices_of_the_file(content, language):
    lines, end = content.split("\n"), 0
    for c in chunks_of(content, "a.x", language):
        assert c.content == "\n".join(lines[c.start_line - 1 : c.end_line])
        assert c.start_line > end
        end = c.end_line if c.chunk_type != "file_part" else end


def test_ids_and_nulls(spark):
    import hashlib

    inner = hashlib.md5(b"x").hexdigest()[:8]
    assert one(spark, bank.point_id(F.lit("r"), F.lit(None), F.lit("x"))) == hashlib.md5(f"r::{inner}".encode()).hexdigest()


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "point_id string, ingest_seq long, document string")
    new = spark.createDataFrame([("a", 3, "z"), ("a", 4, "w"), ("c", 5, "v")], old.schema)
    once = bank.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 4, "w"), ("b", 2, "y"), ("c", 5, "v")]
    assert sorted(map(tuple, bank.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_partial_update_keeps_what_is_empty(spark):
    rows = spark.createDataFrame([("a", "t", "d", "other", 4), ("b", "t", "d", None, 4)], "point_id string, title string, description string, category string, quality_score int")
    new = spark.createDataFrame([("a", "", "n", "testing", 0), ("b", "n", "n", "unknown", 9)], rows.schema)
    assert sorted(map(tuple, bank.partial_update(rows, new).collect())) == [("a", "t", "n", "testing", 4), ("b", "t", "d", None, 4)]


@pytest.mark.parametrize("name, suffix", [("a.py", ".py"), (".bashrc", ""), ("a.tar.gz", ".gz"), ("x", ""), ("d/.x.py", ".py")])
def test_suffix(spark, name, suffix):
    assert one(spark, paths.suffix(F.lit(name))) == suffix


def test_ignored_folders(spark):
    assert one(spark, paths.in_ignored_dir(F.lit("a/bin/x.py"))) and not one(spark, paths.in_ignored_dir(F.lit("a/bin")))
    assert one(spark, paths.in_ignored_dir(F.lit("a/bin"), F.lit(True)))


def test_globs(spark):
    import fnmatch

    for name in ("dotfiles", "archived-x", "a.github.io", "xdotfiles", "dotfiles\n", "[a]", "b"):
        for p in ("dotfiles", "archived-*", "*.github.io", "[!a]", "?"):
            assert one(spark, F.lit(name).rlike(paths.glob_regex(p))) == fnmatch.fnmatchcase(name, p), (name, p)


def test_keyword_score_and_occurrences(spark):
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2 and one(spark, text.occurrences(F.lit("a"), F.lit(""))) == 0
    assert one(spark, text.keyword_score(F.lit("x"), F.array().cast("array<string>"))) == 0
    assert search.query_keywords("Retry retry the handler with handler Retry a1") == ["retry", "handler"]


def test_windows_refuse_overlap(spark):
    with pytest.raises(ValueError):
        text.char_windows(F.lit("x"), 10, 10)
    assert len(one(spark, text.char_windows(F.lit("a" * 500), 20, 5))) == 9


def test_hybrid_cap_and_plain(spark):
    rows = spark.createDataFrame([(f"p{k}", "class Handler " * k, [1.0, k / 100.0], 5) for k in range(70)], "point_id string, document string, embedding array<float>, quality_score int")
    assert search.hybrid_top(rows, "handler", [1.0, 0.0], 60).count() == 50
    assert search.hybrid_top(rows, "handler", [1.0, 0.0], 60, None).count() == 60
    assert search.hybrid_top(rows, "", [1.0, 0.0], 3, enabled=False).count() == 3
    assert search.matching(rows.withColumn("quality_score", F.lit(None).cast("int")), min_quality=2).count() == 0


def test_progress(spark):
    rows = spark.createDataFrame([(0, 0, 0.0), (100, 25, 50.0), (10, 0, 5.0)], "total_files int, processed_files int, elapsed_s double")
    assert [tuple(r)[3:] for r in render.with_progress(rows).collect()] == [(0.0, 0.0), (25.0, 150.0), (0.0, 0.0)]
    assert one(spark, render.elapsed(F.lit(125.7))) == "2m 5s" and one(spark, render.elapsed(F.lit(3.25))) in ("3.2s", "3.3s")


def test_cache_steps(spark):
    rows = spark.createDataFrame([(f"k:{k}", str(k), 100.0 + k, k) for k in range(5)], "key string, value string, expires_at double, access_seq long")
    more = spark.createDataFrame([("k:1", "new", 200.0, 9)], rows.schema)
    kept = {r["key"]: r["value"] for r in cache.put(rows, more, 3).collect()}
    assert kept == {"k:1": "new", "k:4": "4", "k:3": "3"}
    assert cache.lookup(rows, "k:0", 100.0).count() == 1 and cache.lookup(rows, "k:0", 100.1).count() == 0
    assert cache.without_prefix(rows, "k").count() == 0 and cache.without_key(rows, "k:0").count() == 4
    with pytest.raises(ValueError):
        cache.keep_recent(rows, 0)
    more = spark.createDataFrame([("tree:a/b", "", 0.0, 0), ("content:a/b:x", "", 0.0, 0), ("tree:a/bc", "", 0.0, 0)], rows.schema)
    assert [r["key"] for r in cache.without_repo(more, "a/b").collect()] == ["tree:a/bc"]


def test_outcomes_add_up(spark):
    rows = spark.createDataFrame([("d", "t", None, "en", "p"), ("", "t", "other", "go", "p"), ("d", None, "other", None, None)], "document string, title string, category string, language string, source_path string")
    told = stats.outcome_counts(stats.relabelled(analyze.chunk_of(rows), analyze.mock_analysis())).first().asDict()
    assert told == {"processed": 3, "updated": 1, "unchanged": 1, "skipped": 1, "failed": 0}


def test_fallback_on_empty(spark):
    rows = spark.createDataFrame([(1, "r", "a.py", "python", "short", "class", None)], "ingest_seq long, repo string, file_path string, language string, content string, chunk_type string, name string")
    assert analyze.patterns_or_fallback(rows, analyze.mock_analysis()).count() == 0
    assert analyze.patterns_or_fallback(rows, analyze.mock_analysis(), fallback="on_empty").first()["title"] == "Pattern from a.py"
    assert analyze.patterns_or_fallback(rows, None).count() == 1


def test_scaffold_families_and_writer(spark, tmp_path):
    assert [scaffold.family(s) for s in (["Python", "java"], ["node", "java"], ["JAVA"], ["rust"])] == ["python", "node", "java", "generic"]
    root = scaffold.write_project(scaffold.scaffold(spark, "my-app", "web-app", "java"), str(tmp_path))
    assert "package com.myapp;" in open(f"{root}/src/main/java/com/myapp/Application.java").read()
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            scaffold.write_project(spark.createDataFrame([("p", [], {bad: "x"})], scaffold.STRUCTURE), str(tmp_path))


def test_validators(spark):
    rows = spark.createDataFrame([("a/b-c.d", 5, "x", "api", "abc"), ("a b/c", 11, "", "ap", "ab")], "repo_name string, min_quality int, project_name string, project_type string, tech_stack string")
    assert [r["x"] for r in rows.select(F.array_join(validate.sync_errors(), ",").alias("x")).collect()] == ["", "repo_name,min_quality"]
    assert [r["x"] for r in rows.select(F.array_join(validate.scaffold_errors(), ",").alias("x")).collect()] == ["", "project_name,project_type,tech_stack"]


def test_repos_and_prompt(spark):
    rows = spark.createDataFrame([("me/a", "a", True, "me", None, "main", None), ("o/archived-x", "archived-x", False, "o", "go", "dev", "d")], "full_name string, name string, is_private boolean, owner string, language string, default_branch string, description string")
    assert [r["rendered"] for r in rows.select(render.repo_entry().alias("rendered")).collect()][0] == "**me/a** ([PRIVATE])\n  Language: Unknown | Branch: main\n  No description\n\n"
    assert repos.listed(rows).count() == 1 and repos.listed(rows, "me", False, False, []).count() == 0
    chunk = spark.createDataFrame([("go", "f.go", "", "x {code}")], "language string, file_path string, context string, content string")
    assert chunk.select(render.analysis_prompt("{language}|{file_path}|{context}|{code}").alias("p")).first()["p"] == "go|f.go|N/A|x {code}"


def test_batches_over_blocks(spark):
    rows = spark.createDataFrame([("a" if k % 3 else None, k) for k in range(200)], "repo string, ingest_seq long")
    got = {}
    for r in repos.batches(rows, size=7, block=20).collect():
        got.setdefault(r["repo"], []).append((r["ingest_seq"], r["batch_no"]))
    assert all([b for _, b in sorted(v)] == [k // 7 for k in range(len(v))] for v in got.values()) and len(got) == 2


def test_bank_table_versions(spark, tmp_path):
    t = BankTable(spark, f"file://{tmp_path}/bank")
    t.create()
    t.create()
    assert t.count() == 0 and len(t.versions()) == 1
    t.replace(t.read().unionByName(spark.createDataFrame([("p", "d")], "point_id string, document string"), allowMissingColumns=True))
    assert t.count() == 1
    t.restore(0)
    assert t.count() == 0 and t.read(1).count() == 1


def test_bank_from_end_to_end(spark, tmp_path):
    from patternmill.session import ship

    ship(spark)
    home = tmp_path / "repo"
    (home / "src").mkdir(parents=True)
    body = "import os\n\n\nclass Handler:\n" + "".join(f"    def step_{k}(self):\n        return 'retry the request {k}'\n" for k in range(6))
    (home / "src/handler.py").write_text(body)
    (home / "src/small.py").write_text("x = 1\n")
    b = PatternBank(spark, f"file://{tmp_path}/bank")
    told = b.sync_folder(str(home), "me/app").first().asDict()
    assert told == {"repo": "me/app", "files": 2, "chunks": 1, "stored": 1, "distinct_points": 1, "failed": 0}
    b.sync_folder(str(home), "me/app")
    assert b.read().count() == 1
    hit = b.search("retry handler", min_quality=5).first()
    assert hit["title"] == "Pattern from Handler" and hit["keyword"] > 0 and "### 1. Pattern from Handler" in hit["rendered"]
    bad = b.store(spark.createDataFrame([("0123456789", "abc", "0123456789", "Testing", "Python"), ("x", "abc", "0123456789", "nope", "go")], "content string, title string, description string, category string, language string"))
    assert bad.select(F.array_join("errors", ",")).first()[0] == "content,category" and b.read().count() == 2
    assert {(r["dimension"], r["value"]): r["n"] for r in b.stats().collect()}["language", "python"] == 2
    assert b.recategorize("testing", dry_run=True).first()["updated"] == 1 and b.recategorize(dry_run=False).first()["processed"] == 2
    assert [r["category"] for r in b.category_stats().collect()] == ["other"]
    assert b.discover(str(home)) == 4 and b.rebuild() > 0
    assert b.scaffold("app", "cli", "rust").where("kind = 'file'").count() == 1
    with pytest.raises(ValueError):
        b.search("ab")
    with pytest.raises(ValueError):
        b.recategorize("nope")
    assert embedding_info(spark).count() == 5


def test_summary_counts_writes_and_points(spark):
    files = spark.createDataFrame([("r", "a.py", "python", "", 1)], "repo string, file_path string, language string, content string, ingest_seq long")
    _, new, chunks = plan.sync(files, spark.createDataFrame([], "point_id string, ingest_seq long"), None)
    assert plan.summary(files, chunks, new).first().asDict() == {"repo": "r", "files": 1, "chunks": 0, "stored": 0, "distinct_points": 0}
