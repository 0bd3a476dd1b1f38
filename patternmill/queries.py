"""The registered queries of the bank's operators, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternmill.config import CacheConfig, from_settings
from patternmill.functions import paths, render, replies, sql as sql_functions, text
from patternmill.operators import analyze, bank, cache, chunking, remote, repos, scaffold, scanners, search, stats, validate
from patternmill.plans import sync as plan
from patternmill.plans.api import embedding_info as model_info
from patternmill.plans.cache_store import CacheStore
from patternmill.schema import CATEGORIES, EXCLUDED_REPOS, EXTENSIONS, IGNORED_DIRS, LANGUAGES, LOCAL_IGNORED_DIRS
from patternmill.session import fresh_path, ship, stored
from patternmill.sources import files as trees
from patternmill.sources.derived import ClusteredBank
from patternmill.sources.tables import BankTable, CacheTable
from patternmill.sources.vector_index import VectorIndex, recall
from patternmill.streaming import ingest
from patternmill.streaming.cache_state import cached

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BANK = """bank AS (
  SELECT d.doc_id AS ingest_seq, md5(concat(d.source, ':', 'doc/', d.doc_id, '.txt', ':', substr(md5(d.text), 1, 8))) AS point_id,
    d.text AS document, concat('doc_', d.doc_id) AS title, d.lang AS language,
    CASE d.doc_id % 10 WHEN 0 THEN 'architecture' WHEN 1 THEN 'error_handling' WHEN 2 THEN 'configuration' WHEN 3 THEN 'testing' WHEN 4 THEN 'api_design'
      WHEN 5 THEN 'data_access' WHEN 6 THEN 'security' WHEN 7 THEN 'logging' WHEN 8 THEN 'utilities' ELSE 'other' END AS category,
    CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(1 + d.n_chars % 10 AS INTEGER) END AS quality_score,
    d.source AS source_repo, concat('doc/', d.doc_id, '.txt') AS source_path
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

EXTS = [".py", ".PY", ".java", ".js", ".ts", ".tsx", ".md", ".go", ""]
DIRS = ["src", "node_modules", "lib/core", "vendor/a", "deps", "app/build", ".git"]
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
FILES = f"""files AS (
  SELECT doc_id AS ingest_seq, source AS repo, text AS content,
    concat(({_list(DIRS)})[CAST(doc_id % {len(DIRS)} AS INTEGER) + 1], '/doc', doc_id, ({_list(EXTS)})[CAST(doc_id % {len(EXTS)} AS INTEGER) + 1]) AS path
  FROM documents)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    path = F.concat(pick(DIRS), F.lit("/doc"), F.col("doc_id").cast("string"), pick(EXTS))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ingest_seq"), F.col("source").alias("repo"), F.col("text").alias("content"), path.alias("path"))


# Ids, payload, upserts


@query(f"WITH {BANK} SELECT ingest_seq, point_id FROM bank")
def point_id(spark, sf):
    return bank.document_bank(spark, sf).select("ingest_seq", "point_id")


@query(f"WITH {BANK} SELECT ingest_seq, title, category, language, quality_score, source_repo, source_path, substr(document, 1, 500) AS preview FROM bank")
def payload_projection(spark, sf):
    return bank.payload(bank.document_bank(spark, sf))


@query(
    "WITH p AS (SELECT md5(concat(source, ':', 'doc', ':', substr(md5(text), 1, 8))) AS point_id, doc_id AS ingest_seq FROM documents) SELECT point_id, max(ingest_seq) AS ingest_seq FROM p GROUP BY point_id"
)
def upsert_last_wins(spark, sf):
    rows = table(spark, sf, "documents").select(bank.point_id(F.col("source"), F.lit("doc"), F.col("text")).alias("point_id"), F.col("doc_id").alias("ingest_seq"))
    return bank.upsert(rows.limit(0), rows)


@query(
    f"""WITH {BANK}, both_versions AS (
  SELECT source_repo, point_id FROM bank UNION ALL
  SELECT source_repo, md5(concat(source_repo, ':', source_path, ':', substr(md5(concat(document, ' v2')), 1, 8))) FROM bank)
SELECT source_repo, count(*) AS n_rows, count(DISTINCT point_id) AS n_points FROM both_versions GROUP BY source_repo"""
)
def upsert_versions_kept(spark, sf):
    old = bank.document_bank(spark, sf).select("source_repo", "source_path", "document", "ingest_seq", "point_id")
    new = plan.points(old.drop("point_id").withColumn("document", F.concat("document", F.lit(" v2"))))
    merged = bank.upsert(old, new.select(*old.columns))
    return merged.groupBy("source_repo").agg(F.count("*").alias("n_rows"), F.count_distinct("point_id").alias("n_points"))


@query(
    f"""WITH {BANK}, u AS (
  SELECT point_id, CASE WHEN ingest_seq % 3 = 0 THEN '' ELSE concat('new ', title) END AS title,
    CASE WHEN language = 'en' THEN 'security' ELSE category END AS category, 7 AS quality_score FROM bank)
SELECT ingest_seq, CASE WHEN u.category <> b.category AND u.title <> '' THEN u.title ELSE b.title END AS title, u.category AS category,
  CASE WHEN u.category <> b.category THEN u.quality_score ELSE b.quality_score END AS quality_score
FROM bank b JOIN u ON b.point_id = u.point_id"""
)
def partial_update(spark, sf):
    b = bank.document_bank(spark, sf).select("ingest_seq", "point_id", "title", "language", "category", "quality_score")
    updates = b.select(
        "point_id",
        F.when(F.col("ingest_seq") % 3 == 0, "").otherwise(F.concat(F.lit("new "), "title")).alias("title"),
        F.when(F.col("language") == "en", "security").otherwise(F.col("category")).alias("category"),
        F.lit(7).alias("quality_score"),
    )
    return bank.partial_update(b, updates).select("ingest_seq", "title", "category", "quality_score")


@query(f"WITH {BANK} SELECT point_id, title FROM bank WHERE point_id > '8' ORDER BY point_id LIMIT 500")
def scroll_page(spark, sf):
    return bank.scroll(bank.document_bank(spark, sf), "8", 500, ["point_id", "title"])


# Files and repositories

_EXT = r"regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]+)$', 1)"
_LANG = "CASE lower(ext) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go' ELSE 'unknown' END"


@query(f"WITH {FILES}, e AS (SELECT ingest_seq, path, {_EXT} AS ext FROM files) SELECT ingest_seq, ext, {_LANG} AS language FROM e")
def language_from_ext(spark, sf):
    return file_rows(spark, sf).select("ingest_seq", paths.suffix(F.col("path")).alias("ext"), paths.language_of(F.col("path")).alias("language"))


@query(f"WITH {FILES}, e AS (SELECT ingest_seq, path, {_EXT} AS ext FROM files) SELECT ingest_seq, path FROM e WHERE ext IN ('.py', '.java', '.js', '.ts', '.tsx', '.jsx', '.go')")
def code_file_filter(spark, sf):
    return file_rows(spark, sf).where(paths.is_code_file(F.col("path"))).select("ingest_seq", "path")


@query(
    f"WITH {FILES} SELECT ingest_seq, path FROM files WHERE NOT regexp_matches(path, '(^|/)(\\.git|node_modules|venv|__pycache__|dist|build|target|\\.idea|\\.vscode|vendor|deps|\\.gradle|bin|obj)/')"
)
def ignored_dirs(spark, sf):
    return file_rows(spark, sf).where(~paths.in_ignored_dir(F.col("path"))).select("ingest_seq", "path")


REPOS = """repos AS (
  SELECT source, CASE WHEN source IN ('src1', 'src2') THEN concat('archived-', source) WHEN source = 'src3' THEN 'dotfiles' WHEN source = 'src4' THEN 'team.github.io' ELSE source END AS name,
    length(source) = 5 AS is_private, CASE WHEN source < 'src5' THEN 'me' ELSE 'org' END AS owner,
    CASE WHEN source = 'src0' THEN NULL ELSE 'python' END AS language, 'main' AS default_branch, CASE WHEN source = 'src7' THEN '' ELSE concat('All of ', source) END AS description
  FROM (SELECT DISTINCT source FROM documents))"""


def repo_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The sources as repositories that a service describes, through P4; html_url names the source."""
    s = F.col("source")
    name = F.when(s.isin("src1", "src2"), F.concat(F.lit("archived-"), s)).when(s == "src3", "dotfiles").when(s == "src4", "team.github.io").otherwise(s)
    raw = table(spark, sf, "documents").select("source").distinct().select(
        F.concat(F.lit("me/"), name).alias("full_name"), name.alias("name"), F.when(s == "src7", "").otherwise(F.concat(F.lit("All of "), s)).alias("description"), F.when(s != "src0", "python").alias("language"),
        F.when(F.length(s) == 5, True).alias("private"), F.lit(None).cast("string").alias("default_branch"), s.alias("html_url"), F.struct(F.when(s < "src5", "me").otherwise("org").alias("login")).alias("owner"),
    )
    return repos.repo_info(raw).withColumn("source", F.col("url"))


@query(f"WITH {REPOS} SELECT source, name, owner FROM repos WHERE NOT is_private AND owner = 'me'")
def repo_visibility_filter(spark, sf):
    return repos.listed(repo_rows(spark, sf), "me", False, False, []).select("source", "name", "owner")


@query(f"WITH {REPOS} SELECT source, name FROM repos WHERE NOT (name GLOB 'dotfiles' OR name GLOB 'archived-*' OR name GLOB '*.github.io')")
def repo_glob_exclude(spark, sf):
    return repos.listed(repo_rows(spark, sf), excluded=EXCLUDED_REPOS).select("source", "name")


@query("SELECT source AS repo, count(*) AS n_files, CASE WHEN count(*) > 50 THEN 'batch' ELSE 'single' END AS route FROM documents GROUP BY source")
def repo_routing_over_50(spark, sf):
    return repos.routes(file_rows(spark, sf))


@query(
    """WITH n AS (SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 10) AS INTEGER) AS batch_no FROM documents)
SELECT source AS repo, batch_no, count(*) AS n_files, min(doc_id) AS first_seq, max(doc_id) AS last_seq FROM n GROUP BY source, batch_no"""
)
def file_batches_of_10(spark, sf):
    numbered = repos.batches(file_rows(spark, sf).select("repo", "ingest_seq"))
    return numbered.groupBy("repo", "batch_no").agg(F.count("*").alias("n_files"), F.min("ingest_seq").alias("first_seq"), F.max("ingest_seq").alias("last_seq"))


@query(
    rf"""WITH {REPOS} SELECT source, concat('**', 'me/', name, '** (', CASE WHEN is_private THEN '[PRIVATE]' ELSE '[PUBLIC]' END, ')', chr(10), '  Language: ', coalesce(language, 'Unknown'), ' | Branch: ', default_branch, chr(10), '  ',
  coalesce(nullif(description, ''), 'No description'), chr(10), chr(10)) AS rendered FROM repos"""
)
def repo_list_rendered(spark, sf):
    return repo_rows(spark, sf).select("source", render.repo_entry().alias("rendered"))


@query(f"WITH {REPOS} SELECT concat('me/', name) AS full_name, name, description, language, is_private, default_branch, source AS url, owner FROM repos")
def repo_scan(spark, sf):
    """A dump of repositories written as JSON lines and read back."""
    home = fresh_path(spark, "repos")
    rows = repo_rows(spark, sf)
    raw = rows.select("full_name", "name", "description", "language", F.col("is_private").alias("private"), "default_branch", F.col("url").alias("html_url"), F.struct(F.col("owner").alias("login")).alias("owner"))
    raw.write.json(home)
    return repos.repo_listing(spark, home)


# Search

QUESTION = "class Handler returns the token of and the the request in this function"
WORDS = search.query_keywords(QUESTION)
_SEMANTIC = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"
VECTORS = f"vectors AS (SELECT b.*, {_SEMANTIC} AS semantic FROM bank b JOIN embeddings e ON e.vec_id = b.ingest_seq)"
_HIT = "least(CAST(1.0 AS DOUBLE), CAST(0.3 AS DOUBLE) * ((length(lower(document)) - length(replace(lower(document), '{k}', ''))) // {n}))"
KEYWORD = "least(CAST(1.0 AS DOUBLE), (" + " + ".join(["CAST(0 AS DOUBLE)", *(_HIT.format(k=k, n=len(k)) for k in WORDS)]) + f") / {len(WORDS)})"


def vector_bank(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ingest_seq"), "embedding")
    return bank.document_bank(spark, sf).join(vectors, "ingest_seq")


def _hybrid_sql(k: int, where: str = "TRUE", weights: tuple[float, float] = (0.7, 0.3)) -> str:
    return f"""WITH {BANK}, {VECTORS}, cand AS (SELECT * FROM vectors WHERE {where} ORDER BY semantic DESC, point_id LIMIT {min(3 * k, 50)}),
rk AS (SELECT *, row_number() OVER (ORDER BY semantic DESC, point_id) AS srank, {KEYWORD} AS keyword FROM cand),
h AS (SELECT *, CAST({weights[0]} AS DOUBLE) * semantic + CAST({weights[1]} AS DOUBLE) * keyword AS hybrid FROM rk),
top AS (SELECT *, row_number() OVER (ORDER BY hybrid DESC, srank) AS rank FROM h ORDER BY hybrid DESC, srank LIMIT {k})
"""


_TOP = "SELECT CAST(rank AS INTEGER) AS rank, point_id, round(semantic, 9) AS semantic, round(keyword, 9) AS keyword, round(hybrid, 9) AS hybrid FROM top"


def _top(df: DataFrame) -> DataFrame:
    return df.select("rank", "point_id", F.round("semantic", 9).alias("semantic"), F.round("keyword", 9).alias("keyword"), F.round("hybrid", 9).alias("hybrid"))


@query(_hybrid_sql(10, "language = 'en' AND quality_score >= 5") + _TOP)
def search_hybrid_topk(spark, sf):
    found = search.matching(vector_bank(spark, sf), "en", None, 5)
    return _top(search.hybrid_top(found, QUESTION, search.vector_of(spark, sf, 0), 10))


@query(_hybrid_sql(60) + _TOP)
def search_hybrid_limit_cap(spark, sf):
    return _top(search.hybrid_top(vector_bank(spark, sf), QUESTION, search.vector_of(spark, sf, 0), 60))


WEIGHTS = {"search": {"semantic_weight": 0.25, "keyword_weight": 0.6}}


@query(_hybrid_sql(10, "quality_score >= 3", (0.25, 0.6)) + _TOP)
def search_hybrid_weights(spark, sf):
    """Weights from a configuration."""
    own = from_settings(WEIGHTS).search
    found = search.matching(vector_bank(spark, sf), min_quality=3)
    return _top(search.hybrid_top(found, QUESTION, search.vector_of(spark, sf, 0), 10, own.candidate_cap, own.enabled, own.semantic_weight, own.keyword_weight))


@query(
    f"""WITH {BANK}, v AS (SELECT b.*, CASE WHEN ingest_seq % 4 = 1 THEN NULL ELSE {_SEMANTIC} END AS semantic FROM bank b JOIN embeddings e ON e.vec_id = b.ingest_seq WHERE b.ingest_seq < 40),
rk AS (SELECT *, row_number() OVER (ORDER BY semantic DESC NULLS LAST, point_id) AS srank, {KEYWORD} AS keyword FROM v),
h AS (SELECT *, CAST(0.7 AS DOUBLE) * coalesce(semantic, 1) + CAST(0.3 AS DOUBLE) * keyword AS hybrid FROM rk)
SELECT CAST(row_number() OVER (ORDER BY hybrid DESC, srank) AS INTEGER) AS rank, point_id, round(hybrid, 9) AS hybrid FROM h ORDER BY hybrid DESC, srank LIMIT 20"""
)
def search_null_vectors(spark, sf):
    """Rows without a similarity count as 1 in the reranking; 40 rows, so that all are candidates."""
    some = vector_bank(spark, sf).where("ingest_seq < 40").withColumn("embedding", F.when(F.col("ingest_seq") % 4 != 1, F.col("embedding")))
    return search.hybrid_top(some, QUESTION, search.vector_of(spark, sf, 0), 20, None).select("rank", "point_id", F.round("hybrid", 9).alias("hybrid"))


@query(_hybrid_sql(5) + "SELECT point_id, round(semantic, 9) AS semantic, CAST(srank AS INTEGER) AS rank FROM rk WHERE srank <= 5")
def gather_patterns(spark, sf):
    """The nearest patterns, without filter or reranking."""
    top = search.semantic_top(vector_bank(spark, sf), search.vector_of(spark, sf, 0), 5)
    return top.select("point_id", F.round("semantic", 9).alias("semantic"), F.row_number().over(Window.orderBy(F.desc("semantic"), "point_id")).alias("rank"))


@query(f"WITH {BANK}, {VECTORS} SELECT point_id, round(semantic, 9) AS semantic FROM vectors WHERE quality_score >= 5 ORDER BY vectors.semantic DESC, point_id LIMIT 10")
def search_semantic_topk(spark, sf):
    top = search.semantic_top(search.matching(vector_bank(spark, sf), min_quality=5), search.vector_of(spark, sf, 0), 10)
    return top.select("point_id", F.round("semantic", 9).alias("semantic"))


def indexed(spark: SparkSession, sf: str, cells: int | None = None) -> VectorIndex:
    """An index over all vectors of the embeddings table, each a point of a bank."""
    home = fresh_path(spark, "index")
    v = F.col("vec_id")
    points = table(spark, sf, "embeddings").select(F.concat(F.lit("vec_"), F.lpad(v.cast("string"), 12, "0")).alias("point_id"), F.col("embedding").cast("array<float>").alias("embedding"), v.alias("ingest_seq"))
    own = BankTable(spark, f"{home}/bank")
    own.replace(points)
    index = VectorIndex(spark, f"{home}/index")
    index.build(own, cells)
    return index


_NEAR = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12)"
_VEC = "concat('vec_', lpad(CAST(vec_id AS VARCHAR), 12, '0'))"
_MANY = f"""near AS (SELECT a.vec_id AS query_id, concat('vec_', lpad(CAST(b.vec_id AS VARCHAR), 12, '0')) AS point_id, {_NEAR} AS semantic FROM embeddings a JOIN embeddings b ON TRUE WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, point_id) AS rank FROM near)"""


@query(f"SELECT {_VEC} AS point_id, round({_NEAR.replace('b.embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 9) AS semantic FROM embeddings a ORDER BY semantic DESC, point_id LIMIT 10")
def search_index_topk(spark, sf):
    """The best ten through an index that reads only the cells which can hold one of them."""
    return indexed(spark, sf).search(search.vector_of(spark, sf, 0), 10).select("point_id", F.round("semantic", 9).alias("semantic"))


@query(f"WITH {_MANY} SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, round(semantic, 9) AS semantic FROM ranked WHERE rank <= 10")
def search_index_many(spark, sf):
    """The best ten of each vector whose number 20 divides, against all vectors, in blocks by cell; all cells are probed."""
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return indexed(spark, sf).search_many(asked, 10).select("query_id", "rank", "point_id", F.round("semantic", 9).alias("semantic"))


@query("SELECT count(*) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0")
def search_index_recall(spark, sf):
    """Of the best ten of each such vector, at least 95 in 100 are found when 80 % of the cells are probed; these vectors hardly cluster."""
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = indexed(spark, sf)
    some = max(1, round(0.8 * len(index.centroids())))
    return recall(index.search_many(asked, 10, some), index.search_many(asked, 10)).select("queries", (F.col("recall") >= 0.95).alias("enough"))


@query(f"WITH {BANK} SELECT ingest_seq, title FROM bank WHERE language = 'en' AND category = 'security' AND quality_score >= 5")
def search_filter_lang_cat_quality(spark, sf):
    return search.matching(bank.document_bank(spark, sf), "EN", "security", 5).select("ingest_seq", "title")


@query(f"WITH {BANK} SELECT ingest_seq, title FROM bank WHERE language = 'en' AND category = 'security' AND quality_score >= 5")
def search_filter_clustered(spark, sf):
    """The same from the layout by language and category, of which only the folders that may hold such rows are read."""
    home = fresh_path(spark, "clustered")
    own, clusters = BankTable(spark, f"{home}/bank"), ClusteredBank(spark, f"{home}/clustered")
    own.replace(bank.document_bank(spark, sf))
    clusters.build(own)
    return search.matching(clusters.candidates("EN", "security", 5), "EN", "security", 5).select("ingest_seq", "title")


@query(f"WITH {BANK} SELECT ingest_seq, quality_score FROM bank")
def search_min_quality_1(spark, sf):
    return search.matching(bank.document_bank(spark, sf), min_quality=1).select("ingest_seq", "quality_score")


@query(
    _hybrid_sql(10, "quality_score >= 5")
    + """SELECT CAST(rank AS INTEGER) AS rank, concat('### ', rank, '. ', title, chr(10), '**Language:** ', language, ' | **Category:** ', category, ' | **Quality:** ', quality_score, '/10', chr(10), '**Source:** ', source_repo,
  chr(10), chr(10), '```', language, chr(10), document, chr(10), '```', chr(10), chr(10), '---', chr(10), chr(10)) AS rendered FROM top"""
)
def search_rendered(spark, sf):
    top = search.hybrid_top(search.matching(vector_bank(spark, sf), min_quality=5), QUESTION, search.vector_of(spark, sf, 0), 10)
    return top.withColumn("description", F.lit(None).cast("string")).select("rank", render.search_result().alias("rendered"))


@query(
    _hybrid_sql(5)
    + "SELECT CAST(rank AS INTEGER) AS rank, concat('### Pattern ', rank, ': ', title, ' (', language, ')', chr(10), '```', chr(10), substr(document, 1, 500), '...', chr(10), '```', chr(10)) AS rendered FROM top"
)
def prompt_patterns_rendered(spark, sf):
    top = search.hybrid_top(vector_bank(spark, sf), QUESTION, search.vector_of(spark, sf, 0), 5)
    return top.withColumn("description", F.lit(None).cast("string")).select("rank", render.prompt_pattern().alias("rendered"))


@query(
    """WITH k AS (SELECT * FROM (VALUES (0, 'api', 'REST API endpoint controller service'), (1, 'cli', 'command line argument parser'), (2, 'library', 'module package utility'), (3, 'web-app', 'web application frontend backend'), (4, 'game', '')) t(n, kind, words))
SELECT d.doc_id, k.kind, concat(k.kind, ' ', d.lang, ' ', d.source, ' ', k.words) AS query_text FROM documents d JOIN k ON d.doc_id % 5 = k.n"""
)
def gather_patterns_query(spark, sf):
    """What is asked for a project of each document's kind, with its language and source as the stack."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("api", "cli", "library", "web-app", "game")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.concat("lang", F.lit(",  "), "source", F.lit(" ")).alias("stack"))
    return rows.select("doc_id", "kind", search.scaffold_query(F.col("kind"), search.split_stack(F.col("stack"))).alias("query_text"))


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(
    rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-zA-Z_][a-zA-Z0-9_]*') AND length(t) > 2 AND NOT list_contains([{_STOPS}], t)) AS ts FROM documents),
e AS (SELECT doc_id, unnest(ts) AS keyword, unnest(range(len(ts))) AS pos FROM t),
c AS (SELECT doc_id, keyword, count(*) AS hits, min(pos) AS first_at FROM e GROUP BY doc_id, keyword),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, first_at) AS rank FROM c)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, keyword, hits FROM r WHERE rank <= 10"""
)
def keywords_topn(spark, sf):
    return text.top_keywords(table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH d AS (SELECT doc_id, text AS document FROM documents) SELECT doc_id, round({KEYWORD}, 9) AS keyword FROM d")
def keyword_score(spark, sf):
    lowered = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return lowered.select("doc_id", F.round(text.keyword_score(F.col("t"), F.array(*[F.lit(w) for w in WORDS])), 9).alias("keyword"))


QUESTIONS = ["error handling with retry", "token secret password", "tion ing ver", "und der die", "zzz"]


def _score_sql(words: list[str]) -> str:
    return "least(CAST(1.0 AS DOUBLE), (" + " + ".join(["CAST(0 AS DOUBLE)", *(_HIT.format(k=k, n=len(k)) for k in words)]) + f") / {len(words)})"


@query(" UNION ALL ".join(f"SELECT doc_id, {n} AS query_no, round({_score_sql(search.query_keywords(q))}, 9) AS keyword FROM (SELECT doc_id, text AS document FROM documents)" for n, q in enumerate(QUESTIONS)))
def keyword_score_matrix(spark, sf):
    told = F.array(*[F.struct(F.lit(n).alias("query_no"), F.array(*[F.lit(w) for w in search.query_keywords(q)]).alias("words")) for n, q in enumerate(QUESTIONS)])
    rows = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"), F.explode(told).alias("q"))
    return rows.select("doc_id", "q.query_no", F.round(text.keyword_score(F.col("t"), F.col("q.words")), 9).alias("keyword"))


@query()
def hash_embedding_topk(spark, sf):
    ship(spark)
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("point_id"), search.hash_embedding(F.col("text")).alias("embedding"))
    return search.semantic_top(docs, search.embed([QUESTION])[0], 10).select("point_id", F.round("semantic", 9).alias("semantic"))


@query(
    """WITH m AS (SELECT * FROM (VALUES (0, 'jinaai/jina-embeddings-v2-base-code', 768), (1, 'BAAI/bge-base-en-v1.5', 768), (2, 'BAAI/bge-small-en-v1.5', 384), (3, 'sentence-transformers/all-MiniLM-L6-v2', 384), (4, 'nomic-ai/nomic-embed-text-v1.5', 768), (5, 'unknown', NULL)) t(n, model, vector_size))
SELECT e.vec_id, m.model, m.vector_size, len(e.embedding) AS held, coalesce(m.vector_size = len(e.embedding), FALSE) AS fits FROM embeddings e JOIN m ON e.vec_id % 6 = m.n"""
)
def embedding_info(spark, sf):
    """The size that the model named beside each vector gives, and whether the vector has it."""
    known = model_info(spark)
    names = [r["model"] for r in known.select("model").collect()]
    model = F.element_at(F.array(*[F.lit(x) for x in (*names, "unknown")]), (F.col("vec_id") % (len(names) + 1) + 1).cast("int"))
    rows = table(spark, sf, "embeddings").select("vec_id", model.alias("model"), F.size("embedding").cast("long").alias("held")).join(F.broadcast(known), "model", "left")
    return rows.select("vec_id", "model", "vector_size", "held", F.coalesce(F.col("vector_size") == F.col("held"), F.lit(False)).alias("fits"))


# Statistics and relabelling


@query(
    f"""WITH {BANK}, u AS (SELECT 'language' AS dimension, language AS value FROM bank UNION ALL SELECT 'category', category FROM bank UNION ALL SELECT 'source_repo', source_repo FROM bank)
SELECT dimension, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY dimension, value"""
)
def stats_dimensions(spark, sf):
    return stats.dimension_counts(bank.document_bank(spark, sf))


@query(
    f"""WITH {BANK}, u AS (SELECT 'language' AS dimension, language AS value, ingest_seq FROM bank UNION ALL SELECT 'category', category, ingest_seq FROM bank UNION ALL SELECT 'source_repo', source_repo, ingest_seq FROM bank),
c AS (SELECT dimension, value, count(*) AS n, min(ingest_seq) AS f FROM u WHERE value IS NOT NULL GROUP BY dimension, value)
SELECT dimension, value, n, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, f, value) AS INTEGER) AS rank FROM c"""
)
def stats_ranked(spark, sf):
    """Ties by who came first."""
    return stats.ranked_counts(bank.document_bank(spark, sf))


@query(
    f"""WITH {BANK}, u AS (SELECT 'language' AS dimension, language AS value FROM bank UNION ALL SELECT 'category', category FROM bank UNION ALL SELECT 'source_repo', source_repo FROM bank)
SELECT concat(dimension, ' | ', value, ': ', count(*)) AS line, FALSE AS empty_bank FROM u WHERE value IS NOT NULL GROUP BY dimension, value
UNION ALL SELECT 'The bank is empty: sync a repository or store a pattern', TRUE"""
)
def stats_rendered(spark, sf):
    """The lines of a bank, and the one of an empty bank."""
    told = bank.document_bank(spark, sf)
    lines = lambda b: render.stats_lines(stats.dimension_counts(b))
    return lines(told).withColumn("empty_bank", F.lit(False)).unionByName(lines(told.limit(0)).withColumn("empty_bank", F.lit(True)))


@query("SELECT count(*) AS n FROM documents")
def stats_total(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


_SPARSE = "CASE WHEN quality_score IS NULL THEN NULL ELSE category END"


@query(
    f"""WITH {BANK}, c AS (SELECT coalesce({_SPARSE}, 'unknown') AS category, count(*) AS n FROM bank GROUP BY 1), p AS (SELECT *, n * CAST(100 AS DOUBLE) / sum(n) OVER () AS pct FROM c)
SELECT category, n, round(pct, 6) AS percent, concat(repeat('█', CAST(floor(pct / 5) AS INTEGER)), repeat('░', 20 - CAST(floor(pct / 5) AS INTEGER))) AS bar FROM p"""
)
def category_distribution(spark, sf):
    sparse = bank.document_bank(spark, sf).withColumn("category", F.when(F.col("quality_score").isNotNull(), F.col("category")))
    return stats.category_distribution(sparse)


def _relabelled(spark, sf):
    return stats.relabelled(analyze.chunk_of(bank.document_bank(spark, sf)), analyze.mock_analysis())


@query(f"WITH {BANK} SELECT ingest_seq, title, 'unknown' AS chunk_type, 'unknown' AS chunk_language FROM bank WHERE category = 'security'")
def relabel_candidates(spark, sf):
    found = search.in_category(bank.document_bank(spark, sf), "security")
    return analyze.chunk_of(found).select("ingest_seq", "title", "chunk_type", "chunk_language")


@query(
    f"""WITH {BANK}, o AS (SELECT CASE WHEN length(document) = 0 THEN 'skipped' WHEN category <> 'other' THEN 'updated' ELSE 'unchanged' END AS outcome FROM bank)
SELECT count(*) AS processed, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM o"""
)
def relabel_outcomes(spark, sf):
    return stats.outcome_counts(_relabelled(spark, sf))


@query(f"WITH {BANK}, c AS (SELECT concat(category, ' -> other') AS transition, count(*) AS n FROM bank WHERE length(document) > 0 AND category <> 'other' GROUP BY category) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, transition) AS INTEGER) AS rank FROM c")
def relabel_transitions(spark, sf):
    return stats.transitions(_relabelled(spark, sf))


# Text


def _texts(spark, sf, f):
    return table(spark, sf, "documents").select("doc_id", F.md5(f(F.col("text"))).alias("digest"))


_BLANKS = r"array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\t\n\v\f\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')), chr(10))"
_COMMENTS = r"regexp_replace(regexp_replace(regexp_replace(text, '(?m)//.*?$', '', 'g'), '(?m)#.*?$', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"
_DOCSTRINGS = "regexp_replace(regexp_replace(text, '(?s)\"{3}.*?\"{3}', '', 'g'), '(?s)\\x27{3}.*?\\x27{3}', '', 'g')"
_SPACES = "replace(regexp_replace(text, ' +', ' ', 'g'), concat(chr(13), chr(10)), chr(10))"


@query(f"SELECT doc_id, md5({_SPACES}) AS digest FROM documents")
def preprocess_whitespace(spark, sf):
    return _texts(spark, sf, text.preprocess)


@query(f"SELECT doc_id, md5({_BLANKS}) AS digest FROM documents")
def drop_blank_lines(spark, sf):
    return _texts(spark, sf, text.drop_blank_lines)


@query(f"SELECT doc_id, md5({_COMMENTS}) AS digest FROM documents")
def strip_comments(spark, sf):
    return _texts(spark, sf, text.strip_comments)


@query(f"SELECT doc_id, md5({_DOCSTRINGS}) AS digest FROM documents")
def strip_docstrings(spark, sf):
    return _texts(spark, sf, text.strip_docstrings)


@query(f"WITH a AS (SELECT doc_id, {_SPACES} AS text FROM documents), b AS (SELECT doc_id, {_BLANKS} AS text FROM a), c AS (SELECT doc_id, {_COMMENTS} AS text FROM b) SELECT doc_id, md5({_DOCSTRINGS}) AS digest FROM c")
def preprocess_all(spark, sf):
    return _texts(spark, sf, lambda c: text.preprocess(c, True, True, True, True))


@query("SELECT doc_id, length(text) / 4.0 > 512 AS chunked FROM documents")
def should_chunk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.should_chunk(F.col("text")).alias("chunked"))


@query(
    """WITH big AS (SELECT doc_id, text, unnest(range(0, length(text), 1848)) AS s FROM documents WHERE length(text) / 4.0 > 512),
w AS (SELECT doc_id, CAST(s // 1848 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, CAST(s AS INTEGER) AS start_char, CAST(s + 2048 AS INTEGER) AS end_char, md5(substr(text, CAST(s AS INTEGER) + 1, 2048)) AS digest FROM big)
SELECT * FROM w UNION ALL SELECT doc_id, 0, 1, 0, CAST(length(text) AS INTEGER), md5(text) FROM documents WHERE NOT length(text) / 4.0 > 512"""
)
def fixed_windows(spark, sf):
    rows = chunking.window_rows(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk_index", "total_chunks", "start_char", "end_char", F.md5("text").alias("digest"))


@query(
    """WITH RECURSIVE big AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) / 4.0 > 512),
steps AS (
  SELECT doc_id, ls, 0 AS k, CAST([] AS VARCHAR[]) AS held, CAST(0 AS DOUBLE) AS size, CAST(NULL AS VARCHAR) AS done FROM big UNION ALL
  SELECT doc_id, ls, k + 1, CASE WHEN past THEN list_append(tail, x) ELSE list_append(held, x) END,
    CASE WHEN past THEN coalesce(list_sum(list_transform(tail, lambda t: length(t) / CAST(4 AS DOUBLE))), 0) + n ELSE size + n END, CASE WHEN past THEN array_to_string(held, chr(10)) END
  FROM (SELECT *, size + n > 512 AND len(held) > 0 AS past, list_slice(held, -2, -1) AS tail FROM (SELECT *, ls[k + 1] AS x, length(ls[k + 1]) / CAST(4 AS DOUBLE) AS n FROM steps WHERE k < len(ls)))),
parts AS (SELECT doc_id, k, done AS part FROM steps WHERE done IS NOT NULL UNION ALL SELECT doc_id, k + 1, array_to_string(held, chr(10)) FROM steps WHERE k = len(ls) AND len(held) > 0
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE NOT length(text) / 4.0 > 512)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, md5(part) AS digest FROM parts"""
)
def line_packing(spark, sf):
    return chunking.packed_rows(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "total_chunks", F.md5("text").alias("digest"))


_NONBLANK = r"regexp_matches(x, '[^\t\n\v\f\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')"


@query(
    f"""WITH f AS (SELECT doc_id, string_split(repeat(concat(text, chr(10)), 12), chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, ls, unnest(CASE WHEN len(ls) <= 150 THEN [0] ELSE range(0, len(ls) - 10, 140) END) AS s FROM f),
w AS (SELECT doc_id, len(ls) > 150 AS parts, s, list_slice(ls, s + 1, s + 150) AS held FROM s),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS k FROM w WHERE len(list_filter(held, lambda x: {_NONBLANK})) >= 5)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, md5(array_to_string(held, chr(10))) AS digest, CAST(s + 1 AS INTEGER) AS start_line, CAST(s + len(held) AS INTEGER) AS end_line,
  CASE WHEN parts THEN 'file_part' ELSE 'file' END AS chunk_type, CASE WHEN parts THEN concat('doc', doc_id, '_part', k + 1) ELSE concat('doc', doc_id) END AS name FROM v"""
)
def semantic_windows(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("a/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.repeat(F.concat("text", F.lit("\n")), F.lit(12)).alias("content"))
    return chunking.file_parts(files).select("doc_id", "chunk_no", F.md5("content").alias("digest"), "start_line", "end_line", "chunk_type", "name")


# Chunks of source files

SOURCES = [
    ("py_class", "a/calc.py", "python", "import math\n\n\nclass Circle:\n    def __init__(self, r):\n        self.r = r\n\n    def area(self):\n        return math.pi * self.r ** 2\n"),
    ("py_mixed", "a/jobs.py", "python", "import os\nfrom sys import argv\n# note\nimport re\nx = 1\nimport late\n\n@one\n@two(3)\nasync def work(n):\n    a = n\n    b = a\n    c = b\n    return c\n\ndef tiny():\n    pass\n\ndef tail(n):\n    a = 1\n\n    b = 2\n    c = 3\n    return a\n\n"),
    ("py_cut", "a/cut.py", "python", "def wide(\n    a,\n    b,\n    c,\n    d,\n) -> int:\n    return 1\n"),
    ("py_nested", "a/nest.py", "python", "if True:\n    class Inner:\n        a = 1\n        b = 2\n        c = 3\n        d = 4\n    def skipped():\n        pass\n"),
    ("py_marks", "a/marks.py", "python", "@a\n@b\n@c\n@d\n@e"),
    ("java_class", "b/App.java", "java", "package a.b;\nimport java.util.List;\n\n@Service\npublic final class App {\n  void run() {\n    go();\n  }\n}\nstatic class No {\n  int a;\n  int b;\n  int c;\n}\n"),
    ("java_enum", "b/Kind.java", "java", "package a;\nenum Kind {\n  A,\n  B,\n  C\n}\n"),
    ("js_mixed", "c/app.js", "javascript", "import a from 'a';\nconst r = require('r');\nexport class Box extends Base {\n  constructor() {\n    this.n = 1;\n  }\n}\nexport const load = async (x) => {\n  const y = x;\n  const z = y;\n  return z;\n};\nconst sum = (a + b);\nfunction go() {\n  one();\n  two();\n  three();\n}\n"),
    ("ts_open", "c/open.ts", "typescript", "import { x } from 'x';\n@Mark()\nexport abstract class Open {\n  a = '{';\n  b = 1;\n  c = 2;\n"),
    ("go_file", "d/main.go", "go", "package main\n\nimport \"fmt\"\n\nfunc main() {\n  fmt.Println(1)\n}\n"),
    ("too_short", "d/short.py", "python", "a = 1\nb = 2\n"),
    ("no_text", "d/none.py", "python", ""),
]

CHUNKS = [
    ("py_class", 0, 4, 9, "class", "Circle", "import math"),
    ("py_mixed", 0, 8, 14, "function", "work", "import os\nfrom sys import argv\nimport re"),
    ("py_mixed", 1, 19, 24, "function", "tail", "import os\nfrom sys import argv\nimport re"),
    ("py_cut", 0, 1, 5, "function", "wide", ""),
    ("py_nested", 0, 2, 6, "class", "Inner", ""),
    ("py_marks", 0, 1, 5, "file", "marks", None),
    ("java_class", 0, 4, 9, "class", "App", "package a.b;\nimport java.util.List;"),
    ("java_enum", 0, 2, 6, "class", "Kind", "package a;"),
    ("js_mixed", 0, 3, 7, "class", "Box", "import a from 'a';"),
    ("js_mixed", 1, 8, 12, "function", "load", "import a from 'a';"),
    ("js_mixed", 2, 13, 18, "function", "sum", "import a from 'a';"),
    ("ts_open", 0, 1, 7, "file", "open", None),
    ("go_file", 0, 1, 8, "file", "main", None),
]


def _quoted(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    return str(x) if isinstance(x, int | float) else "replace('" + x.replace("'", "''").replace("\n", "¶") + "', '¶', chr(10))"


def values_sql(rows: list[tuple], columns: list[str], casts: dict[str, str] | None = None) -> str:
    names = ", ".join(f"CAST({c} AS {casts[c]}) AS {c}" if casts and c in casts else c for c in columns)
    return f"SELECT {names} FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") t({', '.join(columns)})"


def fixture_files(spark: SparkSession, sf: str, cases: list[str]) -> DataFrame:
    """Each document stands for one of the sources of these cases, in a folder of its own."""
    texts = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("case_name", "path", "language", "content"), s, strict=True)]) for s in SOURCES if s[0] in cases])
    docs = table(spark, sf, "documents").select("doc_id", F.element_at(texts, (F.col("doc_id") % len(cases) + 1).cast("int")).alias("s"))
    return docs.select("doc_id", "s.case_name", F.concat(F.lit("src"), F.col("doc_id").cast("string"), F.lit("/"), F.col("s.path")).alias("file_path"), "s.language", "s.content")


_CHUNK_COLUMNS = ["chunk_no", "start_line", "end_line", "chunk_type", "name", "context"]


def _chunk_query(name: str, starts: tuple[str, ...]) -> None:
    """A query over the documents, each with one of the sources; what their chunks are is told by CHUNKS."""
    cases = [s[0] for s in SOURCES if s[0].startswith(starts)]
    told = values_sql([c for c in CHUNKS if c[0] in cases], ["case_name", *_CHUNK_COLUMNS], {"context": "VARCHAR", "name": "VARCHAR"})
    numbers = values_sql(list(enumerate(cases)), ["k", "case_name"])
    sql = f"WITH told AS ({told}), numbers AS ({numbers}) SELECT d.doc_id, t.* FROM documents d JOIN numbers n ON d.doc_id % {len(cases)} = n.k JOIN told t ON t.case_name = n.case_name"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return scanners.extract_chunks(fixture_files(spark, sf, cases)).select("doc_id", "case_name", *_CHUNK_COLUMNS)

    query(sql, name)(run)


_chunk_query("chunk_python", ("py_",))
_chunk_query("chunk_java", ("java_",))
_chunk_query("chunk_js", ("js_", "ts_"))
_chunk_query("chunk_fallback", ("go_", "too_", "no_"))


@query()
def chunk_documents(spark, sf):
    ship(spark)
    languages = F.array(*[F.lit(x) for x in ("python", "java", "javascript", "go")])
    files = file_rows(spark, sf).select("ingest_seq", F.col("path").alias("file_path"), F.element_at(languages, (F.col("ingest_seq") % 4 + 1).cast("int")).alias("language"), "content")
    return scanners.extract_chunks(files).select("ingest_seq", "language", "chunk_no", F.md5("content").alias("digest"), "start_line", "end_line", "chunk_type", "name")


_BODY = lambda line: f"repeat(concat('{line}', chr(10)), n)"
CORPUS = f"""corpus AS (
  SELECT doc_id, CAST(2 + doc_id % 7 AS INTEGER) AS n, CAST(2 + doc_id // 7 % 6 AS INTEGER) AS m, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript' ELSE 'go' END AS language FROM documents),
blocks AS (
  SELECT doc_id, language, 1 AS k, 'class' AS chunk_type, concat('A', doc_id) AS name, 3 AS start_line, n + CASE language WHEN 'python' THEN 3 ELSE 4 END AS end_line, n + CASE language WHEN 'python' THEN 1 ELSE 2 END AS lines FROM corpus WHERE language <> 'go'
  UNION ALL SELECT doc_id, language, 2, 'function', concat('f', doc_id), n + CASE language WHEN 'python' THEN 5 ELSE 6 END, n + m + CASE language WHEN 'python' THEN 5 ELSE 7 END, m + CASE language WHEN 'python' THEN 1 ELSE 2 END FROM corpus WHERE language IN ('python', 'javascript')),
found AS (SELECT * FROM blocks WHERE lines >= 5),
whole AS (
  SELECT doc_id, language, 1 AS k, 'file' AS chunk_type, concat('doc', doc_id) AS name, 1 AS start_line, CASE language WHEN 'python' THEN n + m + 6 ELSE n + m + 8 END AS end_line, 9 AS lines FROM corpus c
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = c.doc_id))"""


def corpus_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A source for each document: an import, a class of n lines and a function of m lines, in four languages."""
    d = F.col("doc_id")
    n, m, name = (2 + d % 7).cast("int"), (2 + F.floor(d / 7) % 6).cast("int"), d.cast("string")
    body = lambda line, k: F.repeat(F.lit(line + "\n"), k)
    language = F.element_at(F.array(*[F.lit(x) for x in ("python", "java", "javascript", "go")]), (d % 4 + 1).cast("int"))
    python = F.concat(F.lit("import os\n\nclass A"), name, F.lit(":\n"), body("    x = 1", n), F.lit("\ndef f"), name, F.lit("(a):\n"), body("    a += 1", m))
    braces = lambda first, head: F.concat(F.lit(first + "\n\nclass A"), name, F.lit(" {\n"), body("  a = {};", n), F.lit("}\n\n" + head), name, F.lit("(a) {\n"), body("  go();", m), F.lit("}\n"))
    text = F.when(language == "python", python).when(language == "java", braces("import a.b;", "void f")).when(language == "javascript", braces("import a from 'a';", "function f")).otherwise(braces("package a", "func f"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/doc"), name, F.lit(".x")).alias("file_path"), language.alias("language"), text.alias("content"))


@query(
    f"""WITH {CORPUS}, every AS (SELECT * FROM found UNION ALL SELECT * FROM whole)
SELECT doc_id, language, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_no, chunk_type, name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM every"""
)
def chunk_corpus(spark, sf):
    """G1 to G8, D4 over thousands of sources: blocks that are long enough, else the whole file."""
    ship(spark)
    return scanners.extract_chunks(corpus_rows(spark, sf)).select("doc_id", "language", "chunk_no", "chunk_type", "name", "start_line", "end_line")


@query(ORACLE_SQL["chunk_corpus"])
def sql_chunk_file(spark, sf):
    """The same in SQL, by a table function that hands the other columns on."""
    sql_functions.register(spark)
    corpus_rows(spark, sf).createOrReplaceTempView("corpus_files")
    return spark.sql("SELECT doc_id, language, chunk_no, chunk_type, name, start_line, end_line FROM chunk_file(TABLE(corpus_files))")


@query(
    f"""WITH {FILES}, e AS (SELECT *, {_EXT} AS ext FROM files)
SELECT ingest_seq, md5(concat(repo, ':', path, ':', substr(md5(content), 1, 8))) AS id, {_LANG} AS language, round(({" + ".join(f"least(CAST(1.0 AS DOUBLE), CAST(0.3 AS DOUBLE) * ((length(lower(content)) - length(replace(lower(content), '{w}', ''))) // {len(w)}))" for w in ("class", "token", "the"))}) / 3, 9) AS score,
  round(CASE WHEN content IS NULL THEN NULL ELSE (3.0 * length(content) + 4) / (sqrt(CAST(length(content) AS DOUBLE) * length(content) + 5) * sqrt(14)) END, 9) AS near FROM e"""
)
def sql_scalars(spark, sf):
    """Ids, languages, scores and similarities in SQL."""
    sql_functions.register(spark)
    file_rows(spark, sf).createOrReplaceTempView("corpus_rows")
    return spark.sql(
        """SELECT ingest_seq, pattern_id(repo, path, content) AS id, language_of(path) AS language, round(keyword_match(content, array('class', 'token', 'the')), 9) AS score,
        round(vector_cosine(array(CAST(length(content) AS DOUBLE), 1D, 2D), array(3D, 2D, 1D)), 9) AS near FROM corpus_rows"""
    )


# Analysis

PIECES = """pieces AS (SELECT doc_id AS ingest_seq, source AS repo, concat('doc/', doc_id, '.txt') AS file_path, lang AS language, text AS content,
  CASE doc_id % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'file' END AS chunk_type, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('n', doc_id) END AS name FROM documents)"""


def piece_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("ingest_seq"), F.col("source").alias("repo"), F.concat(F.lit("doc/"), d.cast("string"), F.lit(".txt")).alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"),
        F.element_at(F.array(F.lit("class"), F.lit("function"), F.lit("file")), (d % 3 + 1).cast("int")).alias("chunk_type"),
        F.when(d % 5 == 1, "").when(d % 5 > 1, F.concat(F.lit("n"), d.cast("string"))).alias("name"),
    )


_MOCK = "length(content) > 200 AND chunk_type IN ('class', 'function')"
_TITLE = "concat('Pattern from ', coalesce(nullif(name, ''), 'code')) AS title, concat('A ', chunk_type, ' extracted from ', file_path) AS description"


@query(f"WITH {PIECES} SELECT ingest_seq, {_MOCK} AS is_pattern, {_TITLE}, CASE WHEN {_MOCK} THEN 6 ELSE 3 END AS quality_score FROM pieces")
def mock_analysis(spark, sf):
    return piece_rows(spark, sf).select("ingest_seq", analyze.mock_analysis().alias("a")).select("ingest_seq", "a.is_pattern", "a.title", "a.description", "a.quality_score")


@query(f"WITH {PIECES} SELECT ingest_seq, {_TITLE}, 6 AS quality_score, repo AS source_repo, file_path AS source_path FROM pieces WHERE {_MOCK}")
def quality_gate(spark, sf):
    found = analyze.patterns(analyze.quality_gate(piece_rows(spark, sf).withColumn("analysis", analyze.mock_analysis())))
    return found.select("ingest_seq", "title", "description", "quality_score", "source_repo", "source_path")


@query(f"WITH {PIECES} SELECT ingest_seq, coalesce(nullif(name, ''), concat('Pattern from ', file_path)) AS title, concat('Code ', chunk_type, ' from ', file_path) AS description, 'other' AS category, 5 AS quality_score FROM pieces")
def fallback_patterns(spark, sf):
    return analyze.fallback_patterns(piece_rows(spark, sf)).select("ingest_seq", "title", "description", "category", "quality_score")


_PROMPT = "concat('Rate ', language, ' of ', file_path, ' in N/A: ', substr(content, 1, 40))"


@query(f"WITH {PIECES} SELECT ingest_seq, {_PROMPT} AS prompt FROM (SELECT ingest_seq, language, file_path, content FROM pieces)")
def analysis_prompt(spark, sf):
    """X29."""
    rows = piece_rows(spark, sf).withColumn("content", F.substring("content", 1, 40)).withColumn("context", F.when(F.col("ingest_seq") % 2 == 0, ""))
    return rows.select("ingest_seq", render.analysis_prompt("Rate {language} of {file_path} in {context}: {code}").alias("prompt"))


@query(
    f"""WITH {PIECES} SELECT ingest_seq, CASE WHEN length(content) % 5 = 0 THEN NULL ELSE concat('T', length(content) % 40) END AS title, CASE WHEN length(content) % 5 = 0 THEN NULL ELSE CAST(least(10, greatest(1, length(content) % 12)) AS INTEGER) END AS quality_score,
  CASE WHEN length(content) % 5 = 0 THEN 'refused' END AS error FROM pieces"""
)
def remote_analysis(spark, sf):
    """An analyzer behind a call, which refuses a fifth of the chunks."""
    ship(spark)

    def call(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise ValueError("refused")
        return f'{{"is_pattern": true, "title": "T{len(prompt) % 40}", "quality_score": {len(prompt) % 12}}}'

    told = remote.analyzed(piece_rows(spark, sf).withColumn("context", F.lit(None).cast("string")), "{code}", call)
    return told.select("ingest_seq", "analysis.title", "analysis.quality_score", "error")


FENCE = "`" * 3
REPLIES = [
    (0, '{"is_pattern": true, "title": "T", "description": "D", "category": "testing", "quality_score": 7, "use_cases": ["a", "b"]}'),
    (1, f'{FENCE}json\n{{"is_pattern": true, "title": "F", "category": "SECURITY", "quality_score": 100}}\n{FENCE}'),
    (2, "no json"),
    (3, '{"is_pattern": false, "category": "nope", "quality_score": -5}'),
    (4, '{"title": "S", "quality_score": "8"}'),
    (5, '{"title": "H", "quality_score": 7.9}'),
    (6, '{"title": "X", "quality_score": "8.5"}'),
    (7, '{"title": "N", "category": null}'),
    (8, "{}"),
    (9, "[]"),
    (10, '{"title": "J"} and more'),
    (11, "{'title': 'Q'}"),
    (12, '  {"title": "B"}  '),
    (13, ""),
    (14, '{"title": "Big", "quality_score": 99999999999, "is_pattern": 1}'),
    (15, '{"title": "Zero", "quality_score": -1e30, "is_pattern": 0}'),
]
PARSED = [
    (0, True, "T", "D", "testing", 7, "a,b"), (1, True, "F", "", "security", 10, ""), (2, None, None, None, None, None, None), (3, False, "Untitled Pattern", "", "other", 1, ""), (4, False, "S", "", "other", 8, ""),
    (5, False, "H", "", "other", 7, ""), (6, None, None, None, None, None, None), (7, None, None, None, None, None, None), (8, None, None, None, None, None, None), (9, None, None, None, None, None, None),
    (10, None, None, None, None, None, None), (11, None, None, None, None, None, None), (12, False, "B", "", "other", 5, ""), (13, None, None, None, None, None, None),
    (14, True, "Big", "", "other", 10, ""), (15, False, "Zero", "", "other", 1, ""),
]


def as_json(c: Column) -> Column:
    """A text as a string of JSON, in its quotes."""
    told = F.to_json(F.struct(c.alias("x")))
    return F.substring(told, 6, F.length(told) - 6)


@query(
    f"""WITH told AS ({values_sql(PARSED, ["n", "is_pattern", "title", "description", "category", "quality_score", "use_cases"])})
SELECT d.doc_id, t.n, t.is_pattern, CASE WHEN t.n = 0 THEN concat('T', d.doc_id) ELSE t.title END AS title, CASE WHEN t.n = 0 THEN md5(d.text) WHEN t.description <> '' THEN md5(t.description) ELSE t.description END AS description,
  t.category, t.quality_score, t.use_cases FROM documents d JOIN told t ON d.doc_id % {len(PARSED)} = t.n"""
)
def llm_json_parse(spark, sf):
    """A reply for each document, of sixteen kinds; one of them holds the document's text as JSON."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text"), (F.col("doc_id") % len(REPLIES)).cast("int").alias("n"))
    reply = F.element_at(F.array(*[F.lit(r) for _, r in REPLIES]), F.col("n") + 1)
    own = F.replace(F.replace(reply, F.lit('"T"'), F.concat(F.lit('"T'), F.col("doc_id").cast("string"), F.lit('"'))), F.lit('"D"'), as_json(F.col("text")))
    rows = docs.select("doc_id", "n", replies.analysis_of(own).alias("a"))
    told = F.col("a.description")
    return rows.select("doc_id", "n", "a.is_pattern", "a.title", F.when(told != "", F.md5(told)).otherwise(told).alias("description"), "a.category", "a.quality_score", F.array_join("a.use_cases", ",").alias("use_cases"))


STRUCTURES = [(0, '{"directories": ["src", "a"], "files": {"b.txt": "B", "a.txt": ""}}'), (1, "{}"), (2, "nope"), (3, '{"directories": ["x"]}'), (4, f'{FENCE}\n{{"files": {{"k": "B"}}}}\n{FENCE}')]


@query(
    f"""WITH told AS ({values_sql([(0, "a,src", "a.txt,b.txt"), (1, None, None), (2, None, None), (3, "x", ""), (4, "", "k")], ["n", "directories", "files"])})
SELECT d.doc_id, CASE WHEN t.n = 0 THEN concat('a,src', d.doc_id) ELSE t.directories END AS directories, t.files, CASE WHEN t.n IN (0, 4) THEN md5(d.text) END AS digest FROM documents d JOIN told t ON d.doc_id % 5 = t.n"""
)
def structure_json_parse(spark, sf):
    """A project reply for each document, of five kinds; a file of it holds the document's text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    reply = F.element_at(F.array(*[F.lit(r) for _, r in STRUCTURES]), (F.col("doc_id") % len(STRUCTURES) + 1).cast("int"))
    own = F.replace(F.replace(reply, F.lit('"src"'), F.concat(F.lit('"src'), F.col("doc_id").cast("string"), F.lit('"'))), F.lit('"B"'), as_json(F.col("text")))
    rows = docs.select("doc_id", replies.structure_of(own).alias("s"))
    held = F.coalesce(F.element_at("s.files", "b.txt"), F.element_at("s.files", "k"))
    return rows.select("doc_id", F.array_join(F.array_sort("s.directories"), ",").alias("directories"), F.array_join(F.array_sort(F.map_keys("s.files")), ",").alias("files"), F.md5(held).alias("digest"))


_STACKS = [("api", "Python, FastAPI"), ("web-app", "node"), ("cli", "Java,Spark"), ("library", "rust")]
_LISTING = [
    (0, "directory", "docs"), (0, "directory", "src"), (0, "directory", "tests"), (0, "file", "README.md"), (0, "file", "requirements.txt"), (0, "file", "setup.py"), (0, "file", "src/__init__.py"),
    (0, "file", "src/main.py"), (0, "file", "tests/__init__.py"), (0, "file", "tests/test_main.py"), (1, "directory", "src"), (1, "directory", "tests"), (1, "file", "README.md"), (1, "file", "package.json"), (1, "file", "src/index.js"),
    (2, "directory", "src/main/java"), (2, "directory", "src/main/java/com/@"), (2, "directory", "src/main/resources"), (2, "directory", "src/test/java"), (2, "file", "README.md"), (2, "file", "pom.xml"), (2, "file", "src/main/java/com/@/Application.java"),
    (3, "directory", "docs"), (3, "directory", "src"), (3, "directory", "tests"), (3, "file", "README.md"),
]


@query(
    f"""WITH told AS ({values_sql(_LISTING, ["n", "kind", "path"])}), every AS (SELECT concat('proj-', d.doc_id) AS name, t.kind, replace(t.path, '@', concat('proj', d.doc_id)) AS path FROM documents d JOIN told t ON d.doc_id % {len(_STACKS)} = t.n)
SELECT name, kind, CAST(row_number() OVER (PARTITION BY name, kind ORDER BY path) - 1 AS INTEGER) AS position, path FROM every"""
)
def scaffold_listing(spark, sf):
    """A project for each document, of four stacks."""
    ship(spark)
    pick = F.element_at(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("stack")) for k, s in _STACKS]), (F.col("doc_id") % len(_STACKS) + 1).cast("int"))
    projects = table(spark, sf, "documents").select(F.concat(F.lit("proj-"), F.col("doc_id").cast("string")).alias("name"), pick.alias("p")).select("name", "p.kind", search.split_stack(F.col("p.stack")).alias("stack"))
    return scaffold.listing(scaffold.scaffolds(projects))


# Progress

STEPS = "steps AS (SELECT source AS repo_name, CAST(count(*) AS INTEGER) AS total_files, CAST(count(*) FILTER (WHERE n_chars > 1500) AS INTEGER) AS processed_files, CAST(sum(n_chars) // 1000 AS DOUBLE) AS elapsed_s FROM documents GROUP BY source)"


@query(
    f"""WITH {STEPS} SELECT repo_name, total_files, processed_files, round_even(processed_files * CAST(100 AS DOUBLE) / total_files, 1) AS percent,
  CASE WHEN processed_files > 0 THEN round_even(elapsed_s / processed_files * (total_files - processed_files), 1) ELSE CAST(0 AS DOUBLE) END AS eta_s,
  CASE WHEN elapsed_s >= 60 THEN concat(CAST(floor(elapsed_s / 60) AS BIGINT), 'm ', CAST(floor(elapsed_s % 60) AS BIGINT), 's') ELSE concat(CAST(CAST(elapsed_s AS DECIMAL(18, 1)) AS VARCHAR), 's') END AS elapsed FROM steps"""
)
def progress_metrics(spark, sf):
    counts = table(spark, sf, "documents").groupBy(F.col("source").alias("repo_name")).agg(
        F.count("*").cast("int").alias("total_files"), F.count_if(F.col("n_chars") > 1500).cast("int").alias("processed_files"), F.floor(F.sum("n_chars") / 1000).cast("double").alias("elapsed_s")
    )
    return render.with_progress(counts).withColumn("elapsed", render.elapsed(F.col("elapsed_s"))).drop("elapsed_s")


@query(
    """WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars < 400)
SELECT source AS repo, string_agg(concat('doc/', doc_id, '.txt'), ',' ORDER BY doc_id) AS failed, greatest(max(n) - 5, 0) AS more FROM f WHERE k <= 5 GROUP BY source"""
)
def failed_files_top5(spark, sf):
    short = table(spark, sf, "documents").where("n_chars < 400").select(F.col("source").alias("repo"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.lit("short").alias("error"), "doc_id")
    return ingest.first_failures(short, "doc_id").select("repo", F.array_join(F.transform("failed_files", lambda f: f["path"]), ",").alias("failed"), F.col("more_failed").alias("more"))


_LINE = "concat(repo, ': ', processed_files, ' of ', total_files, ' files (', CAST(CAST(percent AS DECIMAL(18, 1)) AS VARCHAR), '%), about ', CASE WHEN eta_s >= 60 THEN concat(CAST(floor(eta_s / 60) AS BIGINT), 'm ', CAST(floor(eta_s % 60) AS BIGINT), 's') ELSE concat(CAST(CAST(eta_s AS DECIMAL(18, 1)) AS VARCHAR), 's') END, ' left')"


@query(
    f"""WITH l AS (SELECT source AS repo, count(*) AS processed_files, CAST(sum(n_chars // 700) AS BIGINT) AS total_chunks, CAST(sum(CASE WHEN n_chars > 900 THEN 1 ELSE 0 END) AS BIGINT) AS stored_patterns, CAST(max(doc_id % 500) AS DOUBLE) AS elapsed_s,
  CAST(greatest(count(*) FILTER (WHERE n_chars < 200) - 5, 0) AS BIGINT) AS more_failed FROM documents GROUP BY source),
p AS (SELECT *, CAST(20000 AS BIGINT) AS total_files, round_even(processed_files * CAST(100 AS DOUBLE) / 20000, 1) AS percent, round_even(elapsed_s / processed_files * (20000 - processed_files), 1) AS eta_s FROM l)
SELECT repo AS repo_name, total_files, processed_files, total_chunks, stored_patterns, more_failed, percent, eta_s, {_LINE} AS rendered FROM p"""
)
def sync_progress_rows(spark, sf):
    """The progress that a log of files stands for."""
    log = table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.expr("n_chars div 700").alias("chunks"), F.when(F.col("n_chars") > 900, 1).otherwise(0).cast("long").alias("stored"),
        F.when(F.col("n_chars") < 200, "short").alias("error"), (1000 + F.col("doc_id") % 500).cast("double").alias("finished_at"),
    )
    told = render.with_progress(ingest.progress_from(log, 20_000, 1000.0))
    return told.select("repo_name", "total_files", "processed_files", "total_chunks", "stored_patterns", "more_failed", "percent", "eta_s", render.progress_report().alias("rendered"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def progress_sampled(spark, sf):
    """W8."""
    return ingest.sampled(table(spark, sf, "documents").select("doc_id"), 10, "doc_id")


def sync_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files that hold a function each."""
    body = F.concat(F.lit("import os\n\ndef work():\n    a = '"), F.regexp_replace("text", r"\s+", " "), F.lit("'\n    b = 1\n    c = 2\n    return a\n"))
    return table(spark, sf, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), body.alias("content"), F.col("doc_id").alias("ingest_seq"))


_SYNC = r"""s AS (SELECT source AS repo, concat('doc/', doc_id, '.py') AS path, concat('def work():', chr(10), '    a = ''', regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), '''', chr(10), '    b = 1', chr(10), '    c = 2', chr(10), '    return a') AS content FROM documents),
p AS (SELECT *, md5(concat(repo, ':', path, ':', substr(md5(content), 1, 8))) AS point_id FROM s WHERE length(content) > 200)"""


@query(f"WITH {_SYNC} SELECT point_id, repo AS source_repo, path AS source_path, 'Pattern from work' AS title, 6 AS quality_score, md5(content) AS digest FROM p")
def sync_end_to_end(spark, sf):
    ship(spark)
    files = sync_files(spark, sf)
    empty = bank.document_bank(spark, sf).limit(0)
    _, new, _ = plan.sync(files, empty)
    return bank.upsert(new.limit(0), new).select("point_id", "source_repo", "source_path", "title", "quality_score", F.md5("document").alias("digest"))


@query(
    f"""WITH {_SYNC}, f AS (SELECT source AS repo, count(*) AS files FROM documents GROUP BY source), k AS (SELECT repo, count(*) AS stored, count(DISTINCT point_id) AS distinct_points FROM p GROUP BY repo)
SELECT f.repo, files, files AS chunks, coalesce(stored, 0) AS stored, coalesce(distinct_points, 0) AS distinct_points FROM f LEFT JOIN k ON f.repo = k.repo"""
)
def sync_summary(spark, sf):
    ship(spark)
    files = sync_files(spark, sf)
    _, new, chunks = plan.sync(files, bank.document_bank(spark, sf).limit(0))
    return plan.summary(files, chunks, new)


@query("SELECT source AS repo, concat('doc/', doc_id, '.py') AS file_path FROM documents WHERE n_chars > 1500")
def sync_resume_antijoin(spark, sf):
    files = sync_files(spark, sf).select("repo", "file_path")
    done = table(spark, sf, "documents").where("n_chars <= 1500").select(F.col("source").alias("repo"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"))
    return ingest.remaining(files, done)


@query(f"WITH {_SYNC} SELECT 'only_stream' AS what, 0 AS n UNION ALL SELECT 'only_batch', 0 UNION ALL SELECT 'streamed', count(DISTINCT point_id) FROM p")
def sync_stream_equals_batch(spark, sf):
    """The points that differ between one stream over 25 files and one batch: their counts, and 0 differences."""
    ship(spark)
    home = fresh_path(spark, "stream")
    files = sync_files(spark, sf)
    files.repartition(25).write.parquet(f"{home}/in")
    ingest.ingest(spark, f"{home}/in", f"{home}/out", f"{home}/checkpoint")
    streamed = ingest.ingested(spark, f"{home}/out").select("point_id")
    _, new, _ = plan.sync(files, bank.document_bank(spark, sf).limit(0))
    batch = stored(bank.latest(new).select("point_id"), "batch-points")
    only = lambda a, b, n: a.join(b, "point_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
    return only(streamed, batch, "only_stream").unionByName(only(batch, streamed, "only_batch")).unionByName(streamed.agg(F.count("*").alias("n")).select(F.lit("streamed").alias("what"), "n"))


def document_tree(spark: SparkSession, sf: str) -> str:
    """The documents as files of a tree, by their paths; each ninth is no UTF-8, each fourteenth is empty."""
    n = F.col("ingest_seq")
    data = F.when(n % 14 == 3, F.lit(b"")).when(n % 9 == 4, F.concat(F.unhex(F.lit("FF")), F.encode("content", "UTF-8"))).otherwise(F.encode("content", "UTF-8"))
    return trees.write_tree(file_rows(spark, sf).select("path", data.alias("content")), fresh_path(spark, "tree"))


_TREE_SQL = f"""tree AS (SELECT path, CASE WHEN ingest_seq % 14 = 3 THEN '' ELSE content END AS text, ingest_seq % 14 <> 3 AND ingest_seq % 9 = 4 AS broken, {_EXT} AS ext FROM files)"""
_IGNORED_RE = lambda names: "(^|/)(" + "|".join(re.escape(d) for d in names) + ")/"


@query(
    f"""WITH {_SYNC.replace("SELECT source AS repo", "SELECT 'me/app' AS repo")}, k AS (SELECT count(*) AS n FROM p WHERE path <> 'doc/7.py')
SELECT 'me/app' AS repo_name, (SELECT count(*) FROM documents) AS total_files, (SELECT count(*) FROM documents) AS processed_files, CAST(k.n AS BIGINT) AS stored_patterns, k.n AS in_bank, CAST(100 AS DOUBLE) AS percent, 'doc/7.py: ValueError: no good' AS failed FROM k"""
)
def sync_stream_failures(spark, sf):
    """T1 to T5 into a bank: one file fails at every attempt; the stream ends with all others, and a second one has nothing to do."""
    from patternmill.config import BatchConfig, Config
    from patternmill.plans.api import PatternBank

    ship(spark)

    def chunker(content, path, language):
        if path == "doc/7.py":
            raise ValueError("no good")
        return scanners.chunks_of(content, path, language)

    home = fresh_path(spark, "stream")
    sync_files(spark, sf).withColumn("repo", F.lit("me/app")).repartition(20).write.parquet(f"{home}/in")
    own = PatternBank(spark, f"{home}/bank", config=Config(batch=BatchConfig(batch_size=10, max_retries=2, retry_delay=0.0)))
    own.sync_stream(f"{home}/in", "me/app", chunker=chunker)
    told = own.sync_stream(f"{home}/in", "me/app", chunker=chunker)
    first = F.element_at("failed_files", 1)
    return told.select("repo_name", "total_files", "processed_files", "stored_patterns", F.lit(own.table.count()).cast("long").alias("in_bank"), "percent", F.concat(first["path"], F.lit(": "), first["error"]).alias("failed"))


@query(
    f"""WITH {_SYNC.replace("SELECT source AS repo", "SELECT 'me/app' AS repo")}, k AS (SELECT count(*) AS n FROM p), c AS (SELECT count(*) AS n FROM p WHERE CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) % 7 = 0)
SELECT 'me/app' AS repo_name, (SELECT count(*) FROM documents) AS total_files, (SELECT count(*) FROM documents) AS processed_files, CAST(k.n AS BIGINT) AS stored_patterns, CAST(100 AS DOUBLE) AS percent, k.n + c.n AS in_bank FROM k, c"""
)
def sync_stream_changed_files(spark, sf):
    """A seventh of the files comes again, changed; each counts once, and its points of both times are in the bank."""
    from patternmill.config import BatchConfig, Config
    from patternmill.plans.api import PatternBank

    home = fresh_path(spark, "stream")
    files = sync_files(spark, sf).withColumn("repo", F.lit("me/app"))
    # A Parquet file for each part of the table: they grow in number, not in size.
    files.write.parquet(f"{home}/in")
    own = PatternBank(spark, f"{home}/bank", config=Config(batch=BatchConfig(batch_size=10, max_retries=1, retry_delay=0.0)))
    own.sync_stream(f"{home}/in", "me/app")
    again = files.where("ingest_seq % 7 = 0").withColumn("content", F.replace("content", F.lit("return a"), F.lit("return b"))).withColumn("ingest_seq", F.col("ingest_seq") + 10**6)
    again.write.mode("append").parquet(f"{home}/in")
    told = own.sync_stream(f"{home}/in", "me/app")
    return told.select("repo_name", "total_files", "processed_files", "stored_patterns", "percent", F.lit(own.table.count()).cast("long").alias("in_bank"))


@query(
    f"""WITH {_SYNC}, k AS (SELECT count(*) FILTER (WHERE length(content) > 200) AS n FROM p), f AS (SELECT count(*) AS n FROM s)
SELECT 'batches' AS what, f.n AS files, k.n AS stored, k.n // 50 AS steps FROM f, k"""
)
def sync_progress_events(spark, sf):
    """What a stream's writes tell as they go: each batch, and each 50 patterns more."""
    from patternmill.config import BatchConfig, Config
    from patternmill.plans.api import PatternBank

    home, told = fresh_path(spark, "stream"), Counter()

    def tell(p):
        told.update({"steps": 1} if p.patterns is not None else {"files": p.files, "stored": p.stored})

    sync_files(spark, sf).withColumn("repo", F.lit("me/app")).repartition(12).write.parquet(f"{home}/in")
    own = PatternBank(spark, f"{home}/bank", config=Config(batch=BatchConfig(batch_size=4, max_retries=1, retry_delay=0.0)))
    own.sync_stream(f"{home}/in", "me/app", on_progress=tell)
    return spark.createDataFrame([("batches", told["files"], told["stored"], told["steps"])], "what string, files long, stored long, steps long")


_EDITED = """e AS (
  SELECT concat(CASE WHEN doc_id % 11 = 2 THEN 'moved/' ELSE 'doc/' END, doc_id, '.py') AS path, CASE WHEN doc_id % 5 = 0 THEN replace(content, 'return a', 'return b') ELSE content END AS content
  FROM (SELECT doc_id, 'me/app' AS repo, content FROM s JOIN documents ON s.path = concat('doc/', doc_id, '.py')) WHERE doc_id % 7 <> 1)"""


@query(f"WITH {_SYNC}, {_EDITED} SELECT path AS source_path, md5(concat('me/app', ':', path, ':', substr(md5(content), 1, 8))) AS point_id, md5(content) AS digest FROM e WHERE length(content) > 200")
def sync_resync(spark, sf):
    """Files are changed, renamed and deleted; the bank then holds what a new one would."""
    from patternmill.config import BatchConfig, Config
    from patternmill.plans.api import PatternBank

    home, n = fresh_path(spark, "resync"), F.col("ingest_seq")
    files = sync_files(spark, sf).withColumn("repo", F.lit("me/app"))
    own = PatternBank(spark, f"{home}/bank", config=Config(batch=BatchConfig(max_retries=1, retry_delay=0.0)))
    own.resync(files, "me/app")
    path = F.when(n % 11 == 2, F.replace("file_path", F.lit("doc/"), F.lit("moved/"))).otherwise(F.col("file_path"))
    edited = files.where(n % 7 != 1).withColumn("file_path", path).withColumn("content", F.when(n % 5 == 0, F.replace("content", F.lit("return a"), F.lit("return b"))).otherwise(F.col("content")))
    own.resync(edited, "me/app")
    return own.read().select("source_path", "point_id", F.md5("document").alias("digest"))


@query(f"WITH {_SYNC} SELECT md5(content) AS digest, path FROM p WHERE CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) % 3 = 1")
def sync_skips_empty(spark, sf):
    """files without content, or with an empty one, give nothing."""
    ship(spark)
    n = F.col("ingest_seq") % 3
    held = sync_files(spark, sf).withColumn("content", F.when(n == 1, F.col("content")).when(n == 0, ""))
    return plan.found_in(plan.chunked(held)).select(F.md5("document").alias("digest"), F.col("source_path").alias("path"))


@query(f"WITH {FILES}, {_TREE_SQL} SELECT path, {_LANG} AS language, octet_length(encode(text)) AS size, length(text) AS n_chars FROM tree WHERE NOT broken AND text <> '' AND ext IN {_LIST(list(EXTENSIONS))} AND NOT regexp_matches(path, '{_IGNORED_RE(IGNORED_DIRS)}')")
def discover_files(spark, sf):
    """The documents written as a tree and read back: code files with language and length."""
    ship(spark)
    return trees.code_files(trees.tree(spark, document_tree(spark, sf))).select("path", "language", "size", F.length("content").cast("long").alias("n_chars"))


@query(
    f"""WITH {FILES}, {_TREE_SQL} SELECT path AS source_path, CASE WHEN NOT broken THEN md5(text) END AS digest, NOT broken AS readable FROM tree
WHERE text <> '' AND regexp_matches(path, '({"|".join(re.escape(e) for e in EXTENSIONS)})$') AND NOT regexp_matches(path, '{_IGNORED_RE(LOCAL_IGNORED_DIRS)}')"""
)
def local_discovery(spark, sf):
    """F3, S5, S6, U4 over the same tree: endings rather than extensions, whole files as points."""
    ship(spark)
    found = trees.discovered(trees.local_files(spark, document_tree(spark, sf)))
    return found.select("source_path", F.md5("document").alias("digest"), F.col("document").isNotNull().alias("readable"))


@query(f"WITH {FILES}, w AS (SELECT ingest_seq, repo, concat(path, CASE WHEN ingest_seq % 3 = 0 THEN '.gone' ELSE '' END) AS path FROM files) SELECT w.ingest_seq, md5(f.content) AS digest FROM w LEFT JOIN files f ON f.repo = w.repo AND f.path = w.path")
def content_lookup(spark, sf):
    """S4 for many paths, a third of which there are not."""
    held = file_rows(spark, sf).withColumnRenamed("path", "file_path")
    wanted = held.select("ingest_seq", "repo", F.concat("file_path", F.when(F.col("ingest_seq") % 3 == 0, ".gone").otherwise("")).alias("file_path"))
    return trees.contents(held, wanted).select("ingest_seq", F.md5("content").alias("digest"))


# Cache

NOW = 1_700_000_000.0
ENTRIES = """entries AS (SELECT concat(event_type, ':user', user_id, ':', event_id) AS key, event_type, props AS value, event_id AS access_seq, CAST(1700000000 - 300 + event_id % 600 AS DOUBLE) AS expires_at FROM events)"""


def cache_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    key = cache.key_of(F.col("event_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")), e)
    return table(spark, sf, "events").select(key.alias("key"), "event_type", F.col("props").alias("value"), e.alias("access_seq"), (F.lit(1_700_000_000 - 300) + e % 600).cast("double").alias("expires_at"))


@query(f"WITH {ENTRIES} SELECT count(*) AS size, count(*) FILTER (WHERE expires_at < 1700000000) AS expired FROM entries")
def cache_stats(spark, sf):
    return cache.stats(cache_rows(spark, sf), NOW)


_KINDS = ["repos", "repo", "tree", "content", "other"]


@query("SELECT event_id, ['repos', 'repo', 'tree', 'content', 'other'][CAST(event_id % 5 AS INTEGER) + 1] AS kind, CAST([300, 300, 600, 3600, 300][CAST(event_id % 5 AS INTEGER) + 1] AS DOUBLE) AS ttl, epoch_us(ts) // 1000000 + [300, 300, 600, 3600, 300][CAST(event_id % 5 AS INTEGER) + 1] AS expires_at FROM events")
def cache_ttl_lookup(spark, sf):
    """When an entry of each event's kind ends."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts")).withColumn("ttl", cache.ttl_of(F.col("kind")))
    return rows.select("event_id", "kind", "ttl", (F.unix_seconds("ts") + F.col("ttl").cast("long")).alias("expires_at"))


@query(f"WITH {ENTRIES} SELECT key, access_seq FROM entries ORDER BY access_seq DESC, key LIMIT 1000")
def cache_lru_keep(spark, sf):
    return cache.keep_recent(cache_rows(spark, sf).select("key", "access_seq"), 1000)


@query(f"WITH {ENTRIES}, x AS (SELECT event_type FROM entries ORDER BY event_type LIMIT 1) SELECT key FROM entries WHERE event_type <> (SELECT event_type FROM x)")
def cache_invalidate_prefix(spark, sf):
    rows = cache_rows(spark, sf)
    return cache.without_prefix(rows, rows.agg(F.min("event_type")).first()[0]).select("key")


@query(f"WITH {ENTRIES} SELECT key, value FROM entries WHERE expires_at >= 1700000000 AND key = (SELECT min(key) FROM entries)")
def cache_get(spark, sf):
    """C1."""
    rows = cache_rows(spark, sf)
    return cache.lookup(rows, rows.agg(F.min("key")).first()[0], NOW).select("key", "value")


@query(
    f"""WITH {ENTRIES}, m AS (SELECT concat(event_type, ':user', user_id, ':', event_id) AS key, 'new' AS value, event_id + 1000000 AS access_seq FROM events WHERE event_id % 9 = 0),
u AS (SELECT key, value, access_seq FROM entries WHERE key NOT IN (SELECT key FROM m) UNION ALL SELECT * FROM m) SELECT key, value, access_seq FROM u ORDER BY access_seq DESC, key LIMIT 700"""
)
def cache_put(spark, sf):
    """New values replace old ones, then the least recently used go."""
    rows = cache_rows(spark, sf).select("key", "value", "access_seq")
    new = table(spark, sf, "events").where("event_id % 9 = 0").select(
        cache.key_of(F.col("event_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")), F.col("event_id")).alias("key"), F.lit("new").alias("value"), (F.col("event_id") + 1_000_000).alias("access_seq")
    )
    return cache.put(rows, new, 700)


@query(f"WITH {ENTRIES} SELECT key, access_seq FROM entries WHERE expires_at >= 1700000000 ORDER BY access_seq DESC, key LIMIT 300")
def cache_load_valid(spark, sf):
    """C5."""
    return cache.load_valid(cache_rows(spark, sf), NOW, 300).select("key", "access_seq")


_REPO_KEYS = "k AS (SELECT unnest([concat('tree:', source), concat('tree:', source, ':', doc_id), concat('content:', source, ':doc', doc_id), concat('repo:', source)]) AS key FROM documents)"


@query(f"WITH {_REPO_KEYS} SELECT key FROM k WHERE key <> 'tree:src1' AND NOT starts_with(key, 'tree:src1:') AND NOT starts_with(key, 'content:src1:')")
def cache_invalidate_repo(spark, sf):
    """C6; src10 and the like stay."""
    s, d = F.col("source"), F.col("doc_id").cast("string")
    keys = F.array(F.concat(F.lit("tree:"), s), F.concat(F.lit("tree:"), s, F.lit(":"), d), F.concat(F.lit("content:"), s, F.lit(":doc"), d), F.concat(F.lit("repo:"), s))
    return cache.without_repo(table(spark, sf, "documents").select(F.explode(keys).alias("key")), "src1")


@query(f"WITH {ENTRIES} SELECT key, value FROM (SELECT key, value, access_seq FROM entries WHERE expires_at >= 1700000000 AND NOT starts_with(key, 'click:') ORDER BY access_seq DESC, key LIMIT 200)")
def cache_persisted(spark, sf):
    """Entries kept on disk, invalidated there, and taken over by another process."""
    home, own = fresh_path(spark, "cache"), CacheConfig(max_size=200)
    CacheTable(spark, home).replace(cache_rows(spark, sf).drop("event_type"))
    CacheStore(spark, home, own).invalidate(prefix="click")
    return CacheStore(spark, home, own).entries(NOW).select("key", "value")


CACHE_TTL_S, CACHE_SHARDS, CACHE_SIZE = 86_400, 4, 12
_OP = "CASE event_type WHEN 'purchase' THEN 'put' WHEN 'click' THEN 'put' WHEN 'error' THEN 'drop' ELSE 'get' END"


def cache_requests(events: DataFrame) -> DataFrame:
    """Events as requests to a cache: some put what they hold under their user, some ask for it, some drop it."""
    kind = F.col("event_type")
    op = F.when(kind.isin("purchase", "click"), "put").when(kind == "error", "drop").otherwise("get")
    return events.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % CACHE_SHARDS).alias("shard"))


@query(
    f"""WITH RECURSIVE asked AS (
  SELECT user_id % {CACHE_SHARDS} AS shard, concat('user', user_id) AS key, event_id AS seq, {_OP} AS op, props AS value, epoch_us(ts) AS now, row_number() OVER (PARTITION BY user_id % {CACHE_SHARDS} ORDER BY ts, event_id) AS n FROM events
), run AS (
  SELECT DISTINCT shard, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS value, FALSE AS hit, CAST([] AS STRUCT(k VARCHAR, v VARCHAR, e BIGINT)[]) AS held FROM asked
  UNION ALL
  SELECT shard, n, seq, CASE WHEN op = 'put' THEN own WHEN op = 'get' THEN found END, op = 'get' AND at_hand,
    CASE WHEN op = 'put' THEN list_slice(list_append(others, struct_pack(k := key, v := own, e := now + {CACHE_TTL_S * 1_000_000})), -{CACHE_SIZE}, -1) WHEN op = 'drop' THEN others WHEN at_hand THEN list_concat(others, same) ELSE others END
  FROM (
    SELECT a.shard, a.n, a.seq, a.op, a.key, a.value AS own, a.now, list_filter(r.held, lambda x: x.e >= a.now AND x.k <> a.key) AS others, list_filter(r.held, lambda x: x.e >= a.now AND x.k = a.key) AS same,
      len(list_filter(r.held, lambda x: x.e >= a.now AND x.k = a.key)) > 0 AS at_hand, list_filter(r.held, lambda x: x.e >= a.now AND x.k = a.key)[1].v AS found
    FROM run r JOIN asked a ON r.shard = a.shard AND a.n = r.n + 1
  )
) SELECT r.seq, a.op, r.value, r.hit FROM run r JOIN asked a ON r.seq = a.seq"""
)
def cache_stream_replay(spark, sf):
    """The answers of a cache kept as streaming state, with eviction and time to live, to all events in order."""
    ship(spark)
    home = fresh_path(spark, "cache-stream")
    events = cache_requests(table(spark, sf, "events"))
    events.repartitionByRange(6, "at").sortWithinPartitions("at").write.parquet(f"{home}/all")
    for k, path in enumerate(sorted(r["p"] for r in spark.read.parquet(f"{home}/all").select(F.input_file_name().alias("p")).distinct().collect())):
        spark.read.schema(events.schema).parquet(path).coalesce(1).write.mode("append").parquet(f"{home}/in/{k}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    answers = cached(stream, CACHE_TTL_S, capacity=CACHE_SIZE)
    answers.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").option("path", f"{home}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out").select("seq", "op", "value", "hit")


@query(f"WITH {ENTRIES}, g AS (SELECT key FROM entries ORDER BY access_seq LIMIT 12) SELECT key, CASE WHEN expires_at >= 1700000000 THEN value END AS value, CAST(1 AS BIGINT) AS versions FROM entries WHERE key IN (SELECT key FROM g)")
def cache_store_reads(spark, sf):
    """Reads of a stored cache; they leave as many versions as there were."""
    home = fresh_path(spark, "cache")
    rows = cache_rows(spark, sf).drop("event_type")
    CacheTable(spark, home).replace(rows)
    store = CacheStore(spark, home, CacheConfig(max_size=10**9))
    got = [(r["key"], store.get(r["key"], NOW)) for r in rows.orderBy("access_seq").limit(12).select("key").collect()]
    return spark.createDataFrame(got, "key string, value string").withColumn("versions", F.lit(len(store.table.versions())).cast("long"))


@query("SELECT source AS repo, substr(md5(source), 1, 12) AS short_name FROM documents GROUP BY source")
def progress_short_name(spark, sf):
    """X27."""
    return table(spark, sf, "documents").select(F.col("source").alias("repo")).distinct().withColumn("short_name", cache.short_name(F.col("repo")))


@query(f"WITH {ENTRIES} SELECT key, concat(md5(key), '.json') AS file_name, concat('repos:', CASE WHEN access_seq % 2 = 0 THEN 'True' ELSE 'False' END, ':', access_seq) AS list_key FROM entries")
def cache_keys(spark, sf):
    flag = cache.flag(F.col("access_seq") % 2 == 0)
    return cache_rows(spark, sf).select("key", cache.file_name(F.col("key")).alias("file_name"), cache.key_of("repos", flag, F.col("access_seq")).alias("list_key"))


@query(f"WITH {ENTRIES} SELECT key, CASE WHEN expires_at >= 1700000000 THEN value ELSE concat('fresh ', access_seq) END AS value, expires_at >= 1700000000 AS hit FROM entries")
def cache_readthrough(spark, sf):
    rows = cache_rows(spark, sf)
    origin = rows.select("key", F.concat(F.lit("fresh "), F.col("access_seq").cast("string")).alias("value"))
    return cache.read_through(rows.select("key"), rows, origin, NOW)


# Validation


@query(
    f"""WITH {BANK}, v AS (SELECT ingest_seq, document AS content, CASE WHEN ingest_seq % 7 = 0 THEN 'ab' ELSE title END AS title, substr(document, 1, 12) AS description,
  CASE WHEN ingest_seq % 5 = 0 THEN upper(category) WHEN ingest_seq % 5 = 1 THEN 'nope' ELSE category END AS category, CASE WHEN language = 'en' THEN 'Python' ELSE language END AS language, CAST(ingest_seq % 13 AS INTEGER) AS quality_score FROM bank)
SELECT ingest_seq, array_to_string(list_filter([CASE WHEN length(content) < 10 THEN 'content' END, CASE WHEN length(title) < 3 OR length(title) > 200 THEN 'title' END, CASE WHEN length(description) < 10 THEN 'description' END,
  CASE WHEN lower(category) NOT IN ('architecture','error_handling','configuration','testing','api_design','data_access','security','logging','utilities','other') THEN 'category' END,
  CASE WHEN lower(language) NOT IN ('python','java','javascript','typescript','go','unknown') THEN 'language' END, CASE WHEN quality_score < 1 OR quality_score > 10 THEN 'quality_score' END], lambda x: x IS NOT NULL), ',') AS errors FROM v"""
)
def validate_store(spark, sf):
    n = F.col("ingest_seq")
    rows = bank.document_bank(spark, sf).select(
        "ingest_seq", F.col("document").alias("content"), F.when(n % 7 == 0, "ab").otherwise(F.col("title")).alias("title"), F.substring("document", 1, 12).alias("description"),
        F.when(n % 5 == 0, F.upper("category")).when(n % 5 == 1, "nope").otherwise(F.col("category")).alias("category"), F.when(F.col("language") == "en", "Python").otherwise(F.col("language")).alias("language"), (n % 13).cast("int").alias("quality_score"),
    )
    return rows.select("ingest_seq", F.array_join(validate.store_errors(), ",").alias("errors"))


@query(
    f"""WITH q AS (SELECT doc_id, substr(text, 1, CAST(doc_id % 6 AS INTEGER)) AS query, CASE WHEN doc_id % 9 > 0 THEN doc_id % 120 END AS lim, CASE WHEN doc_id % 8 > 0 THEN doc_id % 13 END AS least,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PYTHON' WHEN 2 THEN lang ELSE 'go' END AS language, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Security' WHEN 2 THEN source ELSE 'testing' END AS category FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN length(query) < 3 THEN 'query' END, CASE WHEN coalesce(lim, 10) NOT BETWEEN 1 AND 100 THEN 'limit' END, CASE WHEN coalesce(least, 5) NOT BETWEEN 1 AND 10 THEN 'min_quality' END,
  CASE WHEN lower(language) NOT IN {_LIST(LANGUAGES)} THEN 'language' END, CASE WHEN lower(category) NOT IN {_LIST(CATEGORIES)} THEN 'category' END) AS errors FROM q"""
)
def validate_search(spark, sf):
    """Searches that the documents stand for, some with no good query, limit, quality, language or category."""
    n = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        n, F.substring("text", F.lit(1), (n % 6).cast("int")).alias("query"), F.when(n % 9 > 0, n % 120).cast("int").alias("limit"), F.when(n % 8 > 0, n % 13).cast("int").alias("min_quality"),
        F.when(n % 5 == 1, "PYTHON").when(n % 5 == 2, F.col("lang")).when(n % 5 > 2, "go").alias("language"), F.when(n % 7 == 1, "Security").when(n % 7 == 2, F.col("source")).when(n % 7 > 2, "testing").alias("category"),
    )
    return rows.select("doc_id", F.array_join(validate.search_errors(), ",").alias("errors"))
