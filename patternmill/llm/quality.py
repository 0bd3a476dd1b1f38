"""Document rules, and verdicts on hosts from the shrunken rates at which their documents fail.

Everything here is DataFrame functions. The failures of the document rules are added up by host; a beta prior is
fitted to the hosts' rates by moments; a host whose posterior mean is over the limit is rejected with all documents.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.llm.common import BLANK, WORD, fenced, joinable, packed, without
from patternmill.session import stored

#: A host is rejected if its posterior mean rate of failures is over this.
HOST_LIMIT = 0.5
#: The weight of the prior, in documents, stays within these bounds.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1e6

RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


class Prior(NamedTuple):
    alpha: float
    beta: float


def _repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words that lie in a window of three words found twice or more in the row; windows compare by 64-bit hash.

    Rows whose windows all differ are told by a hash set; for the others hashes are sorted with their positions,
    those with an equal neighbour kept, and the lengths that their windows add to what is covered summed up.
    """
    w = F.col(words)
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    hashed = df.withColumn("__windows", F.when(F.size(w) >= 3, windows).otherwise(F.array().cast("array<long>")))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = hashed.withColumn("__sorted", F.when(repeats, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s, last = F.col("__sorted"), F.size("__sorted") - 1
    alike = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))
    placed = ordered.withColumn("__places", F.sort_array(F.transform(F.filter(s, alike), lambda x: x["i"])))
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return placed.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("__windows", "__sorted", "__places")


def document_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns RULES to each row; no shuffle.

    A null or empty text has no words and fails, as do all texts of under 50 words and those of which over half the
    words lie in repeated windows. Columns that have these names already are replaced.
    """
    df = without(df, *RULES)
    t = F.coalesce(F.col(text), F.lit(""))
    split = df.withColumn("__text", t).withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD))
    counted = (
        split.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", (F.length("__text") - F.regexp_count("__text", F.lit(BLANK))).cast("long"))
        .withColumn("n_symbols", F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop("__lines", "__text")
    )
    done = fenced(_repeat_words(counted, "__words", "n_repeat_words").drop("__words"), *RULES)
    return done.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_counts(df: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """Documents and failures of each host; a null host is a host of its own."""
    return df.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), F.count_if(F.col(failed)).alias("host_failures"))


def fit_prior(hosts: DataFrame) -> Prior:
    """A beta prior by moments: the pooled mean, and the spread of the hosts' rates beyond what chance adds to each."""
    rate = F.col("host_failures") / F.col("host_docs")
    row = hosts.agg(
        F.sum("host_failures").alias("f"), F.sum("host_docs").alias("n"), F.count("*").alias("k"), F.sum(rate).alias("r"), F.sum(rate * rate).alias("rr"), F.sum(1.0 / F.col("host_docs")).alias("inv")
    ).first()
    if not row["k"]:
        return Prior(1.0, 1.0)
    mean, k = row["f"] / row["n"], row["k"]
    spread = row["rr"] / k - 2 * mean * row["r"] / k + mean * mean - mean * (1 - mean) * row["inv"] / k
    weight = PRIOR_MOST if spread <= 0 else min(PRIOR_MOST, max(PRIOR_LEAST, mean * (1 - mean) / spread - 1))
    return Prior(mean * weight, (1 - mean) * weight)


def host_verdicts(hosts: DataFrame, prior: Prior, limit: float = HOST_LIMIT) -> DataFrame:
    rate = (F.col("host_failures") + F.lit(prior.alpha)) / (F.col("host_docs") + F.lit(prior.alpha + prior.beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > limit)


def judge(df: DataFrame, hosts: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """Join the hosts' verdicts back: adds host_docs, host_failures, host_rate, host_rejected and kept."""
    told = joinable(hosts.withColumnRenamed("host", "__host"))
    joined = df.join(told, df[host].eqNullSafe(told["__host"]), "left").drop("__host")
    return joined.withColumn("kept", ~(F.col(failed) | F.coalesce("host_rejected", F.lit(False))))


def verdicts_of(df: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The stored rule results of all rows (doc_id, host and RULES) and the stored verdicts of their hosts."""
    rules = stored(document_rules(df.select("doc_id", host, text), text).drop(text), "rules")
    hosts = host_counts(rules, host)
    return rules, stored(host_verdicts(hosts, fit_prior(hosts), limit), "hosts")


def score_documents(docs: DataFrame) -> DataFrame:
    """Rules, rates and verdicts of all documents; the text is read once."""
    rules, hosts = verdicts_of(docs)
    kept: Column = F.col("kept")
    return judge(rules, hosts).select("doc_id", *RULES, kept, F.round("host_rate", 6).alias("host_rate"))


def kept_documents(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs (source, text and any others) that are kept. The rules are reckoned once; no text is shuffled."""
    ruled = document_rules(packed(docs, "source", "text"))
    rules = stored(ruled.select(F.when(~F.col("base_failed"), F.col("__row")).alias("__row"), "source", "base_failed"), "rules")
    hosts = host_counts(rules)
    verdicts = stored(host_verdicts(hosts, fit_prior(hosts), limit), "hosts")
    return judge(rules, verdicts).where("kept").select("__row.*")


#: The same in DuckDB's SQL.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT rid, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c >= 2),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid LEFT JOIN dup ON dup.rid = w.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END)::DOUBLE AS k FROM b GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mean, count(*) AS c, sum(k / n) AS r, sum((k / n) * (k / n)) AS rr, sum(1 / n) AS inv FROM h),
s AS (SELECT mean, rr / c - 2 * mean * r / c + mean * mean - mean * (1 - mean) * inv / c AS spread FROM m),
p AS (SELECT mean, CASE WHEN spread <= 0 THEN {PRIOR_MOST} ELSE least({PRIOR_MOST}, greatest({PRIOR_LEAST}, mean * (1 - mean) / spread - 1)) END AS weight FROM s),
v AS (SELECT source, (k + mean * weight) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR rate > {HOST_LIMIT}) AS kept, round(rate, 6) AS host_rate
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
