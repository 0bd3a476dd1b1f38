"""Benchmark decontamination: documents that hold passages of benchmark items, by a prefix-filtered set join.

An item is cut into windows of ten words (a shorter item is one window). A window is a set of shingles of five words; a
document holds the window only if it holds all of them, so one is a sufficient prefix: with the shingles ordered by how
often they occur in the documents, the rarest one. Windows of which a shingle occurs nowhere are out at once. The others
meet the documents' shingles by their rarest one; where a window would begin before the document or end behind it, the
place is out (length and position), and what is left is compared word by word.

Everything here is DataFrame functions. The documents are read once to count and once to find; neither their texts nor
their shingles are shuffled, only verified hits are, repeated ones combined before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.llm.common import fenced, joinable, place_bits, without
from patternmill.session import stored

#: Words after A-Z are in lower case: runs of a-z, 0-9 and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words. Cutting there takes a tenth of the time of matching the words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Shingles or windows of the benchmark that are broadcast at once; a larger benchmark goes in blocks of about as many.
BLOCK_ROWS = 250_000

ADDED = ["n_words", "n_hit", "items", "contaminated"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), GAP, -1), "")


def _mark(text: Column) -> list[Column]:
    """128 bits that stand for a text; equal texts have equal hits."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("__m1"), F.xxhash64(F.lit(1), t).alias("__m2")]


def _hash(words: list[Column]) -> Column:
    """The hash of a shingle; its length counts."""
    return F.xxhash64(F.lit(len(words)), *words)


def windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Stored rows (window, words, n) of the different windows of all items, and (window, item): which items have them.

    size is 63 at most. Items are told apart by their key as a string; a null key counts as empty. Null texts and texts
    without words have no window.
    """
    cut = fenced(items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("all")), "all").where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - size + 1))
    every = stored(cut.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), F.lit(size)).alias("words")).distinct(), "item-windows")
    one = stored(every.select("words").distinct().withColumn("n", F.size("words")).withColumn("window", F.monotonically_increasing_id()), "windows")
    return one, stored(every.join(joinable(one.select("window", "words"), BLOCK_ROWS), "words").select("window", "item"), "window-items")


def _shingles(found: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """A row (keep, pos, hash) for each place (from 0) of the array column words and each of the lengths that fits there."""
    top = max(lengths)
    rest = [F.slice("words", F.lit(k + 1), F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(1, top)]
    placed = found.select(*keep, F.posexplode(F.arrays_zip(F.col("words").alias("w0"), *rest)).alias("pos", "z"))
    w = [F.col(f"z.w{k}") for k in range(top)]
    if len(lengths) == 1:
        return placed.select(*keep, "pos", F.when(w[-1].isNotNull(), _hash(w)).alias("hash")).where("hash IS NOT NULL")
    some = F.explode(F.array(*[F.when(w[n - 1].isNotNull(), _hash(w[:n])) for n in lengths])).alias("hash")
    return placed.select(*keep, "pos", some).where("hash IS NOT NULL")


def _blocks(rows: DataFrame) -> list[DataFrame]:
    """The rows, which have a hash, in blocks of about BLOCK_ROWS."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    return [F.broadcast(rows.where(F.pmod("hash", F.lit(n)) == k) if n > 1 else rows) for k in range(n)]


def _lengths(one: DataFrame, shingle: int) -> list[int]:
    """The lengths of shingles that the windows need: shorter ones for windows of fewer words."""
    return sorted(r["s"] for r in one.select(F.least("n", F.lit(shingle)).alias("s")).distinct().collect())


def rarest(docs: DataFrame, one: DataFrame, lengths: list[int], shingle: int, text: str = "text") -> DataFrame:
    """Stored rows (hash, offset, window, n, wanted): the rarest shingle of each window that may occur in the documents, by their counts over all documents."""
    parts = [_shingles(one.where(F.least("n", F.lit(shingle)) == s).select("window", "n", "words"), [s], "window", "n", "words") for s in lengths]
    own = stored(reduce(DataFrame.unionByName, parts).withColumnRenamed("pos", "offset"), "window-shingles")
    read = fenced(docs.select(words_of(F.col(text)).alias("words")), "words")
    counts = [_shingles(read, lengths).join(block, "hash").groupBy("hash").agg(F.count("*").alias("often")) for block in _blocks(own.select("hash").distinct())]
    often = stored(reduce(DataFrame.unionByName, counts), "shingle-counts")
    met = own.join(joinable(often, BLOCK_ROWS), "hash", "left")
    least = met.groupBy("window").agg(F.min(F.struct("often", "hash", "offset")).alias("p"), F.count_if(F.col("often").isNull()).alias("absent"), F.first("n").alias("n"), F.first("words").alias("words"))
    return stored(least.where("absent = 0").select("p.hash", "p.offset", "window", "n", F.array_join("words", " ").alias("wanted")), "prefixes")


def hits(docs: DataFrame, one: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Stored rows (__m1, __m2, start, n, window), once for each window and place (in words, from 0) of each different text of docs."""
    lengths = _lengths(one, shingle)
    if not lengths:
        return docs.select(*_mark(F.col(text)), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("window")).limit(0)
    read = fenced(docs.select(*_mark(F.col(text)), words_of(F.col(text)).alias("words")), "words")
    found = []
    for block in _blocks(rarest(docs, one, lengths, shingle, text)):
        start = F.col("pos") - F.col("offset")
        met = _shingles(read, lengths, "__m1", "__m2", "words").join(block, "hash").withColumn("start", start)
        fits = met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("words")))
        found.append(fits.where(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ") == F.col("wanted")).select("__m1", "__m2", "start", "n", "window"))
    return stored(reduce(DataFrame.unionByName, found).distinct(), "contamination")


def covered(found: DataFrame) -> DataFrame:
    """(__m1, __m2, n_hit): words inside hits, as bits of words of 64 places, so that no task holds all hits of a long text."""
    cut = found.select("__m1", "__m2", F.explode(place_bits(F.col("start"), F.col("n"))).alias("c"))
    return cut.groupBy("__m1", "__m2", "c.at").agg(F.bit_or("c.bits").alias("bits")).groupBy("__m1", "__m2").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_hit"))


def items_of(found: DataFrame, owners: DataFrame) -> DataFrame:
    """(__m1, __m2, items): the items of whose windows one occurs, in the order of strings."""
    pairs = found.select("__m1", "__m2", "window").distinct().join(joinable(owners), "window").select("__m1", "__m2", "item").distinct()
    return pairs.groupBy("__m1", "__m2").agg(F.array_sort(F.collect_set("item")).alias("items"))


def passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = WINDOW) -> DataFrame:
    """Rows (key, start, n, item): each place of a document, in words, where a window of an item stands; rows with equal texts repeat them."""
    one, owners = windows(items, item, text, size)
    found = hits(docs, one, text).join(joinable(owners), "window")
    return docs.select(F.col(key), *_mark(F.col(text))).join(joinable(found), ["__m1", "__m2"]).select(key, "start", "n", "item")


def with_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """All rows of docs with n_words, n_hit (words in an occurrence of a window), items (those with an occurring window) and contaminated.

    Null and empty texts have no words and are not contaminated. Repeated rows, shared or missing ids get each their own
    result, as it depends on the text alone. Columns with the added names are replaced. No items, or none with words,
    give no hits. Texts are read whole; a row's words are in memory at once.
    """
    one, owners = windows(items, item, item_text, size)
    found = hits(docs, one, text)
    told = covered(found).join(items_of(found, owners), ["__m1", "__m2"])
    counted = without(docs, *ADDED).select("*", *_mark(F.col(text)), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    n, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    joined = counted.join(joinable(told), ["__m1", "__m2"], "left").drop("__m1", "__m2")
    return joined.withColumn("n_hit", n).withColumn("items", F.coalesce("items", none)).withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no window of an item; an added column that they had goes in its old form."""
    marked = with_contamination(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), items, "__text")
    return marked.where("NOT contaminated").select("__row.*")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    told = with_contamination(docs.select("doc_id", "text"), items)
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = rf"""
WITH lists AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark
), cut AS (
  SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS pos FROM lists WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item, list_slice(w, pos, pos + {WINDOW} - 1) AS ws FROM cut
), docs AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}'), []) AS w FROM documents
), lens AS (
  SELECT DISTINCT len(ws) AS n FROM wanted
), places AS (
  SELECT rn, n, pos, list_slice(w, pos, pos + n - 1) AS ws FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM docs, lens)
), found AS (
  SELECT p.rn, p.n, p.pos, x.item FROM places p JOIN wanted x ON p.ws = x.ws
), hit AS (
  SELECT rn, count(DISTINCT place) AS n_hit FROM (SELECT rn, unnest(range(pos, pos + n)) AS place FROM found) GROUP BY rn
), named AS (
  SELECT rn, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (rn) LEFT JOIN named USING (rn)
"""
