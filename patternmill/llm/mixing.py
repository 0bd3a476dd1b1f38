"""Mix sources to target weights by drawing fixed-length blocks.

The words of each source are packed into blocks of a fixed number of words, documents one after the other within
groups of documents; blocks are numbered through a source. Blocks of large sources are longer, so that there are no more
of them than it takes to come near a target. An output shard is a fixed number of block slots, and how
many of its slots each source gets is a multinomial draw by the sources' quotas; draws beyond a quota go to sources
that drew less, so each source ends with its quota. The slots of a source, numbered through, map to its blocks by a
pseudorandom permutation of block numbers, another one for each time round; slots and blocks then join by number.
Everything is DataFrame functions; draws and permutations are hashes, so reruns agree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternmill.llm.common import WORD, fenced, joinable, packed, running_total, small_enough, text_mark
from patternmill.session import forget, stored

#: Weights of the sources in code point order, again and again; and all sources' share of all words.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words in a block, and the most that blocks of very large sources have; a source has this many blocks before its blocks grow.
BLOCK_WORDS, MOST_BLOCK_WORDS, MANY_BLOCKS = 32, 2048, 1 << 16
SHARD_SLOTS = 1024
GROUP_DOCS = 2048
ROUNDS = 12
#: Rows that one task makes of few, about, and the most tasks for that.
TASK_ROWS, MOST_TASKS = 100_000, 20_000


class Mix(NamedTuple):
    documents: DataFrame  # source_no, doc_id, source, size, group, offset (size > 0)
    sources: DataFrame  # source_no, source, source_size, target, block_words, blocks, quota
    pieces: DataFrame  # source_no, doc_id, size, group, offset, block, start, words
    slots: DataFrame  # shard, source_no, block
    empty: DataFrame  # source_no, doc_id, source of documents without words


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df over as many partitions as the rows that will be made of it ask for; a small table is one partition when read."""
    return df.repartition(min(MOST_TASKS, max(1, -(-rows // TASK_ROWS))))


def block_length(size: Column) -> Column:
    """Words in a block of a source of that many: BLOCK_WORDS, doubled as often as leaves it MANY_BLOCKS, up to MOST_BLOCK_WORDS."""
    doubled = F.floor(F.log2(F.greatest(size, F.lit(1)) / (BLOCK_WORDS * MANY_BLOCKS)))
    return F.least(F.lit(MOST_BLOCK_WORDS), BLOCK_WORDS * F.pow(F.lit(2), F.greatest(F.lit(0), doubled))).cast("long")


def unit(*parts: Column) -> Column:
    """A number from 0 to 2^62 - 1 from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source its number in code point order (null last), documents, size and target.

    The targets are min(most * size, level * weight) with the one level at which they add up to share * all sizes:
    what is over a source's limit has gone to the others by weight until none is above. The rows are sources, so the
    windows here hold one row per source.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").cast("long").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    numbered = totals.withColumn("source_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(most)
    ratio = Window.partitionBy(F.lit(0)).orderBy("__ratio", "source_no")
    levelled = (
        numbered.withColumn("__weight", weight)
        .withColumn("__limit", limit)
        .withColumn("__ratio", limit / F.col("__weight"))
        .withColumn("__need", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("__full", F.coalesce(F.sum("__limit").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__rest", F.sum("__weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__need") - F.col("__full")) / F.col("__rest"))
        # The level is that of the first source, by ratio, which it does not fill; all before it are full.
        .withColumn("__level", F.min(F.when(F.col("__level") < F.col("__ratio"), F.struct("__ratio", "source_no", "__level"))).over(every)["__level"])
    )
    target = F.coalesce(F.least("__limit", F.col("__level") * F.col("__weight")), F.col("__limit"))
    return levelled.select("source_no", "source", "source_docs", "source_size", target.alias("target"))


def permuted(df: DataFrame, value: str, size: str, seed: list[Column], rounds: int = ROUNDS) -> DataFrame:
    """Replace `value` in [0, size) by its image under a pseudorandom permutation of that range.

    Swap or not: each round pairs x with (key - x) mod size and swaps them or not by a hash of the larger one, so
    each round, and with it the whole, is one to one for every size.
    """
    n = F.col(size)

    def turn(x: Column, r: Column) -> Column:
        y = (F.pmod(F.xxhash64(*seed, r), n) + n - x) % n
        swap = F.xxhash64(*seed, r, F.lit("swap"), F.greatest(x, y)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, y).otherwise(x)

    # One fold, not a chain of projections: the optimizer would merge those into one expression of exponential size.
    return df.withColumn(value, F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), F.col(value), turn))


def located(df: DataFrame, value: str, spans: DataFrame, first: str, end: str, total: int, cells: int = 4096) -> DataFrame:
    """Join each row to the span [first, end) that holds its value; spans do not overlap.

    An equi-join on cells of equal width, each span being in all cells that it touches.
    """
    width = max(1, -(-total // cells))
    cut = spans.where(F.col(end) > F.col(first)).withColumn("__cell", F.explode(F.sequence((F.col(first) / width).cast("long"), ((F.col(end) - 1) / width).cast("long"))))
    return df.withColumn("__cell", F.floor(F.col(value) / width)).join(joinable(cut), "__cell").where((F.col(value) >= F.col(first)) & (F.col(value) < F.col(end))).drop("__cell")


def pack_blocks(sizes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the words of each source in blocks: (documents with offsets, groups with their blocks and first block).

    Documents go to groups of about GROUP_DOCS by hash, so no window holds a whole source; each group starts a block.
    A column mark, if there, is kept and settles ties.
    """
    mark = [c for c in sizes.columns if c == "mark"]
    told = sources.select(F.col("source").alias("__source"), "source_no", "block_words", F.greatest(F.lit(1), F.ceil(F.col("source_docs") / GROUP_DOCS)).alias("__groups"))
    joined = sizes.join(joinable(told), F.col("source").eqNullSafe(F.col("__source"))).where("size > 0")
    group = F.pmod(F.xxhash64(F.lit("group"), "doc_id", "size"), F.col("__groups"))
    within = Window.partitionBy("source_no", "group").orderBy("doc_id", "size", *mark).rowsBetween(Window.unboundedPreceding, -1)
    documents = joined.withColumn("group", group).withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)).cast("long")).select("source_no", "doc_id", *mark, "source", "size", "group", "offset", "block_words")
    documents = stored(documents, "mix-documents")
    groups = documents.groupBy("source_no", "group").agg(F.ceil(F.sum("size") / F.min("block_words")).cast("long").alias("blocks"))
    return documents, stored(running_total(groups, ["source_no"], "group", "blocks", "base"), "mix-groups")


def block_pieces(documents: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """The pieces of documents in blocks; blocks: how many there are in all."""
    mark = [c for c in documents.columns if c == "mark"]
    n = F.col("block_words")
    first, last = F.floor(F.col("offset") / n), F.floor((F.col("offset") + F.col("size") - 1) / n)
    low, high = F.greatest("offset", F.col("__b") * n), F.least(F.col("offset") + F.col("size"), (F.col("__b") + 1) * n)
    return (
        spread(documents.drop("source"), blocks)
        .join(joinable(groups.select("source_no", "group", "base")), ["source_no", "group"])
        .withColumn("__b", F.explode(F.sequence(first, last)))
        .select("source_no", "doc_id", *mark, "size", "group", "offset", (F.col("base") + F.col("__b")).alias("block"), (low - F.col("offset")).alias("start"), (high - low).alias("words"))
    )


def draw_slots(sources: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Rows (shard, source_no, rank): each source has the ranks 0 to quota - 1, dealt over output shards by multinomial draws."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota").alias("n")).first()["n"] or 0
    ordered = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    spans = sources.withColumn("low", F.coalesce(F.sum("quota").over(ordered), F.lit(0))).withColumn("high", F.col("low") + F.col("quota")).select("source_no", "low", "high")
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(unit(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(max(total, 1))).alias("draw"))
    counts = located(draws, "draw", spans, "low", "high", total).groupBy("source_no", "shard").agg(F.count("*").alias("n"))
    drawn = stored(running_total(counts, ["source_no"], "shard", "n", "base"), "mix-draws").join(joinable(sources.select("source_no", "quota")), "source_no")
    within = F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("base")))
    split = spread(drawn, total).withColumn("__in", within)
    ranks = lambda first, n: F.explode(F.sequence(first, first + n - 1))
    kept = split.where("__in > 0").select("shard", "source_no", ranks(F.col("base"), F.col("__in")).alias("rank"))
    # Draws beyond a quota, numbered by source, take the ranks that other sources miss, numbered by source too.
    got = drawn.groupBy("source_no").agg(F.sum("n").alias("got"))
    balance = sources.select("source_no", "quota").join(got, "source_no", "left").select("source_no", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    balance = balance.withColumn("__over", F.greatest(F.lit(0), F.col("got") - F.col("quota"))).withColumn("__under", F.greatest(F.lit(0), F.col("quota") - F.col("got")))
    balance = stored(balance.withColumn("__o", F.coalesce(F.sum("__over").over(ordered), F.lit(0))).withColumn("__u", F.coalesce(F.sum("__under").over(ordered), F.lit(0))), "mix-balance")
    spare = (
        split.where("n > __in")
        .join(joinable(balance.select("source_no", "__o")), "source_no")
        .select("shard", ranks(F.greatest("base", F.col("quota")) - F.col("quota") + F.col("__o"), F.col("n") - F.col("__in")).alias("spare"))
    )
    missing = balance.select("source_no", F.col("got").alias("__got"), F.col("__u").alias("low"), (F.col("__u") + F.col("__under")).alias("high"))
    moved = located(spare, "spare", missing, "low", "high", total).select("shard", "source_no", (F.col("__got") + F.col("spare") - F.col("low")).alias("rank"))
    return kept.unionByName(moved)


def mix(docs: DataFrame, seed: int = 1, text: str = "text", marked: bool = False) -> Mix:
    """Plan the mix of all documents (doc_id, source, text). Equal rows are interchangeable; a null text has no words.

    If marked, documents and pieces have the text_mark of their row as mark.
    Block numbers go up to twice round the blocks of a source, so no block, and no document, is taken more than twice.
    """
    mark = [text_mark(text).alias("mark")] if marked else []
    sizes = stored(docs.select("doc_id", *mark, "source", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size")), "mix-sizes")
    targets = stored(source_targets(sizes).withColumn("block_words", block_length(F.col("source_size"))), "mix-targets")
    documents, groups = pack_blocks(sizes, targets)
    blocks = groups.groupBy("source_no").agg(F.sum("blocks").cast("long").alias("blocks"))
    quota = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), MOST * F.col("blocks")).cast("long")
    sources = targets.join(blocks, "source_no", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)).cast("long"))
    sources = stored(sources.withColumn("quota", F.when(F.col("blocks") > 0, quota).otherwise(F.lit(0)).cast("long")), "mix-sources")
    pieces = block_pieces(documents, groups, sources.agg(F.sum("blocks").alias("n")).first()["n"] or 0)
    slots = draw_slots(sources, seed).join(joinable(sources.select("source_no", "blocks")), "source_no")
    turned = slots.select("shard", "source_no", "blocks", F.floor(F.col("rank") / F.col("blocks")).alias("turn"), (F.col("rank") % F.col("blocks")).alias("block"))
    turned = permuted(turned, "block", "blocks", [F.lit(seed), F.col("source_no"), F.col("turn")])
    empty = sizes.where("size = 0").join(joinable(targets.select(F.col("source").alias("__source"), "source_no")), F.col("source").eqNullSafe(F.col("__source"))).select("source_no", "doc_id", "source")
    return Mix(documents, sources, pieces, turned.select("shard", "source_no", "block"), empty)


def taken_pieces(plan: Mix) -> DataFrame:
    """The pieces with `times`, how often the mix takes each; joined to the slots by block number."""
    times = plan.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    return plan.pieces.join(times, ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per document its words in the mix, with its source's size and target."""
    plan = mix(docs, seed)
    taken = taken_pieces(plan).groupBy("source_no", "group", "offset", "doc_id", "size").agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken"))
    rows = taken.select("source_no", "doc_id", "size", "taken").unionByName(plan.empty.select("source_no", "doc_id", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("taken")))
    told = plan.sources.select("source_no", "source", "source_size", "target")
    return rows.join(joinable(told), "source_no").select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "source")


def mixed_texts(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each time round in which words of a document are taken.

    The first row of a document holds its pieces taken at least once, a second one those taken twice, in the order of
    the text. A whole document keeps its text; else the taken words are joined by single spaces. Pieces go to the
    row with their doc_id, text and source, those of equal rows to one of these each. n_chars, if there, is set anew.
    Documents without a taken word go.
    """
    plan = mix(docs, seed, marked=True)
    piece = F.struct("start", "words")
    chosen = taken_pieces(plan).where("times > 0").groupBy("source_no", "group", "offset", F.col("doc_id").alias("__doc"), F.col("mark").alias("__of"), "size")
    chosen = chosen.agg(F.array_sort(F.collect_list(piece)).alias("__first"), F.array_sort(F.collect_list(F.when(F.col("times") > 1, piece))).alias("__second"))
    held = packed(docs, "doc_id", "text", text_mark().alias("__mark"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__mark") == F.col("__of"))
    repeated = plan.documents.groupBy(F.col("doc_id").alias("__doc"), F.col("mark").alias("__of")).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    if not small_enough(repeated, 0):
        # Equal rows are numbered on both sides, so that each meets the pieces of one; only they are shuffled for that.
        repeated = joinable(stored(repeated, "mix-repeated"))
        chosen = chosen.withColumn("__take", F.row_number().over(Window.partitionBy("__doc", "__of").orderBy("group", "offset")))
        copies = held.join(repeated, same, "left_semi").withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "__mark").orderBy(F.lit(0))))
        held = held.join(repeated, same, "left_anti").withColumn("__copy", F.lit(1)).unionByName(copies)
        same = same & (F.col("__copy") == F.col("__take"))
    else:
        chosen = chosen.withColumn("__take", F.lit(1))
    lists = chosen.select("__doc", "__of", "__take", "size", F.explode(F.array("__first", "__second")).alias("__pieces")).where(F.size("__pieces") > 0)
    joined = held.join(lists, same)
    # Fenced, or the words of a text would be found anew for each of its pieces.
    joined = fenced(joined.withColumn("__words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), "__words")
    whole = F.aggregate("__pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("size")
    cut = F.array_join(F.flatten(F.transform("__pieces", lambda p: F.slice(F.col("__words"), (p["start"] + 1).cast("int"), p["words"].cast("int")))), " ")
    made = joined.withColumn("__cut", F.when(whole, F.col("text")).otherwise(cut))
    row = F.col("__row").withField("text", F.col("__cut"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("__cut").cast(docs.schema["n_chars"].dataType))
    return made.select(row.alias("__row")).select("__row.*")
