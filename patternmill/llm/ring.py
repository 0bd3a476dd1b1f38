"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

A row stands on the ring at the hash of its key; it belongs to the next virtual node clockwise. A shard takes no more
rows than its capacity: rows that find it full go on clockwise to the next virtual node of a shard with room. The walk
needs only the number of rows on each arc between virtual nodes, so it is done on those counts, whose number is a
parameter; it tells which ranks of an arc go to which shard. Rows then learn their rank within their arc from windows
over bounded cells; rows that are alike are counted first and take their ranks together. Everything on the rows is
DataFrame functions.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternmill.llm.common import unsigned_crc32, without
from patternmill.session import stored

#: Places on the ring; the table that maps a place to its arc has so many rows and is broadcast.
PLACES = 1 << 16
REPLICAS = 64
#: Rows in a cell of an arc, about; ranks come from windows over cells. There are no more than MOST_CELLS cells and one per arc.
CELL_ROWS, MOST_CELLS = 1_000, 1_000_000
#: Alike rows that one step writes out at once.
COPIES = 10_000


class Span(NamedTuple):
    """Ranks [first, end) of an arc go to a shard, the first of them to the given slot."""

    arc: int
    first: int
    end: int
    shard: int
    slot: int


def virtual_nodes(spark: SparkSession, shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node in ring order. A shard's nodes do not depend on how many shards there are."""
    ids = spark.range(shards * replicas).select((F.col("id") / replicas).cast("int").alias("shard"), (F.col("id") % replicas).cast("int").alias("replica"))
    rows = ids.select("shard", "replica", F.pmod(F.xxhash64(F.lit("node"), "shard", "replica"), F.lit(PLACES)).alias("place")).collect()
    return [(r["place"], r["shard"]) for r in sorted(rows, key=lambda r: (r["place"], r["shard"], r["replica"]))]


def arcs_of_places(nodes: list[tuple[int, int]]) -> list[int]:
    """For each place the index of the next node clockwise, its own place included."""
    out, k = [], 0
    for place in range(PLACES):
        while k < len(nodes) and nodes[k][0] < place:
            k += 1
        out.append(k % len(nodes))
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Without slack they add up to the rows, so shards get equal numbers of rows, or one more; else ceil((1 + slack) * mean)."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[Span]:
    """Send the rows of each arc clockwise; those that wait longest are served first."""
    left, used = list(room), [0] * len(room)
    waiting: deque[tuple[int, int, int]] = deque()
    spans: list[Span] = []
    for lap in range(3):
        for arc, (_, shard) in enumerate(nodes):
            if lap == 0 and counts.get(arc):
                waiting.append((arc, 0, counts[arc]))
            while waiting and left[shard]:
                own, first, end = waiting.popleft()
                n = min(end - first, left[shard])
                spans.append(Span(own, first, first + n, shard, used[shard]))
                left[shard] -= n
                used[shard] += n
                if first + n < end:
                    waiting.appendleft((own, first + n, end))
        if not waiting:
            return spans
    raise ValueError("the capacities are less than the rows")


def assign(df: DataFrame, key: Column, order: list[str], shards: int = 24, replicas: int = REPLICAS, slack: float = 0.0) -> DataFrame:
    """Add shard and slot (0, 1, ... in each shard) to each row.

    key: what the ring hashes; rows with equal keys stand at one place and share a shard as far as it has room.
    order: columns that order rows; rows equal in key and order are interchangeable. df should be a narrow table of
    columns that Spark can group by, as rows that are alike are counted, once, and ranked as one. An empty df gives no
    rows; nulls in the key hash like any value. Columns named shard or slot already are replaced.
    """
    df = without(df, "shard", "slot")
    spark = df.sparkSession
    columns = df.columns
    df = stored(df.withColumn("__key", key).groupBy("__key", *columns).agg(F.count("*").alias("__n")), "ring-rows")
    nodes = virtual_nodes(spark, shards, replicas)
    arcs = arcs_of_places(nodes)
    placed = df.withColumn("__place", F.pmod(F.xxhash64("__key"), F.lit(PLACES)).cast("int"))

    def ring(**more: list[int]) -> DataFrame:
        held = {"__place": pa.array(range(PLACES), pa.int32()), "__arc": pa.array(arcs, pa.int32())} | {k: pa.array([v[a] for a in arcs], pa.int32()) for k, v in more.items()}
        return F.broadcast(spark.createDataFrame(pa.table(held)))

    counts = {r["__arc"]: r["n"] for r in placed.join(ring(), "__place").groupBy("__arc").agg(F.sum("__n").alias("n")).collect()}
    rows = sum(counts.values())
    spans = walk(counts, nodes, capacities(rows, shards, slack))
    cell_rows = max(CELL_ROWS, -(-rows // MOST_CELLS))
    cells = [max(1, -(-counts.get(a, 0) // cell_rows)) for a in range(len(nodes))]
    celled = placed.join(ring(__cells=cells), "__place").withColumn("__cell", F.pmod(F.xxhash64(*order), F.col("__cells")).cast("int"))
    before = lambda n, window: F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = celled.groupBy("__arc", "__cell").agg(F.sum("__n").alias("n")).withColumn("__base", before("n", Window.partitionBy("__arc").orderBy("__cell"))).drop("n")
    ties = [c for c in columns if c not in order]
    ranked = (
        celled.withColumn("__rank", before("__n", Window.partitionBy("__arc", "__cell").orderBy(*order, *ties)))
        .join(bases, ["__arc", "__cell"])
        .withColumn("__rank", F.col("__rank") + F.col("__base"))
    )
    table = pa.table({f"__{k}": pa.array([s[i] for s in spans], pa.int64() if k in ("first", "end", "at") else pa.int32()) for i, k in enumerate(("arc", "first", "end", "to", "at"))})
    told = F.broadcast(spark.createDataFrame(table).withColumnRenamed("__arc", "__of"))
    # A row that stands for several may lie in several spans; its copies are written out in steps that can be dealt out.
    joined = ranked.join(told, (F.col("__arc") == F.col("__of")) & (F.col("__rank") < F.col("__end")) & (F.col("__rank") + F.col("__n") > F.col("__first")))
    low, high = F.greatest("__rank", "__first"), F.least(F.col("__rank") + F.col("__n"), F.col("__end"))
    cut = joined.select(*columns, "__to", (F.col("__at") + low - F.col("__first")).alias("__low"), (F.col("__at") + high - F.col("__first")).alias("__high"))
    steps = cut.withColumn("__step", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1, F.lit(COPIES))))
    if df.where(F.col("__n") > COPIES).limit(1).count():
        steps = steps.repartition(F.xxhash64(*order, "__step"))
    slot = F.explode(F.sequence(F.col("__step"), F.least(F.col("__step") + COPIES, F.col("__high")) - 1))
    return steps.select(*columns, F.col("__to").alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put all documents into shards of equal numbers of rows; equal texts stand at one place of the ring."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), unsigned_crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group_hash"))
    placed = assign(narrow, F.col("group_hash"), ["group_hash", "doc_id", "size", "text_crc32"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
