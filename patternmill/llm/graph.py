"""Connected components by alternating star steps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.session import forget, stored

#: Edges of a node that one task takes, about; and the share of all edges from which on a node counts as hot.
NODE_EDGES, HOT_SHARE = 500, 20_000


def components(edges: DataFrame, one: str = "a", two: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Large-star and small-star steps in turn until the edges stay the same. Each step is a minimum per node (combined
    before the shuffle) and a join in which the edges of a hot node are dealt over several tasks. Each round is a
    written table; the one before is deleted. Nulls and loops are left out; repeated edges count once; no edges give
    no rows.
    """
    now = stored(_down(edges.select(F.col(one).cast("long").alias("a"), F.col(two).cast("long").alias("b"))), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        told = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = stored(_down(_with_least(both.where("b > a"), told, mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))), "edges-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, now = now, stored(_down(small), "edges")
        before, mark = mark, _mark(now)
        forget(old, large)
        if before == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) with m of their node a; least: (a, m, n), n edges of the node.

    Nodes of over max(NODE_EDGES, total / HOT_SHARE) edges are hot; there are 2 * HOT_SHARE of them at most, so the
    table of them is broadcast, and their edges are dealt by the other end.
    """
    share = max(NODE_EDGES, total // HOT_SHARE)
    hot = F.broadcast(least.where(F.col("n") > share).select(F.col("a").alias("__hot"), F.ceil(F.col("n") / share).cast("int").alias("__parts")))
    dealt = edges.join(hot, F.col("a") == F.col("__hot"), "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("__parts")).cast("int"), F.lit(0)))
    parts = F.sequence(F.lit(0), F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("int") - 1).otherwise(0))
    copies = least.select("a", "m", F.explode(parts).alias("__part"))
    return dealt.join(copies, ["a", "__part"]).select("a", "b", "m")


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 20)), F.lit(0))).first())
