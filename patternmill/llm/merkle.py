"""A Merkle manifest of a dataset: hash trees by group, one tree over their roots, proofs, and checks of rows against it.

Rows become leaves (native SHA-256); the slim leaves are sorted by range. How many leaves of a group each partition of
the sorted table has, added up, gives each leaf its place in its group. A task builds what subtrees are complete within
the run of places it reads, whatever its bounds; nodes whose siblings lie with another task (under 2 * 15 a level and
run) are shuffled by the coordinate of their parent and finished level by level. Subroots are leaves of one more such
tree. Proofs go down the same way: a node's siblings, joined to those of its parent, from the root to blocks of 4,096
leaves; within a block a task rebuilds the lower levels from the leaves themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternmill.llm.common import joinable, small_enough, unsigned_crc32
from patternmill.session import stored

#: Children of a node, and the levels below the roots of blocks.
FANOUT, BLOCK_LEVELS = 16, 3
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

NODES = "grp string, n long, level int, idx long, hash string, ragged boolean"
PATH = "array<struct<before: string, after: string>>"


class Tree(NamedTuple):
    """leaves: (grp, pos, n, leaf, ...) in a stored table; nodes: (grp, n, level, idx, hash) of the subroots and of all nodes from the roots of blocks up; height: of the highest group."""

    leaves: DataFrame
    nodes: DataFrame
    height: int


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes, so that no two rows of values run together alike; null is a dash."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(c: Column) -> Column:
    """A string that is never null and sorts as the group does: null first, then by its UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))


def _h(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _width(n: int, level: int) -> int:
    """Nodes of a level above n leaves."""
    return -(-n // FANOUT**level)


def _height(n: int) -> int:
    level = 0
    while _width(n, level) > 1:
        level += 1
    return level


class _Run:
    """The nodes above leaves of one group that come in order; holds fewer than FANOUT hashes a level."""

    def __init__(self, grp: str, n: int, pos: int):
        self.grp, self.n, self.next, self.held, self.out = grp, n, pos, {}, []

    def feed(self, level: int, idx: int, digest: str) -> None:
        width, spot = _width(self.n, level), idx % FANOUT
        if width == 1:
            self.tell(level, idx, digest, False)
            return
        held = self.held.setdefault(level, [])
        if len(held) != spot:
            self.tell(level, idx, digest, True)
            return
        held.append(digest)
        if spot == FANOUT - 1 or idx == width - 1:
            for k, d in enumerate(held):
                self.tell(level, idx - spot + k, d, False)
            parent = _h(held)
            held.clear()
            self.feed(level + 1, idx // FANOUT, parent)

    def tell(self, level: int, idx: int, digest: str, ragged: bool) -> None:
        if ragged or level >= BLOCK_LEVELS or _width(self.n, level) == 1:
            self.out.append((self.grp, self.n, level, idx, digest, ragged))

    def end(self, after: int) -> None:
        """What is still held has siblings elsewhere; after is the place behind the last leaf."""
        at = after
        for level in range(_height(self.n)):
            held = self.held.get(level, [])
            for k, d in enumerate(held):
                self.tell(level, at - len(held) + k, d, True)
            at = (at - len(held)) // FANOUT


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, pos, n, leaf) to NODES; any order is right, runs in order are short work."""
    schema = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("ragged", pa.bool_())])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    run: _Run | None = None
    for batch in batches:
        for grp, pos, n, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run is None or run.grp != grp or run.next != pos:
                if run is not None:
                    run.end(run.next)
                    if run.out:
                        yield table(run.out)
                run = _Run(grp, n, pos)
            run.feed(0, pos, leaf)
            run.next = pos + 1
        if run is not None and run.out:
            yield table(run.out)
            run.out = []
    if run is not None:
        run.end(run.next)
        if run.out:
            yield table(run.out)


def located(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (grp, leaf, ...) of a stored table with their place (pos, from 0) in their group by the order columns (nulls first), and its size n.

    The sort is by range with the row's number last, so a group, or equal rows, may be dealt over many partitions.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    told = leaves.withColumn("__row", F.monotonically_increasing_id())
    ranged = told.repartitionByRange(*keys, "__row").sortWithinPartitions(*keys, "__row").drop("__row").withColumn("__at", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("__part", F.expr("shiftright(__at, 33)")), "sorted-leaves")
    counts = ranged.groupBy("grp", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("grp").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.select("grp", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(Window.partitionBy("grp")).alias("n")), "offsets")
    few = small_enough(offsets, 100_000)
    placed = ranged.join(F.broadcast(offsets) if few else offsets, ["grp", "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
    return placed if few else stored(placed.repartitionByRange("grp", "pos").sortWithinPartitions("grp", "pos"), "placed-leaves")


def _of(level: int) -> Column:
    """How many nodes the group of a row has at a level."""
    return F.ceil(F.col("n") / FANOUT**level)


def build(leaves: DataFrame, order: list[str]) -> Tree:
    """The trees over leaves (grp, leaf, ...), each group by the order columns; a group of one leaf has it as its root."""
    placed = located(leaves, order)
    built = stored(placed.select("grp", "pos", "n", "leaf").mapInArrow(_subtrees, NODES), "subtrees")
    height = _height(built.agg(F.max("n")).first()[0] or 1)
    ragged = built.where("ragged").drop("ragged")
    rows, now = [built.where(F.col("level") >= 0).drop("ragged")], ragged.where("level = 0")
    for level in range(height):
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
        above = now.groupBy("grp", "n", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(F.sha2(F.array_join(kids, ""), 256).alias("hash"))
        above = above.select("grp", "n", F.lit(level + 1).alias("level"), "idx", "hash")
        rows.append(above)
        now = above.where(_of(level + 1) > 1).unionByName(ragged.where(F.col("level") == level + 1))
    top = F.col("n") <= F.pow(F.lit(FANOUT), "level")
    return Tree(placed, stored(reduce(DataFrame.unionByName, rows).where((F.col("level") >= BLOCK_LEVELS) | top).withColumn("top", top), "tree-nodes"), height)


def block_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(grp, block, path, ...): the siblings of each block's root and of the nodes above it, up to the last root; above: (grp, path, ...) of the subroots."""
    rest = [c for c in above.columns if c != "grp"]
    tops = tree.nodes.where("top").select("grp", "level", "idx").join(above, "grp")
    done = [tops.where(F.col("level") <= BLOCK_LEVELS).drop("level")]
    now = tops.where(F.col("level") == tree.height).drop("level")
    for level in range(tree.height - 1, BLOCK_LEVELS - 1, -1):
        kids = tree.nodes.where((F.col("level") == level) & ~F.col("top")).groupBy("grp", F.floor(F.col("idx") / FANOUT).alias("up"))
        runs = kids.agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids")).select("grp", "up", "kids", F.posexplode("kids").alias("k", "kid"))
        joined = lambda part: F.array_join(F.transform(part, lambda x: x["hash"]), "")
        own = F.struct(joined(F.slice("kids", F.lit(1), F.col("k"))).alias("before"), joined(F.slice("kids", F.col("k") + 2, F.lit(FANOUT))).alias("after"))
        cut = runs.select("grp", "up", "kid.idx", F.array(own).alias("own"))
        low = cut.join(now.withColumnRenamed("idx", "up"), ["grp", "up"]).withColumn("path", F.concat("own", "path")).select("grp", "idx", *rest)
        now = low if level == BLOCK_LEVELS else low.unionByName(tops.where(F.col("level") == level).drop("level"))
        if level == BLOCK_LEVELS:
            done.append(low)
    return reduce(DataFrame.unionByName, done).withColumnRenamed("idx", "block")


def _levels(leaves: list[str], n: int) -> list[list[str]]:
    """The levels of a block, from its leaves up to its root."""
    levels = [leaves]
    for _ in range(BLOCK_LEVELS):
        last = levels[-1]
        if n <= BLOCK and len(last) == 1:
            break
        levels.append([_h(last[k : k + FANOUT]) for k in range(0, len(last), FANOUT)])
    return levels


def _path(levels: list[list[str]], spot: int) -> Iterator[tuple[str, str]]:
    """What stands before and behind a leaf and the nodes above it, below the block's root."""
    for level in levels[:-1]:
        low = spot - spot % FANOUT
        yield "".join(level[low:spot]), "".join(level[spot + 1 : low + FANOUT])
        spot //= FANOUT


def proofs(tree: Tree, above: DataFrame, keep: list[str], paths: bool = False) -> DataFrame:
    """A row for each leaf: keep, leaf, the columns of above, proof_sha256 (of all siblings in order), folded_root (from claimed, else the leaf, and the siblings) and, if asked for, path.

    leaves may have a column claimed: what a verifier has in place of the leaf. A task holds one block at a time.
    """
    kinds = dict(tree.leaves.dtypes) | dict(above.dtypes)
    rest = [c for c in above.columns if c not in ("grp", "path")]
    claimed = "claimed" in tree.leaves.columns
    own = tree.leaves.withColumn("block", F.floor(F.col("pos") / BLOCK)).select("grp", "block", "pos", "n", "leaf", *(["claimed"] if claimed else []), *keep)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("pos")
        leaves = rows.column("leaf").to_pylist()
        first = {c: right.column(c)[0].as_py() for c in ("path", *rest)}
        up = [(p["before"], p["after"]) for p in first["path"]]
        levels = _levels(leaves, rows.column("n")[0].as_py())
        others = rows.column("claimed").to_pylist() if claimed else leaves
        digests, folded, ways = [], [], []
        for spot, leaf in enumerate(leaves):
            told, now, way = sha256(), others[spot] or leaf, [*_path(levels, spot), *up]
            for before, after in way:
                told.update((before + after).encode())
                now = _h((before, now, after))
            digests.append(told.hexdigest())
            folded.append(now)
            if paths:
                ways.append([{"before": b, "after": a} for b, a in way])
        out = {c: rows.column(c) for c in (*keep, "leaf")} | {c: pa.array([first[c]] * len(leaves), right.schema.field(c).type) for c in rest} | {"proof_sha256": pa.array(digests), "folded_root": pa.array(folded)}
        if paths:
            out["path"] = pa.array(ways, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
        return pa.table(out)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, "leaf", *rest)) + ", proof_sha256 string, folded_root string" + (f", path {PATH}" if paths else "")
    return own.groupBy("grp", "block").cogroup(block_paths(tree, above).groupBy("grp", "block")).applyInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest(docs: DataFrame, claimed: Column | None = None, key: str = "doc_id", group: str = "source", fields: list[str] = FIELDS) -> tuple[Tree, DataFrame]:
    """The trees of docs by group, and (grp, subroot, root, path): each group's root with its own proof to the root of all.

    Leaves go by key, nulls first; rows of one key by their hash, so the order of the input does not count. A null group
    is a group of its own. No rows give no trees. claimed: other values to fold up the proofs, null for the leaf itself.
    """
    cols = {"grp": group_key(F.col(group)), "key": F.col(key), "leaf": leaf_hash(*[F.col(c) for c in fields])} | ({} if claimed is None else {"claimed": claimed})
    tree = build(stored(docs.select(*[c.alias(k) for k, c in cols.items()]), "leaves"), ["key", "leaf"])
    subroots = tree.nodes.where("top").select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("hash").alias("leaf"))
    roots = build(stored(subroots, "subroots"), ["of"])
    start = roots.nodes.where("top").select("grp", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    told = proofs(roots, start, ["of"], paths=True)
    return tree, stored(told.select(F.col("of").alias("grp"), F.col("leaf").alias("subroot"), "root", "path"), "subroot-proofs")


def inclusion_proofs(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: list[str] = FIELDS) -> DataFrame:
    """key, leaf, subroot, root and path of each row: hashing the leaf between before and after, step by step, gives the root."""
    tree, above = manifest(docs, None, key, group, fields)
    return proofs(tree, above, ["key"], paths=True).select(F.col("key").alias(key), "leaf", "subroot", "root", "path")


def report(docs: DataFrame) -> DataFrame:
    """Each row's proof, and what comes of it where the text has been tampered with: A-Z in lower case where 5 divides the CRC of the doc_id (never where that is null)."""
    values = [F.col(c) for c in FIELDS]
    hit = unsigned_crc32(F.col("doc_id").cast("string")) % 5 == 0
    claimed = F.when(hit & F.col("text").isNotNull(), leaf_hash(*values[:-1], lower_ascii(F.col("text"))))
    tree, above = manifest(docs, claimed)
    told = proofs(tree, above, ["key"])
    return told.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string: a fold over its bits, as DuckDB has no such function."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, b: xor(CAST(xor(c, b) AS BIGINT) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), {step}), 4294967295)"


def _field_sql(c: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _tree_sql(name: str, source: str, levels: int) -> str:
    """CTEs that lift rows (id, g, pos, n, h, f, proof) of source level by level; the last is {name}_{levels}, with subroot or root in h."""
    out = [f"{name}_0 AS (SELECT id, g, pos, n, h, f, proof FROM {source})"]
    for k in range(levels):
        out.append(f"{name}_r{k} AS (SELECT g, pos // {FANOUT} AS up, list(h ORDER BY pos) AS hs FROM (SELECT DISTINCT g, pos, h FROM {name}_{k}) GROUP BY g, pos // {FANOUT})")
        before, after = f"array_to_string(hs[1:pos % {FANOUT}], '')", f"array_to_string(hs[pos % {FANOUT} + 2:], '')"
        lift = lambda yes, no: f"CASE WHEN n = 1 THEN {no} ELSE {yes} END"
        out.append(
            f"{name}_{k + 1} AS (SELECT id, g, up AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n, {lift('sha256(array_to_string(hs, ' + chr(39) * 2 + '))', 'h')} AS h, {lift(f'sha256({before} || f || {after})', 'f')} AS f, "
            f"{lift(f'proof || {before} || {after}', 'proof')} AS proof FROM (SELECT * FROM {name}_{k} t JOIN {name}_r{k} r ON t.g = r.g AND t.pos // {FANOUT} = r.up) x(id, g, pos, n, h, f, proof, g2, up, hs))"
        )
    return ",\n".join(out)


_VALUES = " || ".join(_field_sql(c) for c in FIELDS)
_TAMPERED = " || ".join([*(_field_sql(c) for c in FIELDS[:-1]), _field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")])
ORACLE_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('1' || source, '0') AS g, sha256({_VALUES}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND ({crc32_sql('CAST(doc_id AS VARCHAR)')}) % 5 = 0 THEN sha256({_TAMPERED}) END AS claimed
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows
), start AS (
  SELECT id, g, pos, n, leaf AS h, coalesce(claimed, leaf) AS f, '' AS proof FROM numbered
), {_tree_sql('low', 'start', 6)},
tops AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT g, h FROM low_6)
), begun AS (
  SELECT l.id, 0 AS g, t.pos, t.n, l.h, l.f, l.proof FROM low_6 l JOIN tops t ON l.g = t.g
), {_tree_sql('high', 'begun', 4)}
SELECT doc_id, leaf, l.h AS subroot, u.h AS root, sha256(u.proof) AS proof_sha256, u.f AS folded_root, u.f = u.h AS verified
FROM rows r JOIN low_6 l ON r.id = l.id JOIN high_4 u ON r.id = u.id
"""
