"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i < t each shingle falls into a random one of t bins with a random value, in round t + i all fall
into bin i; a bin keeps the smallest value of the earliest round that reached it. Rounds end as soon as all bins are
full, so every coordinate fills after 2t rounds at most and two sketches agree in each coordinate with the
probability of the sets' similarity, concentrated like independent coordinates. Rows that share a band of
coordinates are candidates; the connected groups of candidates are brought together once, and links within a group
are confirmed on the full sets. Equal sets are one class throughout, so copies are not compared with each other.
A group too large for one task is first compared with the centres of its bands, which is linear; what that does not
join into one component meets in pairs of blocks, but never blocks of the same component, nor of sizes too far apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.llm.common import joinable, packed, slices
from patternmill.llm.graph import components
from patternmill.session import forget, stored

#: 40 bands of 5 coordinates: a pair at 0.8 is missed with a probability of 1e-7 (32 bands of 6 do as well at 0.85).
BANDS, ROWS = 40, 5
#: Shingles that one task compares, about; groups that have more are cut into blocks.
TASK_SHINGLES = 1_500_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW48 = np.uint64((1 << 48) - 1)
_WORDS: dict[bytes, int] = {}


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each number (a finalizer of multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z in lower case); few words are one shingle."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _WORDS
    if len(known) > 150_000:
        known.clear()
    try:
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out ^ codes[k : len(codes) - n + 1 + k], k + 1)
    if n < size:
        out = mixed(out, 100 + n)
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketches (t numbers each) of non-empty sets."""
    out = np.full((len(sets), t), _FULL, np.uint64)
    flat = out.reshape(-1)
    lengths = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    for i in range(2 * t):
        h = mixed(values, 1000 + i)
        spot = (((h >> np.uint64(48)) * np.uint64(t)) >> np.uint64(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + spot, (h & _LOW48) | np.uint64(i << 48))
        filled = (out[np.unique(owner)] != _FULL).all(axis=1)
        if filled.any():
            open_rows = np.zeros(len(sets), bool)
            open_rows[np.unique(owner)[~filled]] = True
            keep = open_rows[owner]
            values, owner = values[keep], owner[keep]
            if not len(values):
                break
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band's coordinates and number."""
    cut = sketch.reshape(len(sketch), bands, rows)
    keys = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64), 7), (len(sketch), bands)).copy()
    for k in range(rows):
        keys = mixed(keys ^ cut[:, :, k], 50 + k)
    return keys


def sketch_rows(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows (key, n_shingles, set_hi, set_lo, bands): the set's size, a 128-bit hash of it, and its band keys (null for the empty set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text, 1 << 20):
            sets = [shingles(t, size) for t in piece.column(1).to_pylist()]
            some = [k for k, s in enumerate(sets) if len(s)]
            keys: list[list[int] | None] = [None] * len(sets)
            hi, lo = [0] * len(sets), [0] * len(sets)
            if some:
                full = [sets[k] for k in some]
                banded = band_keys(sketches(full, bands * rows), bands, rows).view(np.int64).tolist()
                for k, (a, b), c in zip(some, map(set_name, full), banded, strict=True):
                    hi[k], lo[k], keys[k] = a, b, c
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=[key, "n_shingles", "set_hi", "set_lo", "bands"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_shingles long, set_hi long, set_lo long, bands array<long>")


def set_name(own: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(np.add.reduce(mixed(own, s)).view(np.int64)) for s in (3, 4))


def shared_with(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of the other sets (sorted, not empty) has in common with the one."""
    joined = np.concatenate(others)
    place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
    return np.add.reduceat((own[place] == joined).astype(np.int64), np.concatenate([[0], np.cumsum([len(c) for c in others])[:-1]]))


def rarest(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (owner, place, number) by owner and place: of each set the rarest numbers, of which any linked set has one too.

    Numbers are named by their rank, those in the fewest sets first. A set of n numbers shares ceil(n * percent / 100)
    of them with a linked one, so the first n + 1 less that many are enough. Numbers of one set alone are left out.
    """
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_often = np.argsort(often, kind="stable")
    rank = np.empty(len(often), np.int64)
    rank[by_often] = np.arange(len(often))
    number = rank[code]
    number = number[np.lexsort((number, owner))]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = (place <= (lengths + (-percent * lengths) // 100)[owner]) & (often[by_often][number] > 1)
    return owner[keep], place[keep], number[keep]


def linked(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[int]:
    """For each set (sorted, distinct, non-empty) the label of its component under 100 * shared >= percent * united.

    Sets with equal numbers in `known` are in one component already. Sets come by size, and each meets the earlier ones
    that share one of its rarest numbers, could share enough from there on and are not yet in its component, near sizes
    first; so all links count, but pairs that would change nothing or cannot be linked are not compared.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    label = np.arange(m) if known is None else np.unique(np.array(known), return_inverse=True)[1][order]
    owner, place, number = rarest([sets[j] for j in order], percent)
    by_number = np.argsort(number, kind="stable")
    holder, held_at = owner[by_number], place[by_number]
    first = np.searchsorted(number[by_number], number)
    earlier = np.empty(len(number), np.int64)
    earlier[by_number] = np.arange(len(number))
    earlier -= first
    bounds = np.searchsorted(owner, np.arange(m + 1))
    for k in range(1, m):
        own = slice(bounds[k], bounds[k + 1])
        n = earlier[own]
        if not n.any():
            continue
        rows = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        j = holder[rows]
        most = np.minimum(sizes[k] - np.repeat(place[own], n), sizes[j] - held_at[rows])
        rest = np.unique(j[(label[j] != label[k]) & ((100 + percent) * most >= percent * (sizes[k] + sizes[j]))])
        step = 4
        while len(rest):
            near, rest, step = rest[-step:], rest[:-step], 64
            shared = shared_with(sets[order[k]], [sets[order[x]] for x in near])
            for x in near[100 * shared >= percent * (sizes[k] + sizes[near] - shared)]:
                label[label == label[x]] = label[k]
            rest = rest[label[rest] != label[k]]
    out = [0] * m
    for k, j in enumerate(order.tolist()):
        out[j] = int(label[k])
    return out


def _texts(held: DataFrame, dealt: DataFrame) -> DataFrame:
    """The texts of the rows that are dealt out."""
    return held.select("__id", "__text").join(joinable(dealt), "__id")


def star_links(stars: DataFrame, members: DataFrame, held: DataFrame, size: int, percent: int, task_shingles: int) -> DataFrame:
    """The pairs (a, b) of (__id, center) that are linked; the rows of a centre are dealt over as many tasks as they need."""
    sized = stars.join(members.select("__id", "n_shingles"), "__id")
    parts = sized.groupBy("center").agg(F.ceil(F.sum("n_shingles") / task_shingles).cast("int").alias("parts"))
    dealt = sized.join(joinable(parts), "center").select("__id", "center", F.pmod(F.xxhash64("__id"), "parts").cast("int").alias("part"))
    own = parts.select(F.col("center").alias("__id"), "center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(told: pa.Table) -> pa.Table:
        ids, center = told.column("__id").to_pylist(), told.column("center")[0].as_py()
        sets = [shingles(t, size) for t in told.column("__text").to_pylist()]
        mine = sets[ids.index(center)]
        rest = [k for k, i in enumerate(ids) if i != center]
        lengths = np.array([len(sets[k]) for k in rest], np.int64)
        shared = shared_with(mine, [sets[k] for k in rest]) if rest else lengths
        near = [ids[k] for k, ok in zip(rest, (100 * shared >= percent * (len(mine) + lengths - shared)).tolist(), strict=True) if ok]
        return pa.table({"a": pa.array(near, pa.int64()), "b": pa.array([center] * len(near), pa.int64())})

    return _texts(held, dealt.unionByName(own)).groupBy("center", "part").applyInArrow(run, "a long, b long")


def block_links(dealt: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that span the components among the rows (__id, label, first, second) with one first and second; equal labels are linked already."""

    def run(told: pa.Table) -> pa.Table:
        ids = told.column("__id").to_pylist()
        labels = linked([shingles(t, size) for t in told.column("__text").to_pylist()], percent, told.column("label").to_pylist())
        least: dict[int, int] = {}
        for k, name in zip(ids, labels, strict=True):
            least[name] = min(k, least.get(name, k))
        pairs = [(k, least[name]) for k, name in zip(ids, labels, strict=True) if k != least[name]]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return _texts(held, dealt).groupBy("first", "second").applyInArrow(run, "a long, b long")


def meetings(members: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """Rows (__id, label, first, second) by which the members (__id, n_shingles, group, label) of large groups meet in pairs of blocks.

    Blocks hold one class of sizes; sets that are linked lie in the same or the next class. A component with more than
    a block has blocks of its own, which do not meet each other; all others share blocks.
    """
    several = members.groupBy("group").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("group")
    classed = members.join(joinable(several), "group").withColumn("kind", F.floor(F.ln("n_shingles") / F.lit(-1.001 * float(np.log(percent / 100)) if percent < 100 else 1.0)))
    by_label = classed.groupBy("group", "kind", "label").agg(F.sum("n_shingles").alias("n")).withColumn("own", F.when(F.col("n") > task_shingles, F.col("label")).otherwise(-1))
    units = by_label.groupBy("group", "kind", "own").agg(F.ceil(F.sum("n") / task_shingles).cast("int").alias("parts"))
    blocked = (
        classed.join(joinable(by_label.select("group", "kind", "label", "own")), ["group", "kind", "label"])
        .join(joinable(units), ["group", "kind", "own"])
        .withColumn("part", F.pmod(F.xxhash64(F.when(F.col("own") < 0, F.col("label")).otherwise(F.col("__id"))), "parts").cast("int"))
    )
    name = F.struct("group", "kind", "own", "part")
    blocks = units.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("group", name.alias("block"))
    other = blocks.select("group", F.col("block").alias("second"))
    near = (F.col("first") <= F.col("second")) & (F.abs(F.col("first.kind") - F.col("second.kind")) <= 1) & ((F.col("first.own") < 0) | (F.col("first.own") != F.col("second.own")))
    met = blocks.withColumnRenamed("block", "first").join(other, "group").where(near).select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    return blocked.select("__id", "label", name.alias("block")).join(joinable(met), "block").select("__id", "label", "first", "second")


def confirmed_links(members: DataFrame, stars: DataFrame, held: DataFrame, size: int, percent: int, task_shingles: int) -> DataFrame:
    """Links (a, b) that span the components of each candidate group; members: (__id, n_shingles, group), stars: (__id, center)."""
    groups = members.groupBy("group").agg((F.sum("n_shingles") > task_shingles).alias("large"))
    cut = stored(members.join(joinable(groups), "group"), "groups")
    small = cut.where("NOT large").select("__id", F.col("__id").alias("label"), F.col("group").alias("first"), F.col("group").alias("second"))
    links = stored(block_links(small, held, size, percent), "links")
    large = cut.where("large")
    if not large.limit(1).count():
        forget(cut)
        return links
    first = stored(star_links(stars.join(large.select("__id"), "__id"), large, held, size, percent, task_shingles), "links")
    label = components(first)
    labelled = stored(large.join(label.select(F.col("node").alias("__id"), F.col("component").alias("label")), "__id", "left").withColumn("label", F.coalesce("label", "__id")), "labelled")
    rest = stored(block_links(meetings(labelled, percent, task_shingles), held, size, percent), "links")
    every = stored(links.unionByName(first).unionByName(rest), "links")
    forget(cut, links, first, labelled, rest)
    return every


def component_rows(held: DataFrame, size: int, percent: int, bands: int, rows: int, task_shingles: int) -> DataFrame:
    """Stored (__id, n_shingles, node, least) for each row of held (__id, __key, __text): its component and the smallest key in it.

    held must be a written table, with whole numbers of their own as __id. An empty set is in no component (node null).
    """
    sketched = stored(sketch_rows(held, "__id", "__text", size, bands, rows), "sketches")
    keyed = sketched.drop("bands").join(held.select("__id", "__key"), "__id").where("n_shingles > 0")
    classes = stored(keyed.groupBy("set_hi", "set_lo").agg(F.min("__key").alias("least"), F.min("__id").alias("__id")), "classes")
    chosen = stored(sketched.select("__id", "n_shingles", "bands").join(classes.select("__id"), "__id"), "chosen")
    banded = chosen.select("__id", F.explode("bands").alias("band"))
    centers = banded.groupBy("band").agg(F.min("__id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = stored(banded.join(centers, "band").where(F.col("__id") != F.col("center")).select("__id", "center").distinct(), "stars")
    grouped = components(stars, "__id", "center")
    members = stored(chosen.drop("bands").join(grouped.select(F.col("node").alias("__id"), F.col("component").alias("group")), "__id"), "candidates")
    links = confirmed_links(members, stars, held, size, percent, task_shingles)
    label = components(links)
    named = classes.join(label.select(F.col("node").alias("__id"), "component"), "__id", "left").select("set_hi", "set_lo", "least", F.coalesce("component", "__id").alias("node"))
    smallest = named.groupBy("node").agg(F.min("least").alias("least"))
    named = stored(named.drop("least").join(smallest, "node"), "components")
    out = stored(sketched.select("__id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_hi")).alias("set_hi"), "set_lo").join(named, ["set_hi", "set_lo"], "left").select("__id", "n_shingles", "node", "least"), "verdicts")
    forget(sketched, classes, chosen, stars, members, links, named)
    return out


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, task_shingles: int = TASK_SHINGLES
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row; the key may be of any type that has an order.

    Rows are linked if their shingle sets share percent / 100 of what they unite; component_id is the smallest key
    that can be reached. Texts without words have the empty set, are linked with nothing and kept. Repeated rows get
    the same values. A row without a key is linked like any other and gets the smallest key of its component; it is
    kept only if there is none. A key with several texts is in the component of each. Other columns do not matter.
    """
    held = stored(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__id")), "texts")
    found = component_rows(held, size, percent, bands, rows, task_shingles)
    joined = held.select("__id", "__key").join(found, "__id")
    component = F.when(F.col("node").isNull(), F.col("__key")).otherwise(F.col("least"))
    out = joined.select(F.col("__key").alias(key), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))


def kept_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one for each component: that with the smallest doc_id, one without a doc_id only if there is no other.

    Of rows that share it the one with the smallest hash of the text stays. Rows without words are kept.
    """
    held = stored(packed(docs, docs["doc_id"].alias("__key"), docs["text"].alias("__text"), F.monotonically_increasing_id().alias("__id")).withColumn("__row", F.col("__row").dropFields("text")), "texts")
    found = component_rows(held, size, percent, BANDS, ROWS, TASK_SHINGLES)
    told = held.select("__id", "__key", F.xxhash64("__text").alias("__mark")).join(found, "__id")
    order = F.struct(F.col("__key").isNull(), "__key", "__mark", "__id")
    first = told.where("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("first")).select(F.col("first.__id").alias("__id"))
    kept = stored(first.unionByName(told.where("node IS NULL").select("__id")), "kept")
    forget(found)
    names = [F.col("__text").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    # Ids grow with the rows, so they are shuffled at every size; a hash table of a partition of them is small.
    return held.join(kept.hint("shuffle_hash"), "__id", "left_semi").select(*names)


#: The same in DuckDB's SQL.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT rid, md5_number(concat_ws(chr(0), CAST(least(len(ws), 3) AS VARCHAR), ws[i], CASE WHEN len(ws) > 1 THEN ws[i + 1] END, CASE WHEN len(ws) > 2 THEN ws[i + 2] END)) AS k
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_shingles, md5(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k)) AS name FROM s GROUP BY rid),
c AS (SELECT name, min(rid) AS rid, any_value(n_shingles) AS n FROM n GROUP BY name),
t AS (SELECT s.rid, k, n, count(*) OVER (PARTITION BY k) AS often FROM s JOIN c ON c.rid = s.rid),
o AS (SELECT rid, k, n, row_number() OVER (PARTITION BY rid ORDER BY often, k) AS place FROM t),
p AS (SELECT rid, k, n FROM o WHERE place <= n - CAST(ceil(85 * n / 100.0) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.k = b.k AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
both_have AS (SELECT a, b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS both_n FROM cand JOIN s x ON x.rid = a JOIN s y ON y.rid = b AND x.k = y.k GROUP BY a, b),
link AS (SELECT a, b FROM both_have WHERE 100 * both_n >= 85 * (na + nb - both_n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rid AS a, rid AS b FROM c UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
label AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN c ON c.rid = reach.b JOIN n ON n.name = c.name JOIN d ON d.rid = n.rid GROUP BY a)
SELECT d.doc_id, coalesce(n.n_shingles, 0) AS n_shingles, CASE WHEN n.rid IS NULL THEN d.doc_id ELSE component_id END AS component_id,
  (d.doc_id = CASE WHEN n.rid IS NULL THEN d.doc_id ELSE component_id END) AS kept
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN c ON c.name = n.name LEFT JOIN label ON label.a = c.rid
"""
