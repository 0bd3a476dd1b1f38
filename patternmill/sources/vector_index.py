"""An inverted-file index over a bank's vectors, so that a search reads few of them.

Centroids are learned from a bounded sample; every point of the bank goes to the cell of the centroid of the highest
cosine, and a cell is a bucket of a versioned table. A search looks at the centroids on the driver, and Spark reads the
folders of the chosen cells alone. As the index knows how far from its centroid each cell reaches, it can also tell
which cells may hold one of the best k at all, and so find exactly these without a scan of the rest.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from patternmill.operators.search import semantic_top
from patternmill.schema import BANK
from patternmill.session import forget, put_bytes, read_bytes, ship, stored
from patternmill.sources.derived import DerivedTable, marked, source_of
from patternmill.sources.tables import VersionedTable

#: Vectors that the centroids are learned from at most, rounds of k-means, and cells at most: this bounds what the driver holds.
SAMPLE, ROUNDS, MOST_CELLS = 50_000, 10, 4096
#: The cell of points without a vector, or with one of no length or another size.
NO_CELL = -1
#: Points and queries that a task compares at once in a search for many queries, about.
PART_POINTS, PART_QUERIES = 50_000, 2_000
#: Similarities that it holds at once.
HELD = 4_000_000
#: Similarities are compared to so many places, as sums in another order differ beyond.
PLACES = 12

INDEX = StructType([*BANK.fields, StructField("cell", IntegerType()), StructField("closeness", DoubleType()), StructField("digest", LongType())])


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column, of unit length, and which rows have one; the others are zeros."""
    out = np.zeros((len(column), dims))
    whole = column.null_count == 0 and (flat := column.flatten()).null_count == 0 and pc.all(pc.equal(pc.list_value_length(column), dims)).as_py()
    if whole:
        out[:] = flat.to_numpy(zero_copy_only=False).reshape(len(column), dims)
    for k, v in enumerate([] if whole else column.to_pylist()):
        if v is not None and len(v) == dims and None not in v:
            out[k] = v
    norms = np.sqrt((out * out).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    out[good] /= norms[good, None]
    out[~good] = 0
    return out, good


def assigned(points: DataFrame, centroids: np.ndarray, vector: str = "embedding", probes: int = 1) -> DataFrame:
    """Rows with cells (array<int>, the nearest first) and closeness, the cosine to the first one's centroid."""
    schema = StructType([*points.schema.fields]).add("cells", ArrayType(IntegerType())).add("closeness", DoubleType())
    centroids, n = centroids, min(probes, len(centroids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _matrix(batch.column(batch.schema.get_field_index(vector)), centroids.shape[1])
            near = x @ centroids.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :n] if n > 1 else near.argmax(axis=1)[:, None]
            cells = [row.tolist() if ok else [NO_CELL] for row, ok in zip(best, good, strict=True)]
            close = np.where(good, np.take_along_axis(near, best[:, :1], axis=1)[:, 0], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(close)], names=[*batch.schema.names, "cells", "closeness"])

    return points.mapInArrow(run, schema)


class VectorIndex(DerivedTable):
    """An index beside a bank's table. It is built once, and takes over what has changed in the bank by refresh."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, INDEX)
        self._held: tuple[str, np.ndarray] | None = None

    def _stats(self, rows: DataFrame) -> dict[int, dict]:
        told = rows.groupBy("cell").agg(F.min("closeness").alias("reach"), F.count("*").alias("n"))
        return {r["cell"]: {"reach": r["reach"], "n": r["n"]} for r in told.collect()}

    def centroids(self) -> np.ndarray:
        """The centroids of the newest version, of unit length."""
        name = self._state().about["centroids"]
        if self._held is None or self._held[0] != name:
            self._held = name, np.load(io.BytesIO(read_bytes(self.spark, f"{self.path}/{name}")))
        return self._held[1]

    def learn(self, points: DataFrame, cells: int | None, seed: int = 7) -> np.ndarray:
        """Centroids by k-means on the cosine of a sample of SAMPLE vectors at most, chosen by the hash of the id. cells: the root of the number of points unless given.

        Vectors of the size that most have are used.
        """
        usable = points.where("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x)) AND exists(embedding, x -> x <> 0)")
        sizes = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        if sizes is None:
            return np.zeros((0, 1))
        n, usable = sizes["count"], usable.where(F.size("embedding") == sizes["size"])
        share = F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 1.1 * SAMPLE / n) * (1 << 30))
        sample = stored(usable.where(share).select(array_to_vector("embedding").alias("features")).limit(SAMPLE), "index-sample")
        k = max(1, min(cells or round(n**0.5), MOST_CELLS, sample.count()))
        if k > 1:
            found = KMeans(k=k, seed=seed, maxIter=ROUNDS, distanceMeasure="cosine").fit(sample.repartition(self.spark.sparkContext.defaultParallelism))
            out = np.array(found.clusterCenters())
        else:
            out = np.array([sample.first()["features"].toArray()])
        forget(sample)
        return out / np.sqrt((out * out).sum(axis=1))[:, None]

    def rows_of(self, points: DataFrame) -> DataFrame:
        """Points as rows of the index, with their cell and closeness."""
        return self._assigned(points, self.centroids())

    def _assigned(self, points: DataFrame, centroids: np.ndarray) -> DataFrame:
        ship(self.spark)
        if not len(centroids):
            return points.withColumn("cell", F.lit(NO_CELL)).withColumn("closeness", F.lit(0.0))
        return assigned(points, centroids).withColumn("cell", F.element_at("cells", 1)).drop("cells")

    def build(self, bank: VersionedTable, cells: int | None = None) -> int:
        """Learn centroids and index all points of the bank's newest version, as a new version of the index."""
        folders = bank._folders()
        points = bank._load(list(folders.values()))
        centroids = self.learn(points, cells)
        name, data = f"c-{uuid.uuid4().hex}.npy", io.BytesIO()
        np.save(data, centroids)
        put_bytes(self.spark, f"{self.path}/{name}", data.getvalue())
        return self.replace(self._assigned(marked(points), centroids), about={"centroids": name} | source_of(folders))

    def cells_for(self, vector: list[float], probes: int) -> list[int]:
        """The cells of the centroids nearest to a vector, the nearest first."""
        q, centroids = np.array(vector, float), self.centroids()
        if not len(centroids):
            return [NO_CELL]
        if len(q) != centroids.shape[1]:
            raise ValueError(f"the index holds vectors of {centroids.shape[1]} numbers, not of {len(q)}")
        near = centroids @ q
        return [int(c) for c in np.argsort(-near, kind="stable")[:probes]]

    def bounds(self, vector: list[float]) -> dict[int, float]:
        """The highest cosine that a point of each cell can have with a vector: its angle to the centroid less the cell's reach."""
        q = np.array(vector, float)
        norm = float(np.sqrt((q * q).sum()))
        centroids, out = self.centroids(), {}
        near = centroids @ (q / norm if norm else q) if len(q) == centroids.shape[1] else np.zeros(0)
        for cell, told in self._state().stats.items():
            if cell == NO_CELL or not norm or not len(near):
                out[cell] = 0.0
            else:
                angle = float(np.arccos(np.clip(near[cell], -1, 1))) - float(np.arccos(np.clip(told["reach"], -1, 1)))
                out[cell] = float(np.cos(max(0.0, angle)))
        return out

    def candidates(self, vector: list[float], n: int, probes: int | None = None, where: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The rows to search for the best n: of the probes nearest cells; without probes, of all cells that can hold one of them, so the answer is exact.

        where narrows rows down. An exact search first takes the n-th best similarity of a few near cells; a cell whose
        bound is below it holds no better row. Cells whose bound is not, and all if there are too few rows, are read.
        """
        if probes is not None:
            return where(self.read_buckets(self.cells_for(vector, probes)))
        bounds = self.bounds(vector)
        if all(b == 0 for b in bounds.values()):
            return where(self.read())
        first = [c for c in self.cells_for(vector, max(1, round(len(bounds) ** 0.5))) if c in bounds]
        best = semantic_top(where(self.read_buckets(first)), vector, n).agg(F.min("semantic").alias("low"), F.count("semantic").alias("n")).first()
        if best["n"] < n:
            return where(self.read())
        return where(self.read_buckets([c for c, b in bounds.items() if b >= best["low"] - 1e-9]))

    def search(self, vector: list[float], k: int, probes: int | None = None, where: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The k rows of the highest similarity among the candidates, ties by point_id."""
        return semantic_top(self.candidates(vector, k, probes, where), vector, k).drop("cell", "closeness", "digest")

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, point_id, semantic) for queries (query_id, embedding), each against the probes nearest cells, or all.

        Cells are put together to blocks of about PART_POINTS points, and larger cells are cut, so neither a large cell
        nor one that many queries ask for is one task's, and a query goes to a block once, with those of its cells that it
        is to probe. A block gives its best k for each query, and their best k are the answer. Points and queries without
        a usable vector give nothing.
        """
        ship(self.spark)
        state, centroids = self._state(), self.centroids()
        dims = centroids.shape[1]
        sizes = {c: s["n"] for c, s in state.stats.items() if c != NO_CELL}
        block, held = {}, []
        for c, n in sorted(sizes.items()):
            if not held or held[-1] + n > PART_POINTS:
                held.append(0)
            block[c], held[-1] = len(held) - 1, held[-1] + n
        every = probes is None or probes >= len(centroids)
        told = assigned(queries.select("query_id", "embedding"), centroids, probes=1 if every else probes).where(F.element_at("cells", 1) != NO_CELL)
        numbers = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
        home = lambda c: F.get(numbers(block.get(k) for k in range(len(centroids))), c)
        blocks = numbers(range(len(held))) if every else F.array_distinct(F.filter(F.transform("cells", home), lambda x: x.isNotNull()))
        met = told.select("query_id", "embedding", "cells", F.explode(blocks).alias("blk"))
        own = F.lit(None).cast("array<int>") if every else F.filter("cells", lambda c: home(c) == F.col("blk"))
        asked = stored(met.select("query_id", "embedding", "blk", own.alias("cells")), "index-queries")
        load = {r["blk"]: -(-r["n"] // PART_QUERIES) for r in asked.groupBy("blk").agg(F.count("*").alias("n")).collect()}
        parts, groups = (F.get(numbers(xs), F.col("blk")) for xs in ([-(-n // PART_POINTS) for n in held] or [1], [load.get(b, 1) for b in range(len(held))] or [1]))
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        placed = self.read_buckets([c for c, b in block.items() if b in load]).select("point_id", "embedding", "cell", home(F.col("cell")).alias("blk"))
        points = placed.select("*", F.pmod(F.xxhash64("point_id"), parts).cast("int").alias("part"), upto(groups).alias("grp"))
        wanted = asked.select("query_id", "embedding", "cells", "blk", upto(parts).alias("part"), F.pmod(F.xxhash64("query_id"), groups).cast("int").alias("grp"))
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("point_id").combine_chunks()
            x, good = _matrix(left.column("embedding").combine_chunks(), dims)
            q, _ = _matrix(right.column("embedding").combine_chunks(), dims)
            kinds, cell = np.unique(left.column("cell").to_numpy(), return_inverse=True)
            probed = right.column("cells").to_pylist()
            at, points_at, semantic = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            step = max(1, HELD // max(1, len(x)))
            for start in range(0, len(q) if len(x) else 0, step):
                near = q[start : start + step] @ x.T
                near[:, ~good] = -np.inf
                for j, cells in enumerate(probed[start : start + step]):
                    if cells is not None:
                        near[j, ~np.isin(kinds, cells)[cell]] = -np.inf
                low = np.partition(near, -k, axis=1)[:, -k] if len(x) > k else np.full(len(near), -np.inf)
                # Points are in the order of their ids, so equal similarities come in it.
                row, col = np.nonzero((near >= low[:, None] - 2 * 10.0**-PLACES) & np.isfinite(near))
                value = np.round(near[row, col], PLACES)
                order = np.lexsort((col, -value, row))
                row, col, value = row[order], col[order], value[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                at.append(row[best] + start)
                points_at.append(col[best])
                semantic.append(value[best])
            take = lambda t, name, xs: t.column(name).take(pa.array(np.concatenate(xs)))
            return pa.table({"query_id": take(right, "query_id", at), "point_id": take(left, "point_id", points_at), "semantic": pa.array(np.concatenate(semantic))})

        keys = ["blk", "part", "grp"]
        met = points.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, f"query_id {kind}, point_id string, semantic double")
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("semantic"), "point_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "point_id", "semantic")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, hits (rows of exact that were found) and recall, the share of them."""
    both = exact.select("query_id", "point_id").join(found.select("query_id", "point_id", F.lit(1).alias("hit")), ["query_id", "point_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))


