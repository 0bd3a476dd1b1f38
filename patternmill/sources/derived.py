"""Other layouts of a bank, kept beside it: tables whose rows are those of a bank, in buckets of another kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from patternmill.schema import BANK
from patternmill.session import forget, stored
from patternmill.sources.tables import VersionedTable


def marked(points: DataFrame) -> DataFrame:
    """The columns of a bank, with a digest that tells a row that has changed."""
    names = [f.name for f in BANK.fields]
    return points.select(*names).withColumn("digest", F.xxhash64(*names))


def source_of(folders: dict[int, str]) -> dict:
    """What a derived table says about itself: the folders of the bank that it holds."""
    return {"source": {str(b): f for b, f in folders.items()}}


class DerivedTable(VersionedTable):
    """A table whose column cell says where a bank's row lies in it. rows_of gives points (with digest) their cell."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        super().__init__(spark, path, schema, "cell")

    def bucket(self) -> Column:
        return F.col("cell")

    def built(self) -> bool:
        return bool(self._logged()[0])

    def rows_of(self, points: DataFrame) -> DataFrame:
        raise NotImplementedError

    def refresh(self, bank: VersionedTable) -> int:
        """Take over the points of the bank's buckets that have changed; cells without a changed point stay as they are. The number of the cells written."""
        now, have = bank._folders(), {int(b): f for b, f in self._state().about["source"].items()}
        buckets = {b for b in now.keys() | have.keys() if now.get(b) != have.get(b)}
        if not buckets:
            return 0
        new = stored(self.rows_of(marked(bank._load([now[b] for b in sorted(buckets) if b in now]))), "derived-rows")
        old = self.read().where(bank.bucket().isin(sorted(buckets))).select("point_id", "digest", "cell")
        gone = old.join(new, ["point_id", "digest"], "left_anti").select("point_id", "cell")
        fresh = new.join(old, ["point_id", "digest"], "left_anti")
        moved = stored(gone.unionByName(fresh.select("point_id", "cell")).distinct(), "derived-changes")
        added = stored(fresh, "derived-new")
        touched = {r["cell"] for r in moved.select("cell").distinct().collect()}
        self.change_buckets(touched, lambda rows: rows.join(moved.select("point_id").distinct(), "point_id", "left_anti").unionByName(added), about=source_of(now))
        forget(new, moved, added)
        return len(touched)


class ClusteredBank(DerivedTable):
    """A bank's rows by language and category. Its log holds, for each folder, which languages and categories there are and the
    highest quality, so a filtered scan reads only the folders that may hold such rows.
    """

    CELLS = 256

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, StructType([*BANK.fields, StructField("cell", IntegerType()), StructField("digest", LongType())]))

    def rows_of(self, points: DataFrame) -> DataFrame:
        return points.withColumn("cell", F.pmod(F.xxhash64("language", "category"), F.lit(self.CELLS)).cast("int"))

    def build(self, bank: VersionedTable) -> int:
        """Take over all points of the bank's newest version."""
        folders = bank._folders()
        return self.replace(self.rows_of(marked(bank._load(list(folders.values())))), about=source_of(folders))

    def _stats(self, rows: DataFrame) -> dict[int, dict]:
        told = rows.groupBy("cell").agg(F.collect_set("language").alias("languages"), F.collect_set("category").alias("categories"), F.max("quality_score").alias("best")).collect()
        return {r["cell"]: {"languages": sorted(r["languages"]), "categories": sorted(r["categories"]), "best": r["best"]} for r in told}

    def candidates(self, language: str | None = None, category: str | None = None, min_quality: int = 1) -> DataFrame:
        """The rows of the folders that may hold rows of a language, a category and a quality (as in search.matching); they are still to be filtered."""

        def may(told: dict) -> bool:
            if language and language.lower() not in told["languages"] or category and category.lower() not in told["categories"]:
                return False
            return min_quality <= 1 or told["best"] is not None and told["best"] >= min_quality

        return self.read_buckets([c for c, told in self._state().stats.items() if may(told)]).drop("cell", "digest")
