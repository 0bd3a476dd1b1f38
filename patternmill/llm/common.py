"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named text column of each piece has about `limit` bytes at most, one row at least."""
    for batch in batches:
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        for row, length in enumerate(lengths):
            if row > start and held + length > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def joinable(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; beyond that Spark joins by shuffle, and AQE splits hot keys."""
    return F.broadcast(df) if small_enough(df, rows) else df


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add the exclusive running total of `value` over `order` (whole numbers from 0, unique by key).

    Two levels: totals of blocks of `block` consecutive orders, then within a block; no task holds a whole hot key.
    """
    b = "__block"
    cut = df.withColumn(b, F.floor(F.col(order) / block))
    base = (
        cut.groupBy(*keys, b)
        .agg(F.sum(value).alias("__sum"))
        .withColumn("__base", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(b).alias("__b"), "__base")
    )
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, b).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = F.lit(True)
    for k in keys:
        on = on & cut[k].eqNullSafe(F.col(f"__{k}"))
    return (
        cut.withColumn("__inner", inner)
        .join(base, on & (F.col(b) == F.col("__b")), "left")
        .withColumn(out, (F.col("__base") + F.col("__inner")).cast("long"))
        .drop(b, "__b", "__base", "__inner", *[f"__{k}" for k in keys])
    )


def unsigned_crc32(data: Column) -> Column:
    return F.crc32(data).cast("long")


def packed(df: DataFrame, *names: str | Column) -> DataFrame:
    """The whole row as one struct column __row beside the named columns, so that no other column name can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__row"), *names)


def place_bits(start: Column, n: Column | int) -> Column:
    """The places start to start + n - 1 (from 0; n is 63 at most) as an array of one or two structs (at, bits): words of 64 places, to be joined by bit_or."""
    by = lambda name, c, k: F.call_function(name, c, k.cast("int"))
    n = F.lit(n) if isinstance(n, int) else n
    bits, low, at = by("shiftleft", F.lit(1).cast("long"), n) - 1, F.pmod(start, F.lit(64)), F.floor(start / 64)
    one = F.struct(at.alias("at"), by("shiftleft", bits, low).alias("bits"))
    two = F.struct((at + 1).alias("at"), by("shiftrightunsigned", bits, 64 - low).alias("bits"))
    return F.when(low + n > 64, F.array(one, two)).otherwise(F.array(one))


def text_mark(text: str | Column = "text", source: str | Column = "source") -> Column:
    """A hash of a row's text and source: with doc_id it tells rows apart that have no doc_id or share one."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.xxhash64(F.coalesce(of(text), F.lit("")), of(source).cast("string"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, which an operator is about to add."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """df, in which filters on the named columns are not moved below this point.

    Spark moves a filter below a projection by putting in the expressions it filters on, as often as they occur; for
    columns that are built in steps this would repeat the steps many times over. A column that is not deterministic
    stops that, as long as the named columns depend on it.
    """
    marked = df.withColumn("__fence", F.monotonically_increasing_id())
    return marked.select(*[F.when(F.col("__fence") >= 0, F.col(c)).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])
