"""Files of source trees, repositories and bank snapshots. Spark's readers leave out files without a byte; so do trees here."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.functions.paths import ends_with_any, in_ignored_dir, is_code_file, language_of
from patternmill.schema import BANK, EXTENSIONS, IGNORED_DIRS, LOCAL_IGNORED_DIRS
from patternmill.session import names_in, size_of


def _root(spark: SparkSession, root: str) -> str:
    """The root as Spark names the files below it, in whatever way it is spelled."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString().rstrip("/")


def _raw(spark: SparkSession, root: str, ignored: list[str], endings: list[str] | None = None) -> DataFrame | None:
    """(path relative to root, length, content) below root without the ignored folders right below it; None if there is nothing."""
    base = _root(spark, root)
    held = [f"{base}/{name}" for name in names_in(spark, base) if name not in ignored]
    if not held:
        return None
    # Names may hold characters that mean something in patterns.
    escaped = ["".join("\\" + c if c in "{}[]*?\\" else c for c in path) for path in held]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if endings:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(endings) + "}")
    return reader.load(escaped).withColumn("path", F.expr(f"substring(path, {len(base) + 2})"))


def listing(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """(path relative to root, name, size) of all files below root, ignored folders left out; no file is opened."""
    names = IGNORED_DIRS if ignored is None else ignored
    raw = _raw(spark, root, names)
    if raw is None:
        return spark.createDataFrame([], "path string, name string, size long")
    files = raw.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))
    return files.where(~in_ignored_dir(F.col("path"), None, names))


def tree(spark: SparkSession, root: str, ignored: list[str] | None = None, endings: list[str] | None = None) -> DataFrame:
    """(path relative to root, name, size, content, error) of all files below root, ignored folders left out.

    With endings only files whose names end so are opened; ignored folders right below root are never gone into.
    content is null, and error set, for bytes that are no UTF-8; nothing is thrown for one bad file.
    """
    names = IGNORED_DIRS if ignored is None else ignored
    raw = _raw(spark, root, names, endings)
    if raw is None:
        return spark.createDataFrame([], "path string, name string, size long, content string, error string")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    files = raw.where(~in_ignored_dir(F.col("path"), None, names)).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), text.alias("content"))
    return files.withColumn("error", F.when(F.col("content").isNull(), "not UTF-8"))


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder, and the folder's path there; a local one may have any characters."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/")
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def write_tree(files: DataFrame, root: str) -> str:
    """Write rows (path relative to root, content binary) as files below root, each where its row is; returns root.

    A file is written under another name first and then renamed, so one that is there is whole, also if its task runs
    again. The folder must be one that Arrow's file systems reach. Paths that lead out of root are refused.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(root)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for path, data in zip(names, batch.column(1).to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} leads out of the folder")
                full = f"{base}/{path}"
                folder, _, name = full.rpartition("/")
                system.create_dir(folder, recursive=True)
                held = f"{folder}/_{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(held, compression=None) as out:
                    out.write(data or b"")
                system.move(held, full)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["n"])

    files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return root


def content_at(spark: SparkSession, root: str, path: str) -> str | None:
    """The text of one file below root; None if it is missing, no UTF-8 or cannot be read."""
    if path.startswith("/") or ".." in path.split("/"):
        return None
    full = f"{_root(spark, root)}/{path}"
    escaped = "".join("\\" + c if c in "{}[]*?\\" else c for c in full)
    try:
        if size_of(spark, full) == 0:
            return ""
        row = spark.read.format("binaryFile").load(escaped).select(F.try_validate_utf8(F.col("content").cast("string")).alias("text")).first()
    except Exception:  # noqa: BLE001  whatever stops the reader, there is no content
        return None
    return row["text"] if row else None


def contents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """S4 for many: wanted rows (repo, file_path) with content, null where there is no such file or no text; repeated wanted rows stay."""
    held = files.groupBy(F.col("repo").alias("__repo"), F.col("file_path").alias("__path")).agg(F.max_by("content", "ingest_seq").alias("content"))
    joined = wanted.join(held, F.col("repo").eqNullSafe(F.col("__repo")) & (F.col("file_path") == F.col("__path")), "left")
    return joined.select(*wanted.columns, "content")


def code_files(files: DataFrame) -> DataFrame:
    """S3: files of known extensions with their language, empty ones left out."""
    known = files.where(is_code_file(F.col("path"))).withColumn("language", language_of(F.col("path")))
    return known.where(F.length("content") > 0)


def local_files(spark: SparkSession, root: str) -> DataFrame:
    """S5 as the discovery script sees a folder: its own list of ignored folders, and endings rather than extensions."""
    found = tree(spark, root, LOCAL_IGNORED_DIRS, list(EXTENSIONS))
    return found.where(ends_with_any(F.col("path"), list(EXTENSIONS)))


def discovered(files: DataFrame) -> DataFrame:
    """One point for each whole file, with a random id and no more than path and description."""
    return files.select(F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("point_id"), F.col("content").alias("document"), F.col("path").alias("source_path"), F.concat(F.lit("Pattern found in "), F.col("path")).alias("description"))


def empty_bank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BANK)
