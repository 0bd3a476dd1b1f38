"""Session helpers: where shared files go, and how executors get this package."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
#: While a table of `stored` is written: small Arrow batches, as workers hold texts, and no shuffle files once it is done.
WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: The paths that fresh_path gave out within each open `scratch`.
_SCRATCH: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per context; a job may start outside the repository's folder."""
    context = spark.sparkContext
    if getattr(context, "_patternmill_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "patternmill.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("patternmill", os.path.relpath(full, _PACKAGE)))
    context.addPyFile(target)
    context._patternmill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A temporary one stands in on a local master only."""
    context: SparkContext = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="patternmill-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return qualified(spark, found)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that Spark and other readers mean the same place."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    told = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString().rstrip("/")
    return "file://" + told.removeprefix("file:") if told.startswith("file:/") and not told.startswith("file://") else told


def fresh_path(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A path of its own in the shared folder; kept: what is written there outlives the innermost open scratch."""
    path = f"{shared_dir(spark)}/patternmill/{name}-{uuid.uuid4().hex}"
    for held in _SCRATCH[: len(_SCRATCH) - kept]:
        held.append(path)
    return path


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    return written(df, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet to the path and read it back."""
    spark = df.sparkSession
    with writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._patternmill_path = path
    return out


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any Hadoop file system; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def size_of(spark: SparkSession, path: str) -> int:
    """The bytes of a file; raises if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).getLen()


def names_in(spark: SparkSession, folder: str, folders_only: bool = False) -> list[str]:
    """The names right below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(p)
    return sorted(f.getPath().getName() for f in found if f.isDirectory() or not folders_only)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file to any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    out.write(bytearray(data))
    out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of a small file of any Hadoop file system; raises if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a small file whole unless there is one; whether it was written. Of several writers at once one succeeds.

    The file is written under another name first. In a local or mounted folder a hard link then gives it its own; other
    file systems rename, which must be atomic and refuse an existing name there, as HDFS does.
    """
    held = f"{path}.{uuid.uuid4().hex}.tmp"
    put_bytes(spark, held, data)
    try:
        if path.startswith("file:"):
            local = lambda p: "/" + p.removeprefix("file:").lstrip("/")
            os.link(local(held), local(path))
        else:
            renamed(spark, held, path)
        return True
    except FileExistsError:
        return False
    finally:
        delete(spark, held)


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file of any Hadoop file system; FileExistsError where there is one of the new name."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    one, two = fs.Path(old), fs.Path(new)
    try:
        fs.FileContext.getFileContext(one.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(one, two, gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
            raise FileExistsError(new) from e
        raise


def age_of(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return time.time() - p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).getModificationTime() / 1000


def forget(*stored_ones: DataFrame) -> None:
    """Delete the tables of `stored`, when no further query needs them."""
    for df in stored_ones:
        delete(df.sparkSession, df._patternmill_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what fresh_path gave out within: for steps whose result has been written elsewhere by then."""
    held: list[str] = []
    _SCRATCH.append(held)
    try:
        yield
    finally:
        _SCRATCH[:] = [x for x in _SCRATCH if x is not held]
        for path in held:
            delete(spark, path)
