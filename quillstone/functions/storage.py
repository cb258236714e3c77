"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast side may have; beyond it the same join runs as a shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes of its values, as the driver holds the side, and a hash table of it, at once.
BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch where the session has Spark's default: whole texts are
#: wide, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1_000


#: Share of the driver's heap above which ``durable`` has it collected.
HEAP_SHARE = 0.5

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python stages: smaller Arrow batches, and let workers
    that share this file system import the package.

    On a cluster the package is deployed with ``--py-files``; then the path
    below does not exist there and is ignored.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is
    unset and all of Spark runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="quillstone-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """Let the driver's JVM delete ``path`` when it ends."""
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    return path


#: Lets Spark delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _relieve(spark: SparkSession) -> None:
    """Collect the driver's heap where it has grown over its share. A job of many plans
    leaves their graphs, metrics and broadcasts behind, most of it garbage, and Spark
    removes a broadcast only once the driver has collected it."""
    jvm = spark.sparkContext._jvm.java.lang
    heap = jvm.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()  # Python's references to plans
        jvm.System.gc()


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage
    ends there, and a lost executor costs no recomputation. What was shuffled for it
    is deleted at once. The table lasts until ``discard``, the end of a ``scratch``
    that it was made in, or the end of the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    keep_until_exit(spark, path)
    _relieve(spark)
    found = spark.read.schema(df.schema).parquet(path)
    found._durable_path = path
    if _scopes:
        _scopes[-1].tables.append(found)
    return found


def discard(df: DataFrame) -> None:
    """Delete a table of ``durable`` that nothing will read any more."""
    files, place = _file_system(df.sparkSession, df._durable_path)
    files.delete(place, True)


class Scratch:
    """Tables of ``durable`` that end with a block."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Let ``df`` outlive the block."""
        self.tables = [t for t in self.tables if t is not df]
        if len(_scopes) > 1:
            _scopes[-2].tables.append(df)
        return df


_scopes: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """A block whose durable tables are deleted at its end, but for those it keeps."""
    scope = Scratch()
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        for df in scope.tables:
            discard(df)


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and the bytes of its values are
    within the bounds, else ``df`` as it is, so that the join shuffles. ``df`` is
    read once more to be measured, so a costly one should be durable."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`")) if f.dataType.simpleString() in ("string", "binary") else F.lit(16), F.lit(0)) + 8 for f in df.schema), F.lit(0).cast("long"))
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_bytes else df


def partitions(df: DataFrame, rows: int) -> int:
    """How many partitions give each about ``rows`` of ``df``, which is counted; no fewer
    than the session's own."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
