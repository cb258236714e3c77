"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.storage import BROADCAST_ROWS, discard, durable, keep_until_exit, scratch, shared_dir, ship, sized_broadcast

__all__ = ["BROADCAST_ROWS", "discard", "durable", "fresh", "keep_until_exit", "map_arrow", "merged", "quoted", "release_memory", "scratch", "shared_dir", "ship", "sized_broadcast", "slices", "table", "texts_of", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release_memory() -> None:
    """Give freed memory back: Python workers outlive their tasks and stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of ``docs`` under those names, whatever they are called there."""
    return docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``."""
    (name,) = fresh(docs, "gone_id")
    return docs.join(sized_broadcast(ids.toDF(name)), quoted(id_col) == F.col(name), "left_anti")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release_memory()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def merged(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches, small neighbours put together up to ``max_bytes`` of ``column``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own = int(pc.sum(pc.binary_length(batch.column(column))).as_py() or 0)
        if held and size + own > max_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def slices(batch: pa.RecordBatch, column: str, max_rows: int = 512, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds few rows and few bytes of ``column``."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i in range(n):
        total += int(sizes[i])
        if i + 1 - start >= max_rows or total >= max_bytes:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < n:
        yield batch.slice(start, n - start)
