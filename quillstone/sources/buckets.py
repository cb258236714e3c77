"""Tables that are merged into by key: copy on write, bucket by bucket."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions.storage import durable
from quillstone.operators.relational import latest_per_key

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketedTable:
    """A folder of Parquet files, a folder in it for each bucket of the keys' hash. A merge
    reads and writes the buckets of the incoming keys; files of others are not touched.

    A merge replaces its buckets one after another at the end of its write: readers beside it
    may see some of them old and some new, and merges must not run beside each other."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType(list(self.schema)).add(BUCKET, "integer")).parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A bucket is one task's, and so a few files.
        rows.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def merge(self, incoming: DataFrame, order: Sequence[Column], guard: Sequence[str] = (), update: bool = True) -> DataFrame:
        """On conflict do update (or nothing), with a guard: the refused rows of ``incoming``.

        Of incoming rows with one key the first in ``order`` (total) counts. It replaces the
        stored row only where both agree in every column of ``guard`` (null equals null); else
        it is refused and the stored row stays. Rows with a null in a key are refused."""
        whole = F.lit(True)
        for k in self.keys:
            whole &= F.col(k).isNotNull()
        first = durable(latest_per_key(incoming.where(whole), list(self.keys), order).select(*self.schema.names).withColumn(BUCKET, self.bucket()), "incoming")
        touched = sorted(r[0] for r in first.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        stored = self._stored().where(F.col(BUCKET).isin(touched))
        on = [BUCKET, *self.keys]
        same = F.lit(True)
        for g in guard:
            same &= F.col(f"old.{g}").eqNullSafe(F.col(f"new.{g}"))
        old, new = stored.withColumn("_is", F.lit(True)).alias("old"), first.withColumn("_is", F.lit(True)).alias("new")
        met = old.join(new, on, "full")
        fresh, kept = F.col("old._is").isNull(), F.col("new._is").isNull()
        wins = fresh | (~kept & same & F.lit(update))
        rest = [c for c in self.schema.names if c not in self.keys]
        both = met.select(*on, *(F.when(wins, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest), (~fresh & ~kept & ~same).alias("_refused"))
        merged = durable(both, "merged")
        refused = durable(first.join(merged.where("_refused").select(*on), on, "left_semi").select(*self.schema.names).unionByName(incoming.where(~whole).select(*self.schema.names)), "refused")
        self._write(merged.select(*self.schema.names, BUCKET), "overwrite")
        return refused


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> BucketedTable:
    """A new table of ``rows``, whose keys must not repeat (``merge`` into an empty one
    where they may)."""
    out = BucketedTable(rows.sparkSession, path, tuple(keys), rows.schema, buckets)
    out._write(rows.withColumn(BUCKET, out.bucket()), "errorifexists")
    return out
