"""Relational building blocks: upserts, memos, batches, division, projections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.storage import durable


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """On conflict do nothing: existing rows, and the first incoming row of each new key."""
    first = incoming.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
    return existing.unionByName(first.join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """On conflict do update: the last incoming row of a key replaces the existing one."""
    last = latest_per_key(incoming, keys, order)
    return existing.join(last.select(*keys), list(keys), "left_anti").select(*existing.columns).unionByName(last.select(*existing.columns))


def guarded_conflicts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], guard: str) -> DataFrame:
    """Incoming rows that a guarded update refuses: the key exists with another ``guard``."""
    old = existing.select(*keys, F.col(guard).alias("__old"))
    return incoming.join(old, list(keys)).where(~F.col(guard).eqNullSafe(F.col("__old"))).drop("__old")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def not_memoized(work: DataFrame, memo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose key has no successful run yet."""
    return work.join(memo.where("status = 'SUCCEEDED'").select(*keys), list(keys), "left_anti")


def row_batches(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], size: int = 3) -> DataFrame:
    """``rows`` with batch_no: consecutive groups of ``size`` in each partition."""
    number = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("batch_no", F.floor((number - 1) / size).cast("long"))


def fully_contained(owners: DataFrame, owner: str, items: DataFrame, item: str, pinned: DataFrame) -> DataFrame:
    """Relational division: owners with at least one item, all of them pinned.
    ``items`` has (owner, item); ``pinned`` has item."""
    stray = items.join(pinned.select(item).distinct(), item, "left_anti").select(owner).distinct()
    return owners.join(items.select(owner).distinct(), owner, "left_semi").join(stray, owner, "left_anti")


def member_or_no_filter(values: Column, x: Column) -> Column:
    """An empty array filters nothing."""
    return (F.size(values) == 0) | F.array_contains(values, x)


def within_optional(t: Column, start: Column, end: Column) -> Column:
    """A closed interval whose ends may be null."""
    return (start.isNull() | (t >= start)) & (end.isNull() | (t <= end))


def counter_report(rows: DataFrame, column: str) -> DataFrame:
    """One row: the counts of a column's values as JSON with sorted keys."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), F.col("n").alias("v"))))
    return counted.agg(F.to_json(F.map_from_entries(pairs)).alias("report"))


def usage_by_model(runs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Runs by ``provider/model``, of the distinct listed ids if given."""
    chosen = runs if ids is None else runs.join(ids.select("id").distinct(), "id", "left_semi")
    return chosen.groupBy(F.concat_ws("/", "provider", "model").alias("model")).agg(F.count("*").alias("runs"))


def keyed_objects(rows: DataFrame, by: Sequence[str], key: str, value: Column) -> DataFrame:
    """An object of the rows of each group, by key."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))
    return rows.groupBy(*by).agg(F.map_from_entries(pairs).alias("objects"))


def pack_groups(groups: DataFrame, by: str, order: str, size: str, limit: int = 100) -> DataFrame:
    """``groups`` with batch_no: groups of rows go into a batch in order and are
    never split; a group that would overfill a batch begins the next.

    Each key is folded by one task, as a stream of sorted batches of which one is
    held at a time."""
    rows = groups.select(by, order, F.col(size).cast("long").alias(size)).repartition(by).sortWithinPartitions(by, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, fill = object(), 0, 0
        for b in batches:
            numbers = []
            for key, n in zip(b.column(by).to_pylist(), b.column(size).to_pylist(), strict=True):
                if key != own:
                    own, number, fill = key, 0, 0
                if fill and fill + n > limit:
                    number, fill = number + 1, 0
                fill += n
                numbers.append(number)
            yield pa.record_batch([*b.columns, pa.array(numbers, pa.int64())], [by, order, size, "batch_no"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, batch_no long")


def batch_hash(ids: Column) -> Column:
    """SHA-256 of sorted ids, one per line."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)


def ancestors(spans: DataFrame, id_col: str = "id", parent_col: str = "parent_span_id") -> DataFrame:
    """Each span's root and depth in its tree, by doubling parent pointers until none
    moves. A span whose parent is missing hangs under that parent's id; a cycle, which
    has no root, is an error."""
    hop = spans.select(F.col(id_col).alias("id"), F.coalesce(parent_col, id_col).alias("up"), F.when(F.col(parent_col).isNull(), 0).otherwise(1).cast("long").alias("depth"))
    size, reach = spans.count(), 1
    while True:
        up = hop.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = durable(hop.join(up, "up", "left").select("id", F.coalesce("next", "up").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("next") != F.col("up")).alias("moved")), "ancestors")
        hop = moved.select("id", F.col("top").alias("up"), "depth")
        if moved.where("moved").isEmpty():
            return hop.select(F.col("id").alias(id_col), F.col("up").alias("root_id"), "depth")
        if (reach := 2 * reach) > 4 * max(1, size):
            raise ValueError("spans form a cycle")


def with_links(records: DataFrame, key: str, links: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """``records`` with a sorted array of link ids for each of ``columns``: a name and
    the (conditional) id column of ``links``, which has ``key``. None gives an empty
    array, as a stored projection has."""
    ids = links.groupBy(key).agg(*(F.sort_array(F.collect_set(c)).alias(name) for name, c in columns.items()))
    empty = {name: F.coalesce(F.col(name), F.array().cast(ids.schema[name].dataType)) for name in columns}
    return records.join(ids, key, "left").withColumns(empty)


def stored_objects(records: DataFrame, by: str, key: str) -> DataFrame:
    """by, objects: a map from id to the record's fields as JSON, nulls kept: the
    relational projection of one kind of record."""
    value = F.to_json(F.struct(*(c for c in records.columns if c != by)), {"ignoreNullFields": "false"})
    return keyed_objects(records, [by], key, value)
