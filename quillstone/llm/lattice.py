"""Near-duplicate vectors by hashing to the E8 lattice.

Equal vectors of a label become one class. Unit vectors are projected at random to eight
dimensions, in ``TABLES`` tables, and decoded to the nearest point of the E8 lattice. A
class is posted under that cell and under the ``PROBES`` neighbouring cells (of 240)
that its projection is nearest to, so that two vectors meet where any of their cells is
the same. Only lists with two members get the vectors themselves, which are compared as
matrices by cosine in double precision. A pair that meets in several lists counts in
the first of them, so what leaves a list is a count for each class and a forest that
keeps its components, never pairs. A list over ``BLOCK`` members is dealt into
blocks, and each two blocks meet in a group of their own.

The index holds every vector; at a cosine of exactly 0.98 in 64 dimensions a pair meets
with probability 0.999 (tested; more alike ones more surely), and no pair below the threshold is linked.

Cases: vectors that are null, zero or hold null or non-finite components, rows with a
null label and rows with a null id link with nothing; vectors of different lengths do
not link; equal vectors link (as their cosine is 1); rows that repeat an id are vectors
of their own with one id; ties don't matter; an empty table gives no rows; extra
columns are ignored, whatever their names. A null id has a null component and is not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import durable, map_arrow, quoted, scratch, sized_broadcast
from quillstone.llm.simhash import _runs
from quillstone.operators.components import connected_components

TABLES, PROBES, SCALE, SEED = 5, 4, 1.5, 8
THRESHOLD = 0.98
BLOCK, STEP = 4096, 512


@cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of a half with an
    even number of minus signs."""
    whole = []
    for places in combinations(range(8), 2):
        for signs in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[list(places)] = signs
            whole.append(v)
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + halves)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is all such points and those moved by a half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


@cache
def projections(dimensions: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).normal(size=(tables, dimensions, 8)) * SCALE


def cells(unit: np.ndarray, salts: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """A row of list keys for each unit vector. A key's top digit is its table."""
    out = []
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, size=8, dtype=np.uint64) | np.uint64(1)
    for t, matrix in enumerate(projections(unit.shape[1], tables)):
        at = unit @ matrix
        point = decode(at)
        order = np.argsort(-((at - point) @ shortest().T), axis=1, kind="stable")[:, :probes]
        near = np.concatenate([point[:, None], point[:, None] + shortest()[order]], axis=1)
        key = ((near * 2).astype(np.int64).view(np.uint64) * factors).sum(axis=2, dtype=np.uint64) + salts.view(np.uint64)[:, None]
        for shift in (29, 31):  # mixed, as a sum of multiples is not
            key = (key ^ (key >> np.uint64(shift))) * factors[0]
        out.append((key >> np.uint64(4)) | np.uint64(t) << np.uint64(60))
    return np.concatenate(out, axis=1).view(np.int64)


def _signed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, digest and packed vector (both null where a row links with nothing)."""
    kinds = [vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    dtype = _dtype(vectors, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[bytes | None] = []
            labels, ids, column = batch.column("label"), batch.column("id"), batch.column("vector")
            for i in range(batch.num_rows):
                own = column[i]
                found = None
                if own.is_valid and labels[i].is_valid and ids[i].is_valid and len(own.values) and not own.values.null_count:
                    x = own.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0)  # one zero
                    found = x.tobytes() if np.isfinite(x).all() and x.any() else None
                packed.append(found)
            digests = [None if p is None else hashlib.sha256(p).digest()[:16] for p in packed]
            yield pa.record_batch([ids, labels, pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["id", "label", "digest", "vector"])

    rows = vectors.select(quoted(id_col).alias("id"), quoted(label_col).alias("label"), quoted(vector_col).alias("vector"))
    return map_arrow(rows, run, f"id {kinds[0]}, label {kinds[1]}, digest binary, vector binary")


def _dtype(vectors: DataFrame, vector_col: str) -> type:
    return np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64


def _units(column: pa.Array, dtype: type) -> np.ndarray:
    """Packed vectors of one length as unit vectors, in doubles."""
    x = np.stack([np.frombuffer(v.as_buffer(), dtype) for v in column]).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # exact, and squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _posted(classes: DataFrame, dtype: type, tables: int, probes: int) -> DataFrame:
    """list, node: each class under its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, vectors, nodes = np.array(batch.column("salt")), batch.column("vector"), batch.column("node")
            sizes = np.array([len(v.as_buffer()) for v in vectors])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                keys = cells(_units(vectors.take(pa.array(at)), dtype), salts[at], tables, probes)
                yield pa.record_batch([pa.array(keys.ravel()), nodes.take(pa.array(np.repeat(at, keys.shape[1])))], ["list", "node"])

    salted = classes.select("node", "vector", F.xxhash64("label", F.octet_length("vector")).alias("salt"))
    return map_arrow(salted, run, "list long, node long")


def _earlier(table: pa.Table, tables: int, width: int) -> np.ndarray:
    """For each row and table, the keys of the lists before this one that it is in."""
    column = table.column("before").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    keys = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = keys >> 60
    out = np.full((len(sizes), tables, width), -1, np.int64)
    if len(keys):
        group = row * tables + place
        first = np.concatenate([[True], group[1:] != group[:-1]])  # keys are sorted, so a table's stand together
        start = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        out[row, place, np.arange(len(group)) - start] = keys
    return out


def _new_links(table: pa.Table, dtype: type, threshold: float, tables: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are linked here and met in no list before, each once."""
    unit, before = _units(table.column("vector").combine_chunks(), dtype), None
    own, crossed = table.column("own").to_numpy(), table["low"][0].as_py() != table["high"][0].as_py()
    n = len(unit)
    for start in range(0, n, STEP):
        stop = min(n, start + STEP)
        linked = np.triu(unit[start:stop] @ unit[start:].T >= threshold, 1)
        if crossed:
            linked &= own[start:stop, None] != own[None, start:]
        first, second = np.nonzero(linked)
        if not len(first):
            continue
        first, second = first + start, second + start
        before = _earlier(table, tables, width) if before is None else before
        for t in range(tables):
            a, b = before[first, t], before[second, t]
            known = np.zeros(len(first), bool)
            for i in range(width):
                known |= ((a[:, i, None] == b) & (b >= 0)).any(axis=1)
            first, second = first[~known], second[~known]
        yield first, second


def _compared(lists: DataFrame, dtype: type, threshold: float, tables: int, width: int) -> DataFrame:
    """a, b, links: a class's number of vectors linked with it (b null), or a link of
    the forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["list", "low", "high"]):
            copies, n = table.column("copies").to_numpy(), table.num_rows
            links, root = np.zeros(n, np.int64), np.arange(n)
            for first, second in _new_links(table, dtype, threshold, tables, width):
                np.add.at(links, first, copies[second])
                np.add.at(links, second, copies[first])
                while True:  # a larger root follows a smaller one that it is linked with
                    a, b = root[first], root[second]
                    if (a == b).all():
                        break
                    np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                    while (root != root[root]).any():
                        root = root[root]
            some, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
            if len(some):
                nodes = table.column("node").to_numpy()
                ends = pa.array(np.concatenate([np.zeros(len(some), np.int64), nodes[root[tied]]]), mask=np.arange(len(some) + len(tied)) < len(some))
                yield pa.record_batch([pa.array(np.concatenate([nodes[some], nodes[tied]])), ends, pa.array(np.concatenate([links[some], np.zeros(len(tied), np.int64)]))], ["a", "b", "links"])

    keys = ["list", "low", "high"]
    dealt = lists.repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(dealt.select(*keys, "own", "node", "copies", "before", "vector"), run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    dtype = _dtype(vectors, vector_col)
    with scratch() as made:
        rows = _signed(vectors, id_col, vector_col, label_col)
        alike = rows.where("digest is not null").groupBy("label", "digest")
        classes = alike.agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
        met = _posted(classes, dtype, tables, probes).withColumn("n", F.count("*").over(W.partitionBy("list"))).where("n > 1")
        # At most tables x (probes + 1) lists a class.
        of = durable(met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("list", "n"))).alias("lists")), "lattice-lists")
        held = classes.join(sized_broadcast(of), "node").select("node", "copies", "vector", F.col("lists.list").alias("all"), F.posexplode("lists").alias("at", "one"))
        held = held.select("node", "copies", "vector", F.col("one.list").alias("list"), F.slice("all", 1, F.col("at")).alias("before"), F.ceil(F.col("one.n") / block).cast("int").alias("blocks"))
        held = held.withColumn("own", F.pmod(F.xxhash64("node", "list"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held = held.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        found = durable(_compared(held, dtype, threshold, tables, probes + 1), "lattice-links")
        counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        parts = connected_components(found.where("b is not null").select("a", "b"))
        told = classes.drop("vector").join(counts, "node", "left").join(parts, "node", "left").where("copies > 1 or links is not null")
        told = durable(told.withColumn("component", F.coalesce("component", "node")), "linked-classes")
        ends = told.groupBy("component").agg(F.min("least").alias("component_id"))
        facts = durable(told.join(ends, "component").select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-facts")
        joined = rows.select("id", "label", "digest").join(sized_broadcast(facts), ["label", "digest"], "left")
        out = joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        return made.keep(durable(out.withColumn("kept", F.coalesce(quoted(id_col) == F.col("component_id"), F.lit(False))), "near-vectors"))
