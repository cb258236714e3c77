"""Packing documents into training sequences by Karmarkar-Karp differencing.

A document's ids and its end id are cut into pieces: full windows, which are
sequences already, and a remainder, of which a long one leaves a short tail, as
short pieces even out what long ones cannot. Remainders are dealt by hash into lanes of
bounded size; in a lane, multiway differencing merges the two partial partitions
of largest spread, heaviest slots against lightest, until one near-equal
partition is left. If a slot then exceeds the capacity, the lane is partitioned
again into more windows.

Cases: null and empty texts are one end id; a very long text is encoded whole and
fills windows of its own; repeated rows and ids are separate documents; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import durable, map_arrow, merged, ship, slices, texts_of
from quillstone.llm.word_ids import CACHE_ENTRIES, WordBpe

CAPACITY = 4096
END_ID = 2
#: Text that is encoded at once: more of it repeats more words.
SLICE_BYTES = 8 << 20
#: Windows that a lane of remainders fills, and pieces it may hold.
LANE_WINDOWS = 256
LANE_PIECES = 16_384
#: A remainder longer than this leaves a tail of its length modulo TAIL.
WHOLE, TAIL = 512, 256


def cuts(tokens: int, capacity: int) -> list[int]:
    """Where the pieces of a document of so many ids begin, and its end."""
    full = tokens - tokens % capacity
    at = list(range(0, full, capacity))
    if full < tokens:
        at.append(full)
        if tokens - full > WHOLE and (tokens - full) % TAIL:
            at.append(tokens - (tokens - full) % TAIL)
    return [*at, tokens]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, cache_entries: int = CACHE_ENTRIES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, and piece_no,
    a number that no other piece of the table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number = WordBpe.of(tokenizer, cache_entries), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in merged(batches, "text", slice_bytes):
            for part in slices(batch, "text", max_rows=1 << 20, max_bytes=slice_bytes):
                ids, bounds = bpe.encode(part.column("text"))
                rows, start, length, crc, tokens = [], [], [], [], []
                for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4", copy=False)
                    at = cuts(len(own), capacity)
                    for begin, end in zip(at, at[1:], strict=False):
                        piece = own[begin:end]
                        rows.append(row)
                        start.append(begin)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        tokens.append(len(own))
                numbers = np.arange(number, number + len(rows), dtype=np.int64)
                number += len(rows)
                yield pa.record_batch([part.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, numbers))], ["id", "start", "length", "ids_crc32", "doc_tokens", "piece_no"])

    texts = texts_of(docs, id_col, text_col)
    return map_arrow(texts, run, f"id {texts.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, piece_no long").withColumnRenamed("id", id_col)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``ways`` groups of near-equal sums."""
    heap, left, right = [], [], []  # inner nodes: children, an index or -1 - node
    for i, size in enumerate(sizes):
        sums, slots = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], slots[0] = size, i
        heap.append((-size, i, sums, slots))
    heapq.heapify(heap)
    count, n = len(sizes), len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        b, y = b[::-1], y[::-1]
        sums, slots = a + b, np.where(x >= 0, x, y)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            left += x[both].tolist()
            right += y[both].tolist()
            slots[both] = np.arange(n, n + len(both))
            n += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, slots = sums[order], slots[order]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), count, sums, slots))
        count += 1
    groups = []
    for slot in heap[0][3].tolist() if heap else []:
        stack, own = [slot] if slot >= 0 else [], []
        while stack:
            k = stack.pop()
            if k < len(sizes):
                own.append(k)
            else:
                stack += (left[k - len(sizes)], right[k - len(sizes)])
        groups.append(sorted(own))
    return groups


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most ``capacity``, as few as differencing finds; a round
    that exceeds it is followed by one with more groups."""
    total = sum(sizes)
    ways = max(1, -(-total // capacity))
    while True:
        groups = differencing(sizes, ways)
        worst = max((sum(sizes[i] for i in g) for g in groups), default=0)
        if worst <= capacity:
            return [g for g in groups if g]
        # The mean must fall by what the worst group is over.
        ways = max(ways + 1, min(2 * ways, int(ways * total / max(1, total - ways * (worst - capacity)))))


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, lane_windows: int = LANE_WINDOWS) -> DataFrame:
    """``cut`` (rows of ``pieces``, already durable) with sequence_id and offset."""
    ship(cut.sparkSession)
    cut = cut.withColumnRenamed(id_col, "id")
    loose = F.col("length") < capacity
    n, tokens = cut.where(loose).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    lanes = max(1, -(-tokens // (capacity * lane_windows)), -(-n // LANE_PIECES))
    names = [*cut.columns, "sequence_id", "offset"]

    def run(key: tuple[pa.Scalar, ...], lane: pa.Table) -> pa.Table:
        lane = lane.sort_by("piece_no").combine_chunks()
        sizes = lane.column("length").to_pylist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for w, group in enumerate(windows(sizes, capacity)):
            at = 0
            for i in group:
                sequence[i], offset[i] = (key[0].as_py() << 24 | w) * 2, at
                at += sizes[i]
        lane = lane.drop_columns(["lane"])
        return pa.table([*lane.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    mixed = cut.where(loose).withColumn("lane", F.pmod(F.xxhash64("piece_no"), F.lit(lanes)))
    packed = mixed.groupBy("lane").applyInArrow(run, f"{kinds}, sequence_id long, offset long")
    full = cut.where(~loose).select(*cut.columns, (F.col("piece_no") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, cache_entries: int = CACHE_ENTRIES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of all documents with their sequences: ``pieces`` written once to
    the shared folder, then ``pack``."""
    return pack(durable(pieces(docs, id_col, text_col, capacity, end_id, tokenizer, cache_entries, slice_bytes), "pieces"), id_col, capacity).drop("piece_no")
