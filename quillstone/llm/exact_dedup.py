"""Exact dedup with Patricia-trie owners.

Every task first inserts its own texts into a trie and sends each distinct text
on once, so a text that fills a third of the table arrives as one row per task.
Rows are partitioned by length and content hash; a partition inserts full byte
strings into a trie whose terminal nodes hold the owner and the row count.
Subtrees beyond the memory budget are spilled. Documents then look their group
up by length and SHA-256, in narrow rows.

Cases: a null text counts as empty; texts are equal only if identical; a null id
never owns a group unless all of its ids are null, then keep_id is null; rows
that repeat an id and its text all carry the same result (``deduplicate`` leaves
one of them); ids are integers, others are refused; a very long text is inserted
whole, and a trie that it fills is sent on or spilled; an empty table gives no
rows; extra columns are ignored by ``assign`` and kept by ``deduplicate``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillstone.llm.common import durable, fresh, map_arrow, quoted, sized_broadcast, slices
from quillstone.llm.radix import OwnerTrie

#: Bytes of trie that a task holds: before it sends its rows on, and before it spills.
LOCAL_BYTES = 64 << 20
OWNER_BYTES = 128 << 20


def _text(text_col: str):
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per distinct text: n_bytes, text_sha256, keep_id, group_size."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} holds {docs.schema[id_col].dataType.simpleString()}, not integers")
    choose = max if keep == "max" else min
    none = -(1 << 63) if keep == "max" else (1 << 63) - 1

    def rows(trie: OwnerTrie) -> Iterator[pa.RecordBatch]:
        texts, ids, counts, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(texts, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["body", "owner", "n"])

        for text, owner, count in trie.items():
            texts.append(text)
            ids.append(owner)
            counts.append(count)
            held += len(text)
            if held > 8 << 20 or len(texts) >= 8192:
                yield batch()
                texts, ids, counts, held = [], [], [], 0
        if texts:
            yield batch()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = OwnerTrie(choose, 1 << 62)
        for b in batches:
            for part in slices(b, "body"):
                ids = part.column("owner").fill_null(none).to_pylist()
                for text, owner in zip(part.column("body").to_pylist(), ids, strict=True):
                    trie.insert(text, owner)
                if trie.root.weight > LOCAL_BYTES:
                    yield from rows(trie)
                    trie = OwnerTrie(choose, 1 << 62)
        yield from rows(trie)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        trie = OwnerTrie(choose, OWNER_BYTES)
        for b in batches:
            for part in slices(b, "body"):
                for row in zip(*(part.column(c).to_pylist() for c in ("body", "owner", "n")), strict=True):
                    trie.insert(*row)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            sizes, hashes, ids, counts = zip(*out, strict=True)
            return pa.record_batch([pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["n_bytes", "text_sha256", "keep_id", "group_size"])

        for text, owner, count in trie.items():
            out.append((len(text), hashlib.sha256(text).hexdigest(), None if owner == none else owner, count))
            if len(out) >= 8192:
                yield batch()
                out.clear()
        if out:
            yield batch()

    bodies = docs.select(_text(text_col).cast("binary").alias("body"), F.col(f"`{id_col}`").cast("long").alias("owner"))
    sent = map_arrow(bodies, local, "body binary, owner long, n long")
    sent = sent.withColumns({"n_bytes": F.octet_length("body"), "content_hash": F.xxhash64("body")})
    dealt = sent.repartition("n_bytes", "content_hash").select("body", "owner", "n")
    return map_arrow(dealt, merge, "n_bytes long, text_sha256 string, keep_id long, group_size long")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    text, own = _text(text_col), F.col(f"`{id_col}`").cast("long")
    narrow = docs.select(own.alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    groups = owners(docs, id_col, text_col, keep).where("group_size > 1")
    keep_id = F.when(F.col("group_size").isNull(), F.col(f"`{id_col}`")).otherwise(F.col("keep_id"))
    return narrow.join(groups, ["n_bytes", "text_sha256"], "left").select(
        f"`{id_col}`", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col(f"`{id_col}`").eqNullSafe(keep_id).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows that ``assign`` drops, one row for each text.

    The groups of two or more are broadcast if they are few, else joined by a
    shuffle."""
    text, names = _text(text_col), fresh(docs, "group_bytes", "group_sha256", "group_owner", "in_group")
    size, sha, owner, many = names
    groups = owners(docs, id_col, text_col, keep).where("group_size > 1").select(F.col("n_bytes").alias(size), F.col("text_sha256").alias(sha), F.col("keep_id").alias(owner), F.lit(True).alias(many))
    keyed = docs.withColumns({size: F.octet_length(text).cast("long"), sha: F.sha2(text.cast("binary"), 256)})
    found = keyed.join(sized_broadcast(durable(groups, "copies")), [size, sha], "left")
    own = [quoted(c) for c in docs.columns]
    alone = found.where(F.col(many).isNull()).select(*own)
    owning = found.where(F.col(many) & quoted(id_col).cast("long").eqNullSafe(F.col(owner)))
    return alone.unionByName(owning.dropDuplicates([sha]).select(*own))
