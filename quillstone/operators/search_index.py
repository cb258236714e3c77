"""A positional inverted index on disk: written once, appended to, read by term.

An index is a folder. Each append writes a segment: ``postings`` (term, id, at: the
sorted positions) and ``terms`` (term, n: documents that hold it), both in folders by
the bucket of the term's hash and sorted by term inside, and ``documents`` (the ids).
A row in ``manifest`` makes the segment part of the index, after all of it is written, so
a failed append leaves nothing behind that a search would read. Documents do not change:
an id that the index has is not indexed again.

A search reads the buckets of its queries' terms and no text. The rarest term of a query,
by the stored counts, gives its candidates; only their other terms are looked up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.english import STOP_WORDS, stem, tokens
from quillstone.functions.storage import durable, keep_until_exit, shared_dir, ship, sized_broadcast
from quillstone.operators import retrieval

BUCKETS = 64
#: Terms that a reader is given as literals, to skip parts of files; beyond, buckets do.
LITERAL_TERMS = 256


#: Postings that a task of an append holds before it hands them on, a document's apart.
POSTINGS = 20_000


@lru_cache(1 << 18)
def _term(word: str) -> str | None:
    """The stem of a word; none of a stop word."""
    return None if word in STOP_WORDS else stem(word)


@dataclass(frozen=True)
class Index:
    """Where an index is, and how it reads texts. ``id_type`` is the type of its ids."""

    spark: SparkSession
    path: str
    id_type: str
    config: str = "english"
    buckets: int = BUCKETS

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def segments(self) -> list[str]:
        """Names of the segments; one for each append."""
        try:
            rows = self.spark.read.schema("segment string").parquet(f"{self.path}/manifest").collect()
        except Exception as e:  # the first append has not been yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted(r.segment for r in rows)

    def _table(self, name: str, schema: str) -> DataFrame:
        schema_ = f"{schema}, bucket int" if name != "documents" else schema
        paths = [f"{self.path}/{s}/{name}" for s in self.segments()]
        if not paths:
            return self.spark.createDataFrame([], schema_)
        parts = [self.spark.read.schema(schema_).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def postings(self) -> DataFrame:
        return self._table("postings", f"term string, id {self.id_type}, at array<int>")

    def terms(self) -> DataFrame:
        return self._table("terms", "term string, n long")

    def documents(self) -> DataFrame:
        return self._table("documents", f"id {self.id_type}")


def temporary(spark: SparkSession, id_type: str, config: str = "english", buckets: int = BUCKETS) -> Index:
    """An index in the shared folder, deleted when the application ends."""
    path = keep_until_exit(spark, f"{shared_dir(spark)}/quillstone-index-{uuid.uuid4().hex}")
    return Index(spark, path, id_type, config, buckets)


def _places(docs: DataFrame, id_type: str, config: str) -> DataFrame:
    """id, term, at: made document by document, where the document is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, names, at = [], [], []

            def found() -> pa.RecordBatch:
                return pa.record_batch([batch.column("id").take(pa.array(owner, pa.int64())), pa.array(names, pa.string()), pa.array(at, pa.list_(pa.int32()))], ["id", "term", "at"])  # noqa: B023

            # One document's words are objects at a time, and few documents' postings.
            for i in range(batch.num_rows):
                words = batch.column("words")[i].as_py()
                own: dict[str, list[int]] = {}
                for place, word in enumerate(words, 1):
                    term = word if config == "simple" else _term(word)
                    if term is not None:
                        own.setdefault(term, []).append(place)
                owner += [i] * len(own)
                names += own
                at += own.values()
                if len(owner) >= POSTINGS:
                    yield found()
                    owner, names, at = [], [], []
            if owner:
                yield found()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, f"id {id_type}, term string, at array<int>")


def append(index: Index, docs: DataFrame, id_col: str, text_col: str) -> str | None:
    """Index the ``docs`` that the index has not; the new segment, or none. Of rows with
    one id, one is indexed. Ids that are null are not indexed."""
    rows = docs.select(F.col(id_col).cast(index.id_type).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if index.segments():
        rows = rows.join(index.documents(), "id", "left_anti")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"))
    segment = f"segment-{uuid.uuid4().hex}"
    path = f"{index.path}/{segment}"
    # Texts are read once; postings of a frequent term are dealt on, as partitions are even.
    found = _places(rows.select("id", tokens(F.col("text")).alias("words")), index.id_type, index.config).withColumn("bucket", index.bucket(F.col("term")))
    found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = index.spark.read.schema(f"term string, id {index.id_type}, at array<int>, bucket int").parquet(f"{path}/postings")
    counts = postings.groupBy("bucket", "term").agg(F.count("*").alias("n"))
    counts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    rows.select("id").write.parquet(f"{path}/documents")
    if index.spark.read.parquet(f"{path}/documents").isEmpty():
        return None
    index.spark.createDataFrame([(segment,)], "segment string").coalesce(1).write.mode("append").parquet(f"{index.path}/manifest")
    return segment


def _of(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The part of ``table`` in the buckets of ``asked`` (term, bucket; durable). At most
    ``BUCKETS`` numbers and ``LITERAL_TERMS`` terms come to the driver."""
    buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())
    table = table.where(F.col("bucket").isin(buckets))
    some = [r.term for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    return table.where(F.col("term").isin(sorted(some))) if len(some) <= LITERAL_TERMS else table


def matches(index: Index, terms: DataFrame, id_col: str) -> DataFrame:
    """query_id, id, hits: documents that have every term of a query, with the sorted
    positions of each term. ``terms`` are those of ``query_terms``."""
    asked = durable(terms.withColumn("bucket", index.bucket(F.col("term"))), "asked-terms")
    known = _of(index.terms(), asked).groupBy("term").agg(F.sum("n").alias("n"))
    counted = durable(asked.join(known, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))), "counted-terms")
    rare = counted.groupBy("query_id").agg(F.min_by(F.struct("term", "bucket", "n"), F.struct("n", "term")).alias("r")).select("query_id", "r.*").where("n > 0").drop("n")
    rare = durable(rare, "rarest-terms")
    first = _of(index.postings(), rare).drop("bucket").join(sized_broadcast(rare.drop("bucket")), "term")
    candidates = durable(first.select("query_id", "id", "term", "at"), "candidates")
    others = counted.join(rare.select("query_id", F.col("term").alias("rarest")), "query_id").where("term <> rarest and n > 0").select("query_id", "term", "bucket")
    others = durable(others, "other-terms")
    # Only the candidates' ids are broadcast, not their terms: of the other terms' postings, few are theirs.
    ids = durable(candidates.select("id").distinct(), "candidate-ids")
    wanted = candidates.select("query_id", "id").join(sized_broadcast(others), "query_id").select("query_id", "id", "term")
    theirs = _of(index.postings(), others).drop("bucket").join(sized_broadcast(ids), "id", "left_semi")
    at = theirs.join(wanted.hint("merge"), ["id", "term"])
    rows = candidates.unionByName(at.select("query_id", "id", "term", "at"))
    found = rows.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("term", "at"))).alias("hits"))
    sizes = counted.select("query_id", "terms").distinct()
    whole = found.join(sized_broadcast(sizes), "query_id").where(F.size("hits") == F.col("terms"))
    return whole.select("query_id", F.col("id").alias(id_col), "hits")


def evidence_search(index: Index, role: str, queries: DataFrame, membership: DataFrame, evidence: DataFrame, sources: DataFrame, completions: DataFrame, entity_links: DataFrame | None = None, time_links: DataFrame | None = None) -> DataFrame:
    """The whole search in one call: query_id, error, rank, id, the component scores,
    total_score, matched_filters.

    A query that breaks a rule gives one row for each rule, its name in ``error``, and no
    result; other rows have no error. Results are evidence of the query's own investigation
    and case that its reader may search (see ``retrieval.searchable``, which names the
    tables' columns and refuses roles). ``index`` holds the evidence's observations.
    ``queries`` has query_id, investigation_id, case_id, intent, query_text, evidence_types,
    document_types, entity_ids, start_at, end_at, limit, config_version; ``entity_links`` and
    ``time_links`` have investigation_id, id and entity_id or occurred_at."""
    scope = ("investigation_id",)
    docs = retrieval.searchable(role, membership, evidence, sources, completions)
    errors = durable(retrieval.query_errors(queries), "query-errors")
    good = queries.join(sized_broadcast(errors.select("query_id").distinct()), "query_id", "left_anti")
    # An investigation belongs to a case; a query that names another finds nothing.
    good = good.join(membership.select(*scope, "case_id").distinct(), [*scope, "case_id"], "left_semi")
    found = matches(index, retrieval.query_terms(good, config=index.config), "id")
    results = retrieval.search(None, docs, good, "id", entity_links=entity_links, time_links=time_links, found=found, scope=scope)
    return results.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)
