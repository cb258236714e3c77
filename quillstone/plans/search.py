"""Search through a stored index, end to end, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V
from quillstone.operators import retrieval, search_index
from quillstone.plans.base import query, table

INVESTIGATIONS = 4


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, whole, as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _index(docs: DataFrame, config: str) -> search_index.Index:
    index = search_index.temporary(docs.sparkSession, "bigint", config)
    search_index.append(index, docs, "doc_id", "text")
    return index


@query(r"""
    SELECT term, count(DISTINCT doc_id) AS n, count(*) AS occurrences
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY term
""")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's terms, written in two appends, with the occurrences in its postings."""
    docs, index = table(spark, sf_dir, "documents"), search_index.temporary(spark, "bigint", "simple")
    search_index.append(index, docs.where("doc_id % 3 = 0"), "doc_id", "text")
    search_index.append(index, docs, "doc_id", "text")
    counts = index.terms().groupBy("term").agg(F.sum("n").alias("n"))
    return counts.join(index.postings().groupBy("term").agg(F.sum(F.size("at")).cast("long").alias("occurrences")), "term")


@query(r"""
    WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
         n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
         d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM documents)
    SELECT query_id, doc_id FROM q JOIN d USING (term) JOIN n USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n
""")
def fts_match_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.query_terms(_asked(spark, sf_dir), config="simple")
    return search_index.matches(_index(table(spark, sf_dir, "documents"), "simple"), terms, "doc_id").select("query_id", "doc_id")


@query()
def fts_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    found = search_index.matches(_index(docs, "english"), retrieval.query_terms(_asked(spark, sf_dir)), "doc_id")
    facts = docs.select(
        "doc_id",
        F.element_at(F.array(*map(F.lit, V.EVIDENCE_TYPES)), (i % 5 + 1).cast("int")).alias("evidence_type"),
        F.when(i % 2 == 0, "TEXT").otherwise("HTML").alias("document_type"),
    )
    none = F.array().cast("array<string>")
    no_time = F.lit(None).cast("timestamp")
    asked = _asked(spark, sf_dir).select(
        "*",
        F.when(F.col("query_id") % 4 == 0, F.array(F.lit("TEXT"), F.lit("TABLE"))).otherwise(none).alias("evidence_types"),
        none.alias("document_types"),
        F.array().cast("array<bigint>").alias("entity_ids"),
        no_time.alias("start_at"),
        no_time.alias("end_at"),
        F.lit(50).alias("limit"),
    )
    return retrieval.search(None, facts, asked, "doc_id", found=found)


_SEARCH_SQL = r"""
    WITH asked AS (
        SELECT item_id * 4 + inv AS query_id, inv, text, item_id FROM benchmark, range(4) r(inv)
    ), good AS (
        SELECT * FROM asked WHERE query_id % 11 > 0 AND query_id % 13 > 0
    ), visible AS (
        SELECT doc_id, doc_id % 4 AS inv, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words
        FROM documents WHERE doc_id % 7 > 0 AND doc_id % 5 < 4 AND (doc_id % 3 > 0 OR doc_id % 2 = 0)
    ), q AS (
        SELECT DISTINCT query_id, inv, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM good
    ), n AS (
        SELECT query_id, count(*) AS n FROM q GROUP BY 1
    ), whole AS (
        SELECT q.query_id, d.doc_id, n.n
        FROM q JOIN (SELECT doc_id, inv, unnest(list_distinct(words)) AS term FROM visible) d USING (inv, term) JOIN n USING (query_id)
        GROUP BY q.query_id, d.doc_id, n.n HAVING count(*) = n.n
    ), spots AS (
        SELECT w.query_id, w.doc_id, w.n, p.term, p.pos
        FROM whole w JOIN (SELECT doc_id, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS pos FROM visible) p USING (doc_id)
        JOIN q ON q.query_id = w.query_id AND q.term = p.term
    ), ends AS (
        SELECT query_id, doc_id, n, pos, min(prior) AS head
        FROM (SELECT b.query_id, b.doc_id, b.n, b.pos, a.term, max(a.pos) AS prior FROM spots b JOIN spots a ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.pos <= b.pos GROUP BY ALL)
        GROUP BY query_id, doc_id, n, pos HAVING count(*) = n
    ), covers AS (
        SELECT query_id, doc_id, head, min(pos) AS tail FROM ends GROUP BY ALL
    ), ranks AS (
        SELECT query_id, doc_id, sum(0.1::DOUBLE / (1 + greatest(0, tail - head + 1 - inside))) AS total
        FROM (SELECT c.query_id, c.doc_id, c.head, c.tail, count(*) AS inside FROM covers c JOIN spots s ON s.query_id = c.query_id AND s.doc_id = c.doc_id AND s.pos BETWEEN c.head AND c.tail GROUP BY ALL)
        GROUP BY ALL
    ), parts AS (
        SELECT r.query_id, r.doc_id, printf('%.6g', total / (1 + total))::DOUBLE::DECIMAL(38,20) AS fts, g.query_id % 3 = 0 AS by_entity, g.query_id % 5 = 0 AS by_time, g.query_id % 2 = 0 AS by_type,
               ((r.doc_id % 6 IN (1, 2))::INT * 0.5)::DECIMAL(38,20) AS entity, (r.doc_id % 10 < 8)::INT AS in_time, g.query_id % 50 + 1 AS most
        FROM ranks r JOIN good g USING (query_id)
        WHERE g.query_id % 2 > 0 OR r.doc_id % 5 < 3
    ), scored AS (
        SELECT *, round(0.55 * fts + 0.20 * CASE WHEN by_entity THEN entity ELSE 0 END + 0.15 * CASE WHEN by_time THEN in_time ELSE 0 END + 0.10 * by_type::INT, 4)::DECIMAL(5,4) AS total
        FROM parts WHERE (NOT by_entity OR entity > 0) AND (NOT by_time OR in_time > 0)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, fts DESC, CASE WHEN by_entity THEN entity ELSE 0 END DESC, doc_id) AS rank FROM scored
    )
    SELECT query_id, NULL AS error, rank, doc_id AS id, total::VARCHAR AS total,
           concat_ws(',', CASE WHEN by_type THEN 'evidence_type' END, CASE WHEN by_entity THEN 'entity' END, CASE WHEN by_time THEN 'time' END) AS filters
    FROM ranked WHERE rank <= most
    UNION ALL SELECT query_id, 'BLANK_TEXT', NULL, NULL, NULL, NULL FROM asked WHERE query_id % 11 = 0
    UNION ALL SELECT query_id, 'LIMIT', NULL, NULL, NULL, NULL FROM asked WHERE query_id % 13 = 0
"""


@query(_SEARCH_SQL)
def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence of four investigations, asked for by every benchmark text in
    each. One in seven is pinned with another run, one in five comes from a closed source,
    some have no completed unit; some queries break a rule, and filters come and go."""
    i, q = F.col("doc_id"), F.col("query_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    inv, case = (i % INVESTIGATIONS).alias("investigation_id"), (i % 2).alias("case_id")
    run: Column = F.when(i % 3 > 0, i % 9)
    evidence = docs.select(
        i.alias("id"), case, run.alias("model_run_id"), i.alias("source_document_id"), i.alias("structural_unit_id"), F.lit("ACCEPTED").alias("review_status"),
        F.when(i % 2 == 0, "HUMAN").otherwise("MODEL").alias("extraction_method"), F.element_at(F.array(*map(F.lit, ("A", "B", "C", "D", "E"))), (i % 5 + 1).cast("int")).alias("type"), F.col("text").alias("observation"),
    )
    membership = docs.select(inv, case, i.alias("evidence_id"), F.when(i % 7 > 0, run).otherwise(F.coalesce(run, F.lit(0)) + 1).alias("model_run_id"))
    sources = docs.select(i.alias("id"), case, F.when(i % 5 < 4, "INVESTIGATION_EVIDENCE").otherwise("FINAL_FINDING").alias("visibility"), F.lit("REPORT").alias("document_type"))
    completions = docs.where("doc_id % 3 > 0").select(i.alias("structural_unit_id"), run.alias("model_run_id"))
    asked = table(spark, sf_dir, "benchmark").withColumn("investigation_id", F.explode(F.sequence(F.lit(0), F.lit(INVESTIGATIONS - 1))))
    asked = asked.withColumn("query_id", F.col("item_id") * INVESTIGATIONS + F.col("investigation_id"))
    strings, longs = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    queries = asked.select(
        "query_id", F.col("investigation_id").cast("long").alias("investigation_id"), (F.col("investigation_id") % 2).cast("long").alias("case_id"), F.lit("NEUTRAL").alias("intent"), F.lit("fts-v1").alias("config_version"),
        F.when(q % 11 == 0, " ").otherwise(F.col("text")).alias("query_text"), F.when(q % 2 == 0, F.array(*map(F.lit, "ABC"))).otherwise(strings).alias("evidence_types"), strings.alias("document_types"),
        F.when(q % 3 == 0, F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).otherwise(longs).alias("entity_ids"),
        F.when(q % 5 == 0, F.lit("2024-01-01").cast("timestamp")).alias("start_at"), F.when(q % 5 == 0, F.lit("2024-01-08").cast("timestamp")).alias("end_at"),
        F.when(q % 13 == 0, 0).otherwise(q % 50 + 1).cast("int").alias("limit"),
    )
    entities = docs.select(inv, i.alias("id"), (i % 6).alias("entity_id"))
    times = docs.select(inv, i.alias("id"), F.timestamp_add("DAY", (i % 10).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("occurred_at"))
    index = search_index.temporary(spark, "bigint", "simple")
    search_index.append(index, evidence, "id", "observation")
    found = search_index.evidence_search(index, "blind", queries, membership, evidence, sources, completions, entities, times)
    return found.select("query_id", "error", "rank", "id", F.col("total_score").cast("string").alias("total"), F.array_join("matched_filters", ",").alias("filters"))
