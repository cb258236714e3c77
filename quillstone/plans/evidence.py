"""Visibility, materiality, snapshots and batches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import events, materiality, relational, visibility
from quillstone.plans.base import query, table
from quillstone.sources import structure, tables

# Words that the documents' titles do hold stand in for the real ones.
FINAL = r"(?i)(?:^|[ .,])(und|les)(?:[ .,]|$)"
OFFICIAL = r"(?i)(?:^|[ .,])(that|para)(?:[ .,]|$)"
WITHHELD = r"(?i)(?:^|[ .,])(und|les|that|para)(?:[ .,]|$)"
CUTOFF = "2025-09-01"

_SOURCES_SQL = f"""
    SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title,
           CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 17 = 0 THEN 'FINAL_REPORT' ELSE 'FACTUAL_REPORT' END AS document_type,
           CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE TIMESTAMP '2025-01-01' + to_days((d.doc_id % 400)::INT) END AS published_at,
           TIMESTAMP '{CUTOFF}' AS cutoff,
           CASE WHEN l.quality = 1 THEN 'AI_ALLOWED' WHEN l.quality = 0 THEN 'LINK_ONLY' END AS disposition
    FROM documents d LEFT JOIN labels l USING (doc_id)
"""
_CLASSED_SQL = f"""
    SELECT *, CASE
        WHEN regexp_matches(replace(coalesce(document_type, '') || ' ' || title, '_', ' '), '{FINAL}') THEN 'FINAL_FINDING'
        WHEN regexp_matches(replace(coalesce(document_type, '') || ' ' || title, '_', ' '), '{OFFICIAL}') THEN 'OFFICIAL_ANALYSIS'
        WHEN published_at IS NULL OR published_at > cutoff OR document_type IS NULL THEN 'OFFICIAL_ANALYSIS'
        ELSE 'INVESTIGATION_EVIDENCE' END AS visibility
    FROM ({_SOURCES_SQL})
"""
_JUDGED_SQL = f"""
    SELECT *, visibility = 'INVESTIGATION_EVIDENCE' AND published_at IS NOT NULL AND published_at <= cutoff AND disposition = 'AI_ALLOWED'
              AND document_type <> 'FINAL_REPORT' AND NOT regexp_matches(title, '{WITHHELD}') AS eligible
    FROM ({_CLASSED_SQL})
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources with a title, type, date and disposition."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    day = F.expr("timestampadd(DAY, cast(doc_id % 400 as int), TIMESTAMP_NTZ '2025-01-01')")
    out = d.join(labels, "doc_id", "left").select(
        "doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.when(i % 11 == 0, None).when(i % 17 == 0, "FINAL_REPORT").otherwise("FACTUAL_REPORT").alias("document_type"),
        F.when(i % 23 != 0, day).alias("published_at"), F.expr(f"TIMESTAMP_NTZ '{CUTOFF}'").alias("cutoff"), F.when(F.col("quality") == 1, "AI_ALLOWED").when(F.col("quality") == 0, "LINK_ONLY").alias("disposition"),
    )
    c = [F.col(x) for x in ("document_type", "title", "published_at", "cutoff")]
    out = out.withColumn("visibility", visibility.classify_visibility(*c, final=FINAL, official=OFFICIAL))
    return out.withColumn("eligible", visibility.blind_eligible(*(F.col(x) for x in ("title", "document_type", "visibility", "published_at", "cutoff", "disposition")), withheld=WITHHELD))


@query(f"SELECT visibility, count(*) AS n FROM ({_CLASSED_SQL}) GROUP BY visibility")
def visibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).groupBy("visibility").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, visibility, published_at IS NULL AS undated FROM ({_JUDGED_SQL}) WHERE eligible")
def blind_eligible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).where("eligible").select("doc_id", "visibility", F.col("published_at").isNull().alias("undated"))


@query(f"SELECT coalesce(eligible::VARCHAR, 'null') AS eligible, count(*) AS n FROM ({_JUDGED_SQL}) GROUP BY 1")
def eligibility_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).groupBy(F.coalesce(F.col("eligible").cast("string"), F.lit("null")).alias("eligible")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT role, count(*) AS n FROM (
        SELECT 'acquisition' AS role FROM ({_JUDGED_SQL})
        UNION ALL SELECT 'blind' FROM ({_JUDGED_SQL}) WHERE eligible AND doc_id % 5 < 3
        UNION ALL SELECT 'processor' FROM ({_JUDGED_SQL}) WHERE eligible AND doc_id % 5 < 2
        UNION ALL SELECT 'evaluation' FROM ({_JUDGED_SQL}) WHERE doc_id % 5 IN (2, 3)) GROUP BY role"""
)
def secured_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    # Five cases: two blind, one locked, one revealed, one acquiring.
    cases = spark.range(5).select("id", F.element_at(F.array(*map(F.lit, ("BLIND", "BLIND", "LOCKED", "REVEALED", "ACQUIRING"))), (F.col("id") + 1).cast("int")).alias("state"), F.expr(f"TIMESTAMP_NTZ '{CUTOFF}'").alias("evidence_cutoff"))
    locks = cases.where("state in ('LOCKED', 'REVEALED')").select(F.col("id").alias("case_id"))
    src = s.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("docket_item_id"), (F.col("doc_id") % 5).alias("case_id"), "title", "document_type", "visibility", "published_at")
    dockets = s.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("case_id"), F.col("disposition").alias("processing_disposition"))
    # Titles are judged by the stand-in words first, then by the fixed ones.
    src = src.join(s.where(~F.col("title").rlike(WITHHELD)).select(F.col("doc_id").alias("id"), F.lit(True).alias("clean")), "id", "left")
    out = None
    for role in ("acquisition", "blind", "processor", "evaluation"):
        rows = visibility.secured_sources(role, src, dockets, cases, locks)
        if role in ("blind", "processor"):
            rows = rows.where("clean")
        rows = rows.select(F.lit(role).alias("role"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("role").agg(F.count("*").alias("n"))


@query(
    f"""SELECT route, count(*) AS n FROM (SELECT CASE WHEN disposition <> 'AI_ALLOWED' THEN 'SKIPPED_RIGHTS' WHEN visibility <> 'INVESTIGATION_EVIDENCE' THEN 'SKIPPED_VISIBILITY'
        WHEN doc_id % 29 = 0 THEN 'ERROR_CHECKSUM' ELSE 'PROCESS' END AS route FROM ({_JUDGED_SQL})) GROUP BY route"""
)
def source_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    checksum = F.when(F.col("doc_id") % 29 != 0, F.sha2("title", 256))
    return s.groupBy(visibility.source_route(F.col("disposition"), F.col("visibility"), checksum).alias("route")).agg(F.count("*").alias("n"))


_RE = materiality.SQL_IMMATERIAL
_CANDIDATES_SQL = """
    SELECT 'claim' AS kind, text FROM documents
    UNION ALL SELECT 'timeline', text FROM conversations
    UNION ALL SELECT 'entity', p_size::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN ' mm' ELSE '' END FROM part
    UNION ALL SELECT 'timeline', 'Data recorded for Row ' || l_linenumber::VARCHAR || CASE WHEN l_linenumber % 2 = 0 THEN ', Column 5: 0.63' ELSE 'x' END FROM lineitem
    UNION ALL SELECT 'claim', CASE o_orderstatus WHEN 'F' THEN 'Observation was recorded' WHEN 'P' THEN '  ' ELSE 'Valve ' || o_orderpriority END FROM orders
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    part, line, order = t("part"), t("lineitem"), t("orders")
    rows = [
        t("documents").select(F.lit("claim").alias("kind"), "text"),
        t("conversations").select(F.lit("timeline").alias("kind"), "text"),
        part.select(F.lit("entity").alias("kind"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " mm").otherwise("")).alias("text")),
        line.select(F.lit("timeline").alias("kind"), F.concat(F.lit("Data recorded for Row "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ", Column 5: 0.63").otherwise("x")).alias("text")),
        order.select(F.lit("claim").alias("kind"), F.when(F.col("o_orderstatus") == "F", "Observation was recorded").when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit("Valve "), "o_orderpriority")).alias("text")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query(
    f"""SELECT kind, text IS NOT NULL AND trim(text) <> '' AND NOT regexp_matches(text, '{_RE[0]}') AND NOT regexp_matches(text, '{_RE[1]}')
               AND NOT regexp_matches(text, '{_RE[2]}') AND NOT regexp_matches(text, '{_RE[3]}') AS material, count(*) AS n
        FROM ({_CANDIDATES_SQL}) GROUP BY 1, 2"""
)
def material_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    fields = F.struct(*(F.when(F.col("kind") == k, F.col("text")).alias(f) for k, f in materiality.TEXT_FIELDS.items()))
    text = materiality.candidate_text(F.col("kind"), F.to_json(fields))
    return rows.groupBy("kind", materiality.is_material(text).alias("material")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT kind, flat <> '' AND NOT regexp_matches(flat, '(?i)\brow\s+[0-9]+\b.*\bcolumn\s+[0-9]+\b')
               AND NOT regexp_matches(flat, '(?i)^(?:numerical\s+)?observation\b.*(?:recorded|documented|row|column|cell)')
               AND NOT regexp_matches(flat, '(?i)^(?:data|value|observation)\b.*\brow\s+[0-9]+\b') AND NOT regexp_matches(flat, '^[-+]?[0-9]+(?:\.[0-9]+)?(?:\s*[A-Za-z%]+)?$') AS material,
               count(*) AS n
        FROM (SELECT kind, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM ("""
    + _CANDIDATES_SQL
    + ")) GROUP BY 1, 2"
)
def material_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("kind", materiality.is_material_text(F.col("text")).alias("material")).agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
       AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40))"""
)
def pinned_candidates_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select("o_orderkey")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    pinned = table(spark, sf_dir, "part").where("p_size <= 40").select("p_partkey")
    return relational.fully_contained(owners, "o_orderkey", items, "p_partkey", pinned)


@query(
    """SELECT n_name, count(*) AS n, sha256(string_agg(l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber)) AS snapshot
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name IN ('ASIA', 'EUROPE') AND o_orderstatus IS NOT DISTINCT FROM 'F' AND l_returnflag IN ('A', 'R') GROUP BY n_name"""
)
def active_evidence_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    order = t("orders").where(F.col("o_orderstatus").eqNullSafe("F")).select("o_orderkey", "o_custkey")
    place = t("nation").join(F.broadcast(t("region").where("r_name in ('ASIA', 'EUROPE')")), F.col("n_regionkey") == F.col("r_regionkey"))
    who = t("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = t("lineitem").where("l_returnflag in ('A', 'R')").select("l_orderkey", "l_linenumber").join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return events.stream_digest(rows, "n_name", ["l_orderkey", "l_linenumber"], text, ("", ",", "")).select("n_name", F.col("rows").alias("n"), F.col("digest").alias("snapshot"))


@query(
    """SELECT o_orderpriority, batch_no, min(o_orderkey) AS first_key, count(*) AS n FROM (
        SELECT o_orderpriority, o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 3)::BIGINT AS batch_no FROM orders) GROUP BY 1, 2"""
)
def candidate_row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.row_batches(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], [F.col("o_orderkey")])
    return rows.groupBy("o_orderpriority", "batch_no").agg(F.min("o_orderkey").alias("first_key"), F.count("*").alias("n"))


@query(
    """WITH RECURSIVE g AS (SELECT user_id % 20 AS case_id, user_id, count(*) AS n FROM events GROUP BY 1, 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY user_id) AS rn FROM g),
        f AS (SELECT case_id, user_id, n, rn, 0::BIGINT AS batch_no, n::BIGINT AS fill FROM o WHERE rn = 1
              UNION ALL SELECT o.case_id, o.user_id, o.n, o.rn, CASE WHEN f.fill > 0 AND f.fill + o.n > 100 THEN f.batch_no + 1 ELSE f.batch_no END,
                               CASE WHEN f.fill > 0 AND f.fill + o.n > 100 THEN o.n ELSE f.fill + o.n END
              FROM f JOIN o ON o.case_id = f.case_id AND o.rn = f.rn + 1)
       SELECT case_id, user_id, n, batch_no FROM f"""
)
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("case_id"), "user_id").agg(F.count("*").alias("n"))
    return relational.pack_groups(groups, "case_id", "user_id", "n", 100)


@query("SELECT o_custkey, sha256(array_to_string(list_sort(list(o_orderkey::VARCHAR)), chr(10))) AS batch_hash FROM orders GROUP BY o_custkey")
def batch_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(relational.batch_hash(F.collect_list(F.col("o_orderkey").cast("string"))).alias("batch_hash"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_run_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def memo_reuse_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    memo = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"))
    return relational.not_memoized(table(spark, sf_dir, "orders").select("o_orderkey"), memo, ["o_orderkey"])


@query("SELECT event_type || '/' || (user_id % 3)::VARCHAR AS model, count(*) AS runs FROM events WHERE event_id IN (SELECT event_id FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("provider"), (F.col("user_id") % 3).cast("string").alias("model"))
    ids = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"))
    return relational.usage_by_model(runs, ids.unionAll(ids))


@query(
    """SELECT l_suppkey, ordinal, (min(rn) + 1)::BIGINT AS row, (max(rn) + 1)::BIGINT AS row_end, count(*) AS n_rows FROM (
        SELECT l_suppkey, rn, ((rn - 1) // 50)::BIGINT AS ordinal FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)) GROUP BY 1, 2"""
)
def table_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return tables.row_groups(rows, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("SELECT '{' || string_agg('\"' || k || '\":' || n::VARCHAR, ',' ORDER BY k) || '}' AS report FROM (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1)")
def counter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.counter_report(table(spark, sf_dir, "events"), "event_type")


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderkey % 3 <> 1) WHERE rn = 1
       UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 3 = 1) WHERE rn = 1
         AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 1)"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    existing = relational.latest_per_key(o.where("o_orderkey % 3 = 1"), ["o_custkey"], [F.asc("o_orderkey")])
    return relational.upsert(existing, o.where("o_orderkey % 3 != 1"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    """WITH a AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1), b AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
       SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)"""
)
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    existing = o.where("o_orderkey % 3 = 1").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return relational.insert_missing(existing, o.where("o_orderkey % 3 != 1"), ["o_custkey"], [F.col("o_orderkey")])


@query(
    """WITH RECURSIVE t AS (SELECT event_id AS id, event_id AS root_id, 0::BIGINT AS depth FROM events WHERE event_id = 0 OR event_id % 16 = 0
        UNION ALL SELECT e.event_id, t.root_id, t.depth + 1 FROM events e JOIN t ON e.event_id - 1 = t.id WHERE e.event_id % 16 <> 0) SELECT * FROM t"""
)
def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 16 != 0, F.col("event_id") - 1).alias("parent_span_id"))
    return relational.ancestors(spans)


@query(
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN octet_length(encode(html)) < 4000 AND page_id % 10 >= 6 AND page_id % 3 <> 0 THEN 'SCAN_LIKE' ELSE 'DIGITAL' END AS kind FROM pages) GROUP BY kind"""
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    kind = structure.page_kind(F.octet_length("html"), (F.col("page_id") % 10) / 10, F.col("page_id") % 3 == 0, 4000, 0.6)
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'FACTUAL_REPORT' WHEN p_partkey % 4 = 1 THEN 'FINAL_REPORT' ELSE 'OTHER' END AS document_type, count(*) AS n FROM part GROUP BY 1")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey") % 4
    raw = F.when(i == 0, " factual report").when(i == 1, "Final-Report").when(i == 2, F.col("p_name"))
    return table(spark, sf_dir, "part").groupBy(structure.document_type(raw).alias("document_type")).agg(F.count("*").alias("n"))
