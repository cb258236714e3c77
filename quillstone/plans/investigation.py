"""Tests, confidence, audit, events and retrieval over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import canonical, english
from quillstone.functions import vocabulary as V
from quillstone.functions.storage import durable
from quillstone.operators import audit, components, events, falsification, integrity, jobs, promotion, relational, retrieval
from quillstone.plans.base import query, table
from quillstone.streaming import logs

_WEIGHTS_SQL = " ".join(f"WHEN outcome = '{o}' AND strength = '{s}' THEN {d}::DECIMAL(5,4)" for o, ds in V.TEST_WEIGHTS.items() for s, d in zip(V.STRENGTHS, ds, strict=True))
_TESTS_SQL = """
    SELECT event_id AS test_id, user_id AS hypothesis_id, CASE WHEN event_id % 10 < 8 THEN 'SUCCEEDED' WHEN event_id % 10 = 8 THEN 'PENDING' ELSE 'FAILED' END AS status,
           CASE event_id % 4 WHEN 0 THEN 'CONTRADICTED' WHEN 1 THEN 'SURVIVED' WHEN 2 THEN 'EXPECTED_EVIDENCE_MISSING' ELSE 'INCONCLUSIVE' END AS outcome,
           CASE event_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS strength FROM events
"""
_HYPOTHESES_SQL = "SELECT DISTINCT user_id AS hypothesis_id, user_id % 20 AS investigation_id, ((5 + user_id * 37 % 80) / 100.0)::DECIMAL(5,4) AS current_confidence FROM events"
_REVISED_SQL = f"""
    WITH t AS (SELECT *, CASE {_WEIGHTS_SQL} END AS delta FROM ({_TESTS_SQL}) WHERE status = 'SUCCEEDED'),
         s AS (SELECT hypothesis_id, sum(delta)::DECIMAL(38,4) AS delta,
                      string_agg(test_id::VARCHAR || ':' || outcome || ':' || strength || ':' || CASE WHEN delta >= 0 THEN '+' ELSE '' END || delta::VARCHAR, '; ' ORDER BY test_id::VARCHAR) AS reasons FROM t GROUP BY 1),
         h AS (SELECT h.hypothesis_id, h.investigation_id, h.current_confidence AS before, coalesce(s.delta, 0::DECIMAL(38,4)) AS delta, coalesce(s.reasons, 'no SUCCEEDED tests') AS reasons FROM ({_HYPOTHESES_SQL}) h LEFT JOIN s USING (hypothesis_id))
    SELECT *, least(0.95::DECIMAL(38,4), greatest(0.05::DECIMAL(38,4), before::DECIMAL(38,4) + delta))::DECIMAL(5,4) AS after FROM h
"""


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    return e.select(
        i.alias("test_id"), F.col("user_id").alias("hypothesis_id"), F.when(i % 10 < 8, "SUCCEEDED").when(i % 10 == 8, "PENDING").otherwise("FAILED").alias("status"),
        pick(4, "CONTRADICTED", "SURVIVED", "EXPECTED_EVIDENCE_MISSING", "INCONCLUSIVE").alias("outcome"), pick(3, "LOW", "MEDIUM", "HIGH").alias("strength"),
    )


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(u.alias("hypothesis_id"), (u % 20).alias("investigation_id"), ((5 + u * 37 % 80).cast("decimal(10,0)") / 100).cast("decimal(5,4)").alias("current_confidence"))


@query(f"""SELECT hypothesis_id, before::VARCHAR AS before, delta::VARCHAR AS delta, after::VARCHAR AS after,
    'weighted-delta-v1; ' || reasons || '; before=' || before::VARCHAR || '; delta=' || CASE WHEN delta >= 0 THEN '+' ELSE '' END || delta::VARCHAR || '; after=' || after::VARCHAR || '; clamp=[0.0500,0.9500]' AS rationale FROM ({_REVISED_SQL})""")
def confidence_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = falsification.revise(hypotheses(spark, sf_dir), tests(spark, sf_dir))
    return found.select("hypothesis_id", *(F.col(c).cast("string").alias(c) for c in ("before", "delta", "after")), "rationale")


@query(f"""WITH r AS ({_REVISED_SQL}), m AS (SELECT *, max(after) OVER (PARTITION BY investigation_id) AS top FROM r), t AS (SELECT *, sum((after = top)::INT) OVER (PARTITION BY investigation_id) AS ties FROM m)
    SELECT hypothesis_id, CASE WHEN after <= 0.15 THEN 'REJECTED' WHEN after < 0.35 THEN 'WEAKENED' WHEN after = top AND after >= 0.5 AND ties = 1 THEN 'LEADING' ELSE 'ACTIVE' END AS status FROM t""")
def status_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hypotheses(spark, sf_dir)
    revised = falsification.revise(h, tests(spark, sf_dir)).select("hypothesis_id", F.col("after").alias("current_confidence"))
    return falsification.assign_statuses(revised.join(h.select("hypothesis_id", "investigation_id"), "hypothesis_id")).select("hypothesis_id", "status")


@query("""WITH t AS (SELECT o_orderkey AS test_id, o_custkey AS case_id, CASE o_orderkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'N' END AS et, CASE WHEN o_orderkey % 2 = 0 THEN 'F' END AS st FROM orders),
        e AS (SELECT o_custkey AS case_id, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS et, l_linestatus AS st FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT test_id, CASE WHEN t.et IS NULL AND t.st IS NULL THEN 'INCONCLUSIVE' WHEN count(DISTINCT e.id) > 0 THEN 'SURVIVED' ELSE 'EXPECTED_EVIDENCE_MISSING' END AS outcome,
             CASE WHEN t.et IS NULL AND t.st IS NULL THEN 0 ELSE count(DISTINCT e.id) END AS n FROM t LEFT JOIN e ON e.case_id = t.case_id AND (t.et IS NULL OR e.et = t.et) AND (t.st IS NULL OR e.st = t.st) GROUP BY test_id, t.et, t.st""")
def test_evidence_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    t = o.select(k.alias("test_id"), F.col("o_custkey").alias("case_id"), F.array().cast("array<bigint>").alias("evidence_ids"), F.when(k % 3 == 0, "R").when(k % 3 == 1, "N").alias("evidence_type"), F.when(k % 2 == 0, "F").alias("subtype"))
    e = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == k).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("case_id"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("subtype"))
    return falsification.evidence_presence(t, e).select("test_id", "outcome", F.size("result_evidence_ids").cast("long").alias("n"))


@query("""WITH o AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders),
        e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS at, o_orderkey % 5 <> 0 AS exact FROM orders)
      SELECT o.o_orderkey AS test_id, CASE WHEN b.o_orderkey IS NULL THEN NULL WHEN a.at IS NULL OR b.at IS NULL OR NOT a.exact OR NOT b.exact OR o.o_orderkey % 7 = 0 THEN 'INCONCLUSIVE' WHEN a.at < b.at THEN 'SURVIVED' ELSE 'CONTRADICTED' END AS outcome
      FROM o JOIN e a ON a.o_orderkey = o.o_orderkey LEFT JOIN e b ON b.o_orderkey = o.nxt""")
def test_temporal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = o.select(k.alias("id"), F.when(k % 13 != 0, F.col("o_orderdate")).alias("occurred_at"), F.when(k % 5 == 0, "APPROXIMATE").otherwise("EXACT").alias("time_precision"), F.array(k % 3).alias("evidence_ids"))
    scope = F.when(k % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(*(F.lit(x).cast("long") for x in range(3))))
    t = o.select(k.alias("test_id"), k.alias("before_event_id"), F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("after_event_id"), scope.alias("scope"))
    return falsification.temporal_consistency(t, line).select("test_id", "outcome")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, list(l_partkey) FILTER (l_returnflag = 'A' AND l_linenumber <= 3) AS s, list(l_partkey) FILTER (l_returnflag = 'R' AND l_linenumber <= 3) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
        f AS (SELECT o_custkey, len(list_filter(coalesce(r, []), lambda x: NOT list_contains(coalesce(s, []), x))) > 0 AS against, len(coalesce(s, [])) > 0 AND len(list_intersect(coalesce(s, []), coalesce(r, []))) = 0 AS backed FROM c)
      SELECT o_custkey AS test_id, CASE WHEN bool_or(against) THEN 'CONTRADICTED' WHEN bool_and(backed) THEN 'SURVIVED' ELSE 'INCONCLUSIVE' END AS outcome FROM f GROUP BY 1""")
def test_claim_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    some = lambda c: F.collect_list(F.when(c, F.col("l_partkey")))
    claims = line.groupBy(F.col("o_custkey").alias("test_id"), F.col("o_orderkey").alias("claim_id")).agg(
        some(F.col("l_returnflag") == "A").alias("supporting"), some(F.col("l_returnflag") == "R").alias("contradicting"), some(F.col("l_linenumber") <= 3).alias("near"),
        some((F.col("l_linenumber") <= 3) & (F.col("l_returnflag") == "A")).alias("s3"), some((F.col("l_linenumber") <= 3) & (F.col("l_returnflag") == "R")).alias("r3"),
    )
    # A part of two lines counts by the lines in scope only.
    pairs = claims.select("test_id", "claim_id", F.col("s3").alias("supporting"), F.col("r3").alias("contradicting"), F.col("near").alias("scope"))
    return falsification.claim_contradiction(pairs).select("test_id", "outcome")


_CAPS = ", ".join(f"'{c}'" for c in V.CAPABILITIES)
_AUDIT_SQL = f"""
    SELECT event_id AS id, user_id % 7 AS audit_case, CASE WHEN event_id % 97 = 0 THEN 99 ELSE user_id % 7 END AS case_id,
           ['ACQUISITION','PROCESSING','BLIND','EVALUATION'][1 + event_id % 4] AS stage, ['ACQUISITION','PROCESSOR','BLIND','EVALUATION'][1 + (event_id + (event_id % 31 = 0)::INT) % 4] AS actor_role,
           [{_CAPS}][1 + (event_id // 4) % 10] AS capability, ['READ','WRITE','NETWORK','LOCK','DENY'][1 + (event_id // 3) % 5] AS operation,
           CASE WHEN event_id % 5 <> 0 THEN event_id % 1200 END AS target, CASE WHEN event_id % 6 < 4 AND (event_id // 3) % 5 = 2 THEN 'host' || (event_id % 3)::VARCHAR || CASE WHEN event_id % 41 = 0 THEN '_' ELSE '' END || '.example.com' END AS host,
           (event_id // 3) % 5 <> 4 OR event_id % 53 = 0 AS allowed, event_id % 1000 AS tick FROM events
"""


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    div = lambda n: F.floor(i / n)
    network = div(3) % 5 == 2
    host = F.concat(F.lit("host"), (i % 3).cast("string"), F.when(i % 41 == 0, "_").otherwise(""), F.lit(".example.com"))
    return table(spark, sf_dir, "events").select(
        i.alias("id"), (F.col("user_id") % 7).alias("audit_case_id"), F.when(i % 97 == 0, 99).otherwise(F.col("user_id") % 7).alias("case_id"), pick(i, ("ACQUISITION", "PROCESSING", "BLIND", "EVALUATION")).alias("stage"),
        pick(i + F.when(i % 31 == 0, 1).otherwise(0), ("ACQUISITION", "PROCESSOR", "BLIND", "EVALUATION")).alias("actor_role"), pick(div(4), V.CAPABILITIES).alias("capability"), pick(div(3), V.OPERATIONS).alias("operation"),
        F.when(i % 5 != 0, i % 1200).alias("target_document_id"), F.when((i % 6 < 4) & network, host).alias("network_host"), ((div(3) % 5 != 4) | (i % 53 == 0)).alias("allowed"), (i % 1000).alias("occurred_at"),
    )


@query(f"""WITH e AS ({_AUDIT_SQL}), c AS (SELECT range AS ctx, 500 AS cutoff, CASE WHEN range % 2 = 0 THEN 700 END AS locked FROM range(7)),
        s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'OFFICIAL_ANALYSIS' ELSE 'INVESTIGATION_EVIDENCE' END AS vis, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 800 END AS pub, doc_id % 2 = 0 AS ok FROM documents),
        j AS (SELECT e.*, ctx, cutoff, locked, vis, pub, ok, stage = 'BLIND' AND capability IN ('EVIDENCE_READ', 'RETRIEVAL') AS reads, target IS NULL OR vis IS NULL AS lost, pub IS NULL OR pub > cutoff AS late FROM e JOIN c ON audit_case = ctx LEFT JOIN s ON target = doc_id),
        x AS (SELECT id, 'BLIND_BLOCKED_VISIBILITY_READ' AS code FROM j WHERE reads AND NOT lost AND vis <> 'INVESTIGATION_EVIDENCE'
          UNION ALL SELECT id, 'BLIND_POST_CUTOFF_READ' FROM j WHERE reads AND NOT lost AND late
          UNION ALL SELECT id, 'CLASSIFICATION_MISMATCH' FROM j WHERE reads AND NOT lost AND ok <> (vis = 'INVESTIGATION_EVIDENCE' AND NOT late)
          UNION ALL SELECT id, 'EVALUATION_BEFORE_LOCK' FROM j WHERE stage = 'EVALUATION' AND (locked IS NULL OR tick < locked)
          UNION ALL SELECT id, 'FORBIDDEN_BLIND_CAPABILITY' FROM j WHERE stage = 'BLIND' AND capability IN ('NTSB_ACQUISITION', 'CONTEXT_DEV', 'WEB_SEARCH', 'RAW_STORAGE')
          UNION ALL SELECT id, 'FORBIDDEN_BLIND_HOST' FROM j WHERE stage = 'BLIND' AND operation = 'NETWORK' AND coalesce(host NOT IN ('host0.example.com'), true)
          UNION ALL SELECT id, 'MALFORMED_AUDIT_EVENT' FROM j WHERE case_id <> ctx OR (reads AND lost)
          UNION ALL SELECT id, 'POST_LOCK_MUTATION' FROM j WHERE stage IN ('PROCESSING', 'BLIND') AND operation = 'WRITE' AND tick > locked)
      SELECT id AS event_id, code FROM x""")
def leakage_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    sources = table(spark, sf_dir, "documents").select(d.alias("document_id"), F.when(d % 3 == 0, "OFFICIAL_ANALYSIS").otherwise("INVESTIGATION_EVIDENCE").alias("visibility"), F.when(d % 4 != 0, d % 800).alias("published_at"), (d % 2 == 0).alias("metadata_eligible"))
    context = spark.range(7).select(F.col("id").alias("case_id"), F.lit(500).cast("long").alias("evidence_cutoff"), F.when(F.col("id") % 2 == 0, 700).cast("long").alias("locked_at"))
    return audit.leakage_incidents(audit_events(spark, sf_dir), sources, context, ["host0.example.com"]).select("event_id", "code")


@query(f"""WITH e AS ({_AUDIT_SQL}), x AS (
        SELECT 'ACTOR_STAGE' AS rule FROM e WHERE stage <> CASE actor_role WHEN 'PROCESSOR' THEN 'PROCESSING' ELSE actor_role END
        UNION ALL SELECT 'ALLOWED_DENY' FROM e WHERE operation = 'DENY' AND allowed UNION ALL SELECT 'BLOCKED_WITHOUT_DENY' FROM e WHERE NOT allowed AND operation <> 'DENY'
        UNION ALL SELECT 'HOST_FORM' FROM e WHERE host LIKE '%\\_%' ESCAPE '\\' UNION ALL SELECT 'HOST_MISSING' FROM e WHERE operation = 'NETWORK' AND host IS NULL UNION ALL SELECT 'HOST_UNEXPECTED' FROM e WHERE operation <> 'NETWORK' AND host IS NOT NULL)
      SELECT rule, count(*) AS n FROM x GROUP BY rule""")
def audit_event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(spark, sf_dir).select(F.explode(audit.audit_violations()).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+[.])?example[.]com([/:?#]|$)')")
def url_host_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(~integrity.host_allowed(F.col("url"), "example.com")).select("page_id")


@query("""WITH i AS (SELECT page_id % 10 AS case_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS idx, url, page_id % 3 = 0 AS process, CASE WHEN page_id % 4 <> 0 THEN 'x' END AS checksum FROM pages),
        d AS (SELECT *, row_number() OVER (PARTITION BY case_id, url ORDER BY idx) > 1 AS again FROM i)
      SELECT case_id, 'item ' || idx::VARCHAR || ' sourceUrl must use an example.com host' AS error FROM d WHERE NOT regexp_matches(lower(url), '^[a-z]+://([^/:?#]+[.])?example[.]com([/:?#]|$)')
      UNION ALL SELECT case_id, 'duplicate sourceUrl at item ' || idx::VARCHAR FROM d WHERE again
      UNION ALL SELECT case_id, 'processable item ' || idx::VARCHAR || ' is missing expectedChecksum' FROM d WHERE process AND checksum IS NULL
      UNION ALL SELECT case_id, 'non-processable item ' || idx::VARCHAR || ' must not pin downloaded bytes' FROM d WHERE NOT process AND checksum IS NOT NULL
      UNION ALL SELECT case_id, 'expected 20 docket items, found ' || count(*)::VARCHAR FROM d GROUP BY case_id HAVING count(*) <> 20""")
def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, case = F.col("page_id"), F.col("page_id") % 10
    items = table(spark, sf_dir, "pages").select(case.alias("case_id"), F.row_number().over(W.partitionBy(case).orderBy("page_id")).alias("index"), F.col("url").alias("source_url"), F.when(p % 3 == 0, "AI_ALLOWED").otherwise("LINK_ONLY").alias("processing_disposition"), F.when(p % 4 != 0, "x").alias("expected_checksum"))
    cases = spark.range(10).select(F.col("id").alias("case_id"), F.lit(20).alias("expected_item_count"))
    return integrity.manifest_errors(items, cases, "example.com", "an example.com").select("case_id", "error")


@query("""SELECT o_orderkey, previous FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)
      WHERE previous IS NOT NULL AND previous <> o_orderstatus AND NOT (previous || o_orderstatus IN ('OF', 'OP', 'PF'))""")
def lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.illegal_transitions(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus", [("O", "F"), ("O", "P"), ("P", "F")]).select("o_orderkey", "previous")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size < 45"), {"l_partkey": "p_partkey"}).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as one chained investigation."""
    return events.append(chain_rows(spark, sf_dir))


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those events, without hashes."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    rows = e.select(F.concat(F.lit("inv-"), F.col("user_id").cast("string")).alias("investigation_id"), F.lit("case").alias("case_id"), n.cast("long").alias("sequence"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), "event_type", "value", "event_id")
    first = F.col("sequence") == 1
    kind = F.when(first, "INVESTIGATION_STARTED").otherwise("CLAIM_CREATED")
    rows = rows.withColumn("event_type", kind).withColumn("target_type", F.when(first, "investigation").otherwise("claim")).withColumn("target_id", F.when(first, F.col("investigation_id")).otherwise(F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string"), F.lit("-"), "id")))
    payload = canonical.object_text({"kind": canonical.string_text(F.col("event_type")), "n": canonical.number_text(F.col("event_id")), "current_stage": canonical.string_text(F.lit(V.STAGES[0])), "status": canonical.string_text(F.lit("PENDING"))})
    rows = rows.withColumn("payload", payload).withColumn("model_run_id", F.lit(None).cast("string"))
    return rows.select("investigation_id", "case_id", "sequence", "id", "event_type", "target_type", "target_id", "payload", "model_run_id", "event_id")


@query("SELECT 'DIGEST' AS error, count(*) AS n FROM events WHERE event_id % 7 = 3")
def event_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh payload is tampered with; all of those and nothing else fail."""
    tampered = chain(spark, sf_dir).withColumn("payload", F.when(F.col("event_id") % 7 == 3, F.replace(F.col("payload"), F.lit("PENDING"), F.lit("RUNNING"))).otherwise(F.col("payload")))
    return events.chain_errors(tampered).groupBy("error").agg(F.count("*").alias("n"))


#: Hashes h of every user's events s, as SQL folds them.
CHAIN_SQL = """o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
        t AS (SELECT *, '", "payload": {"n": ' || event_id::VARCHAR || ', "kind": "' || CASE WHEN s = 1 THEN 'INVESTIGATION_STARTED' ELSE 'CLAIM_CREATED' END || '", "status": "PENDING", "current_stage": "PROMOTE_TIMELINE"}, "sequence": ' || s::VARCHAR
                     || ', "target_id": "' || CASE WHEN s = 1 THEN 'inv-' || user_id::VARCHAR ELSE 'c' || (event_id % 5)::VARCHAR || '-e' || event_id::VARCHAR END || '", "event_type": "' || CASE WHEN s = 1 THEN 'INVESTIGATION_STARTED' ELSE 'CLAIM_CREATED' END
                     || '", "target_type": "' || CASE WHEN s = 1 THEN 'investigation' ELSE 'claim' END || '", "model_run_id": null, "previous_hash": ' AS head, ', "investigation_id": "inv-' || user_id::VARCHAR || '"}' AS tail FROM o),
        c AS (SELECT user_id, s, sha256('{"case_id": "case' || head || 'null' || tail) AS h FROM t WHERE s = 1
              UNION ALL SELECT t.user_id, t.s, sha256('{"case_id": "case' || t.head || '"' || c.h || '"' || t.tail) FROM c JOIN t ON t.user_id = c.user_id AND t.s = c.s + 1)"""


@query(f"""WITH RECURSIVE {CHAIN_SQL}
      SELECT 'inv-' || user_id::VARCHAR AS investigation_id, max(s) AS events, max_by(h, s) AS head FROM c GROUP BY user_id""")
def event_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and head of every user's chain, which SQL folds one event a round."""
    return chain(spark, sf_dir).groupBy("investigation_id").agg(F.count("*").alias("events"), F.max_by("event_hash", "sequence").alias("head"))


@query("""SELECT p_brand, count(*) AS rows, sha256('[' || string_agg('{"size": ' || p_size::VARCHAR || ', "part_id": ' || p_partkey::VARCHAR || ', "part_name": ' || to_json(p_name)::VARCHAR || ', "part_type": ' || to_json(p_type)::VARCHAR || '}', ', ' ORDER BY p_partkey) || ']') AS set_hash FROM part GROUP BY p_brand""")
def evidence_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = canonical.object_text({"part_id": canonical.number_text(F.col("p_partkey")), "part_name": canonical.string_text(F.col("p_name")), "part_type": canonical.string_text(F.col("p_type")), "size": canonical.number_text(F.col("p_size"))})
    return events.set_digest(table(spark, sf_dir, "part"), "p_brand", "p_partkey", text)


@query("""SELECT conv_id, turn, '{"role": ' || to_json(role)::VARCHAR || ', "text": ' || to_json(text)::VARCHAR || ', "turn": ' || turn::VARCHAR || '}' AS text FROM conversations""")
def canonical_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = canonical.object_text({"turn": canonical.number_text(F.col("turn")), "text": canonical.string_text(F.col("text")), "role": canonical.string_text(F.col("role"))})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


@query("""WITH w AS (SELECT p_partkey % 50 AS query_id, p_partkey AS entity_id FROM part), n AS (SELECT query_id, count(*) AS n FROM w GROUP BY 1)
      SELECT query_id, l_orderkey, round(count(DISTINCT l_partkey) * 1.0 / n, 6)::DOUBLE AS entity_score FROM w JOIN lineitem ON l_partkey = entity_id JOIN n USING (query_id) GROUP BY query_id, l_orderkey, n""")
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("query_id"), F.col("p_partkey").alias("entity_id"))
    links = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("entity_id"))
    return retrieval.entity_scores(links, wanted, "l_orderkey").select("query_id", "l_orderkey", F.round("entity_score", 6).cast("double").alias("entity_score"))


@query("""WITH w AS (SELECT range AS query_id, TIMESTAMP '1995-01-01' + to_days((range * 100)::INT) AS a, CASE WHEN range % 2 = 0 THEN TIMESTAMP '1995-01-01' + to_days((range * 100 + 60)::INT) END AS b FROM range(5))
      SELECT DISTINCT query_id, l_orderkey FROM lineitem JOIN w ON l_shipdate >= a AND (b IS NULL OR l_shipdate <= b)""")
def time_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = "cast(id as int)"
    windows = spark.range(5).select(F.col("id").alias("query_id"), F.expr(f"timestampadd(DAY, {i} * 100, TIMESTAMP_NTZ '1995-01-01')").alias("start_at"), F.expr(f"if(id % 2 = 0, timestampadd(DAY, {i} * 100 + 60, TIMESTAMP_NTZ '1995-01-01'), null)").alias("end_at"))
    return retrieval.time_hits(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("occurred_at")), windows, "l_orderkey")


_NEAR_SQL = """
    SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS same, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"""
#: The vector part of a score: cosine, nothing below zero; the type part: the same label.
_HYBRID_SQL = f"SELECT query_id, vec_id, cosine, round(0.35 * greatest(cosine, 0)::DECIMAL(20,6) + 0.08 * same::INT, 4)::DECIMAL(5,4) AS score FROM ({_NEAR_SQL})"


@query(f"""SELECT query_id, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM ({_NEAR_SQL})) WHERE rank <= 10""")
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(e.where("vec_id % 50 = 0"), e, 10)


def _scored_pairs(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """query_id, vec_id, cosine, score: the k nearest vectors of each query, rescored
    with their labels."""
    e = table(spark, sf_dir, "embeddings")
    near = retrieval.nearest(e.where("vec_id % 50 = 0"), e, k).drop("rank")
    labels = e.select("vec_id", F.col("label").alias("own"))
    both = near.join(labels, "vec_id").join(labels.toDF("query_id", "asked"), "query_id")
    decimal = lambda c: c.cast("decimal(38,20)")
    parts = {"vector": decimal(F.greatest("cosine", F.lit(0.0)).cast("decimal(20,6)")), "type": decimal((F.col("own") == F.col("asked")).cast("int"))}
    return both.select("query_id", "vec_id", "cosine", retrieval.weighted_score(parts, retrieval.HYBRID_WEIGHTS).alias("score"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM ({_NEAR_SQL}))
      SELECT query_id, vec_id, round(0.35 * greatest(cosine, 0)::DECIMAL(20,6) + 0.08 * same::INT, 4)::DECIMAL(5,4)::VARCHAR AS score FROM n WHERE rank <= 100""")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_pairs(spark, sf_dir, 100).select("query_id", "vec_id", F.col("score").cast("string").alias("score"))


_RECALL_SQL = """SELECT l_suppkey, list(l_partkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey) AS ranked, list_distinct(list(l_partkey) FILTER (l_returnflag = 'R')) AS expected FROM lineitem GROUP BY l_suppkey"""


@query(f"SELECT l_suppkey, len(list_intersect(list_distinct(ranked[1:10]), expected)) AS hits, len(expected) AS expected FROM ({_RECALL_SQL})")
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_partkey", "l_orderkey"))), lambda x: x["l_partkey"])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(ranked.alias("ranked"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("expected"))
    hits, expected = retrieval.recall_parts(F.col("ranked"), F.col("expected"))
    return rows.select("l_suppkey", hits.alias("hits"), expected.alias("expected"))


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each query vector: the ids of its label are expected, the nearest
    ten are the baseline, the best ten of the rescored hundred the candidate."""
    e, pairs = table(spark, sf_dir, "embeddings"), durable(_scored_pairs(spark, sf_dir, 100), "probe")

    def first(*order: Column) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
        return pairs.withColumn("place", place).where("place <= 10").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))

    base, best = first(F.desc("cosine"), F.asc("vec_id")).toDF("query_id", "baseline"), first(F.desc("score"), F.asc("vec_id")).toDF("query_id", "hybrid")
    expected = e.groupBy("label").agg(F.collect_list("vec_id").alias("expected"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.element_at(F.array(*map(F.lit, V.PROBE_CATEGORIES)), (F.floor(F.col("vec_id") / 50) % 4 + 1).cast("int")).alias("category"))
    return q.join(expected, "label").join(base, "query_id").join(best, "query_id").select("query_id", "category", "expected", "baseline", "hybrid")


_CATEGORIES = ", ".join(f"'{c}'" for c in V.PROBE_CATEGORIES)
_PROBE_SQL = f"""
    WITH near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS by_cosine FROM ({_NEAR_SQL})),
         top AS (SELECT *, round(0.35 * greatest(cosine, 0)::DECIMAL(20,6) + 0.08 * same::INT, 4)::DECIMAL(5,4) AS score FROM near WHERE by_cosine <= 100),
         placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS by_score FROM top),
         size AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
         hit AS (SELECT query_id, sum((same AND by_cosine <= 10)::INT) AS base, sum((same AND by_score <= 10)::INT) AS best FROM placed GROUP BY 1)
    SELECT query_id, ([{_CATEGORIES}])[1 + (query_id // 50) % 4] AS category, base, best, n FROM hit JOIN embeddings ON vec_id = query_id JOIN size USING (label)
"""


@query(f"""WITH p AS ({_PROBE_SQL}), c AS (SELECT category, sum((best - base)::DOUBLE / n) AS gain, count(*) AS n FROM p GROUP BY 1)
      SELECT CASE WHEN sum(n) < 12 THEN 'TOO_FEW' WHEN count(*) < 4 THEN 'CATEGORY_MISSING' END AS error,
             CASE WHEN sum(n) >= 12 AND count(*) = 4 THEN sum(gain) / sum(n) >= 0.1 AND sum((gain > 0)::INT) >= 2 AND bool_and(gain / n >= -0.05) END AS passed FROM c""")
def recall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall_gate(_probe(spark, sf_dir))


@query(f"SELECT query_id, category, base::BIGINT AS base, best::BIGINT AS best, n AS expected FROM ({_PROBE_SQL})")
def recall_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, n = retrieval.recall_parts(F.col("baseline"), F.col("expected"))
    best, _ = retrieval.recall_parts(F.col("hybrid"), F.col("expected"))
    return _probe(spark, sf_dir).select("query_id", "category", base.alias("base"), best.alias("best"), n.alias("expected"))


@query(r"""WITH b AS (SELECT 'b' || s::VARCHAR AS gate, s, range AS q FROM range(12), (VALUES (0), (1), (2), (3), (4), (5)) AS t(s)),
        x AS (SELECT gate, s, q, q % 4 AS c, CASE s WHEN 0 THEN [10, 9, 5, 4] WHEN 1 THEN [9, 9, 5, 4] WHEN 2 THEN [10, 10, 7, 3] WHEN 3 THEN [5, 5, 5, 5] WHEN 4 THEN [11, 9, 4, 4] ELSE [13, 5, 5, 5] END AS hit FROM b),
        g AS (SELECT gate, s, c, sum(least(hit[1 + c], 10) - 5) AS gain FROM x GROUP BY ALL)
      SELECT gate, sum(gain) * 10 >= 12 * 20 AND sum((gain > 0)::INT) >= 2 AND bool_and(gain * 20 >= -3 * 20) AS passed FROM g GROUP BY gate""")
def recall_gate_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of twelve samples of twenty expected ids against five, on both sides of
    each condition: mean gains of exactly 1/10 and -1/20 pass."""
    ids = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("e"), i.cast("string")))
    out = None
    for s, hits in enumerate(((10, 9, 5, 4), (9, 9, 5, 4), (10, 10, 7, 3), (5, 5, 5, 5), (11, 9, 4, 4), (13, 5, 5, 5))):
        c = (F.col("id") % 4 + 1).cast("int")
        samples = spark.range(12).select(F.col("id").alias("query_id"), F.element_at(F.array(*map(F.lit, V.PROBE_CATEGORIES)), c).alias("category"), ids(F.lit(20)).alias("expected"), ids(F.lit(5)).alias("baseline"), ids(F.element_at(F.array(*map(F.lit, hits)), c)).alias("hybrid"))
        one = retrieval.recall_gate(samples).select(F.lit(f"b{s}").alias("gate"), "passed")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of a language whose folded tokens overlap too much; SQL has no
    compatibility folding."""
    drafts = table(spark, sf_dir, "documents").select("lang", "doc_id", english.folded_tokens(F.col("text")).alias("tokens"))
    return promotion.too_similar(drafts, "lang", "doc_id", "tokens").select("lang", "left_id", "right_id", "shared", "total")


@query(r"""
    WITH d AS (SELECT lang, doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
         x AS (SELECT lang, doc_id, len(t) AS n, unnest(t) AS w FROM d),
         s AS (SELECT a.lang, a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS shared, any_value(a.n + b.n) AS sizes
               FROM x a JOIN x b ON a.lang = b.lang AND a.w = b.w AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY 1, 2, 3)
    SELECT lang, left_id, right_id, shared, sizes - shared AS total FROM s WHERE 4 * shared > 3 * (sizes - shared)
    UNION ALL SELECT a.lang, a.doc_id, b.doc_id, 1, 1 FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(a.t) = 0 AND len(b.t) = 0
""")
def ascii_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    drafts = table(spark, sf_dir, "documents").select("lang", "doc_id", words.alias("tokens"))
    return promotion.too_similar(drafts, "lang", "doc_id", "tokens").select("lang", "left_id", "right_id", "shared", "total")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - 1 AS b FROM customer WHERE c_custkey % 6 <> 1 AND c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_custkey FROM customer),
        r AS (SELECT DISTINCT a AS node, a AS reach FROM (SELECT a FROM e UNION SELECT b FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
      SELECT node, min(reach) AS component FROM r GROUP BY node""")
def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, linked to its predecessor but for some that begin a chain."""
    c = F.col("c_custkey")
    linked = (c % 6 != 1) & (c % 10 != 0)
    return components.connected_components(table(spark, sf_dir, "customer").select(c.alias("a"), F.when(linked, c - 1).otherwise(c).alias("b")))


_JOBS_SQL = """SELECT o_orderkey AS id, o_custkey AS investigation_id, o_orderpriority AS work_key, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status, o_orderkey % 5 AS attempts FROM orders"""


@query(f"""WITH j AS ({_JOBS_SQL}) SELECT investigation_id, id FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY created_at, work_key, id) AS rn FROM j
      WHERE status = 'PENDING' AND attempts < 3 AND investigation_id NOT IN (SELECT investigation_id FROM j WHERE status = 'RUNNING')) WHERE rn = 1""")
def claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("investigation_id"), F.col("o_orderpriority").alias("work_key"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SUCCEEDED").alias("status"), (F.col("o_orderkey") % 5).alias("attempts"))
    return jobs.claimable(rows).select("investigation_id", "id")


@query("""SELECT user_id AS investigation_id, (rn // 3)::BIGINT::VARCHAR AS work_key FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events) GROUP BY 1, 2
      EXCEPT SELECT user_id, '0' FROM events WHERE user_id % 2 = 0""")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    units = e.select(F.col("user_id").alias("investigation_id"), F.col("event_id").alias("unit_id"), F.lit("h").alias("input_hash"))
    queued = e.where("user_id % 2 = 0").select(F.col("user_id").alias("investigation_id"), F.lit("PROMOTE_CLAIMS").alias("stage"), F.lit("0").alias("work_key"), F.lit("h").alias("input_hash")).distinct()
    return jobs.work_list("PROMOTE_CLAIMS", units, queued).select("investigation_id", "work_key")


@query("SELECT event_type AS model, (user_id % 3)::VARCHAR AS shape, count(*) AS calls, sum((event_id % 4 <> 0)::INT)::BIGINT AS valid, round(avg(event_id % 1000), 3) AS mean_s FROM events GROUP BY 1, 2")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latency_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 3).cast("string").alias("shape"), (F.col("event_id") % 4 != 0).alias("valid"), (F.col("event_id") % 1000).alias("seconds")))


@query("SELECT event_id, (epoch_us(nxt) - epoch_us(ts)) // 1000 AS duration_ms FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def span_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lead(F.col("ts").cast("timestamp")).over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("nxt"))
    return e.where("nxt is not null").select("event_id", jobs.duration_ms(F.col("ts"), F.col("nxt")).alias("duration_ms"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT time_bucket(INTERVAL 10 MINUTE, ts)) AS windows FROM events GROUP BY 1")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows, of which SQL checks the totals."""
    found = logs.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return found.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("windows"))


@query("SELECT n_regionkey, string_agg(n_nationkey::VARCHAR || '=' || n_name, ',' ORDER BY n_nationkey::VARCHAR) AS objects FROM nation GROUP BY 1")
def keyed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.keyed_objects(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", F.col("n_name"))
    return found.select("n_regionkey", F.array_join(F.transform(F.array_sort(F.map_entries("objects")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("objects"))
