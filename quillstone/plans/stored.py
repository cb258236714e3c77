"""What changes stored state, over the driver's tables: appends, job commands, merges."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V
from quillstone.functions.storage import durable, keep_until_exit, shared_dir
from quillstone.operators import events, job_commands
from quillstone.plans import investigation
from quillstone.plans.base import query, table
from quillstone.sources import buckets, tables

#: Events of a user that the first append takes.
FIRST = 10


@query(f"""
    WITH RECURSIVE {investigation.CHAIN_SQL},
    n AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS n FROM c),
    k AS (SELECT *, CASE WHEN n > {FIRST} AND user_id % 5 = 2 THEN 'STALE_HEAD' END AS error FROM n)
    SELECT 'inv-' || user_id::VARCHAR AS investigation_id, max(s) AS events, max_by(h, s) AS head, error FROM k WHERE error IS NULL OR s <= {FIRST} GROUP BY user_id, error
""")
def event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's chain in two appends; the second of every fifth user saw an old head."""
    rows = durable(investigation.chain_rows(spark, sf_dir), "events")
    inv = rows.select("investigation_id").distinct()
    none = inv.select("investigation_id", F.lit(0).cast("long").alias("sequence"), F.lit(None).cast("string").alias("event_hash"))
    _, _, heads = events.append_stored(none, rows.where(F.col("sequence") <= FIRST), none)
    heads = durable(heads, "heads")
    late = rows.where(F.col("sequence") > FIRST).withColumn("sequence", F.col("sequence") - FIRST)
    user = F.substring("investigation_id", 5, 20).cast("long")
    seen = heads.withColumn("sequence", F.when(user % 5 == 2, F.col("sequence") - 1).otherwise(F.col("sequence")))
    _, errors, heads = events.append_stored(heads, late, seen)
    return heads.join(errors, "investigation_id", "left").select("investigation_id", F.col("sequence").alias("events"), F.col("event_hash").alias("head"), "error")


#: By remainder of the order's key: minute, kind, worker, attempt, failure of each command.
SCENARIOS = (
    ((0, "CLAIM", "w1", None, None), (10, "COMPLETE", "w1", 1, None)),
    ((0, "CLAIM", "w1", None, None), (31, "COMPLETE", "w1", 1, None), (40, "CLAIM", "w2", None, None), (41, "COMPLETE", "w1", 1, None), (50, "COMPLETE", "w2", 2, None)),
    ((0, "CLAIM", "w1", None, None), (30, "CLAIM", "w1", None, None), (60, "CLAIM", "w1", None, None), (90, "CLAIM", "w1", None, None)),
    ((0, "CLAIM", "w1", None, None), *((m, "RESERVE", "w1", 1, None) for m in (1, 2, 3, 4))),
    ((0, "CLAIM", "w1", None, None), (4, "CLAIM", "w3", None, None), (5, "COMPLETE", "w2", 1, None)),
    ((0, "CLAIM", "w1", None, None), (5, "FAIL", "w1", 1, "SCHEMA_INVALID"), (6, "CLAIM", "w1", None, None)),
    ((0, "CLAIM", "w1", None, None), (5, "FAIL", "w1", 1, "TIRED")),
    ((0, "CLAIM", "w1", None, None), *((m, "RESERVE", "w1", 1, None) for m in (1, 2, 3)), (40, "CLAIM", "w2", None, None)),
)
_COMMAND = "array<struct<minute:int,kind:string,worker_id:string,attempt:int,failure_code:string>>"


def _ran(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every order as an investigation of one job, which its scenario's commands meet."""
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(k, k.cast("string").alias("investigation_id"))
    start = F.lit("2024-01-01").cast("timestamp")
    empty = lambda kind: F.lit(None).cast(kind)
    investigations = own.select("investigation_id", F.lit("PENDING").alias("status"), F.lit(V.STAGES[0]).alias("current_stage"))
    jobs = own.select(
        F.concat(F.lit("j"), "investigation_id").alias("id"), "investigation_id", F.lit(V.STAGES[0]).alias("stage"), F.lit("0").alias("work_key"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempt_count"), F.lit(0).alias("model_request_count"),
        empty("string").alias("worker_id"), empty("timestamp").alias("claimed_at"), empty("timestamp").alias("lease_expires_at"), empty("string").alias("failure_code"), start.alias("created_at"), empty("timestamp").alias("completed_at"),
    )
    lists: list[Column] = [F.array(*(F.struct(*(F.lit(x) for x in c)) for c in s)).cast(_COMMAND) for s in SCENARIOS]
    each = own.select(k, "investigation_id", F.posexplode(F.element_at(F.array(*lists), (k % len(SCENARIOS) + 1).cast("int"))).alias("place", "c"))
    commands = each.select((k * 10 + F.col("place")).alias("command_no"), "investigation_id", F.timestamp_add("MINUTE", F.col("c.minute"), start).alias("at"), "c.kind", "c.worker_id", F.concat(F.lit("j"), "investigation_id").alias("job_id"), "c.attempt", "c.failure_code")
    return job_commands.run_commands(investigations, jobs, commands)


_S0, _S1 = V.STAGES[:2]


@query(f"""
    SELECT 'j' || o_orderkey::VARCHAR AS id, s.* EXCLUDE (r) FROM orders JOIN (VALUES
        (0, 'SUCCEEDED', 1, 0, NULL, NULL, 'RUNNING', '{_S1}'), (1, 'SUCCEEDED', 2, 0, NULL, NULL, 'RUNNING', '{_S1}'),
        (2, 'FAILED', 3, 0, NULL, 'LEASE_EXPIRED', 'FAILED', '{_S0}'), (3, 'RUNNING', 1, 3, 'w1', NULL, 'RUNNING', '{_S0}'),
        (4, 'RUNNING', 1, 0, 'w1', NULL, 'RUNNING', '{_S0}'), (5, 'FAILED', 1, 0, NULL, 'SCHEMA_INVALID', 'FAILED', '{_S0}'),
        (6, 'RUNNING', 1, 0, 'w1', NULL, 'RUNNING', '{_S0}'), (7, 'FAILED', 1, 3, NULL, 'LEASE_EXPIRED', 'FAILED', '{_S0}')
    ) s(r, status, attempts, requests, worker_id, failure_code, investigation_status, current_stage) ON r = o_orderkey % 8
""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners, jobs, _ = _ran(spark, sf_dir)
    owners = owners.select("investigation_id", F.col("status").alias("investigation_status"), "current_stage")
    return jobs.join(owners, "investigation_id").select("id", "status", F.col("attempt_count").alias("attempts"), F.col("model_request_count").alias("requests"), "worker_id", "failure_code", "investigation_status", "current_stage")


@query("""
    SELECT o_orderkey * 10 + place AS command_no, error FROM orders JOIN (VALUES
        (1, 1, 'LEASE_LOST'), (1, 3, 'LEASE_LOST'), (3, 4, 'REQUESTS_EXHAUSTED'), (4, 2, 'LEASE_LOST'), (6, 1, 'UNKNOWN_FAILURE')
    ) s(r, place, error) ON r = o_orderkey % 8
""")
def refused_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, sf_dir)[2].where("error is not null").select("command_no", "error")


@query("""
    WITH new AS (
        SELECT o_orderkey AS k, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS guard, 'changed' AS note FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT -o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 0
    ), old AS (SELECT o_orderkey AS k, o_custkey AS guard, o_orderpriority AS note FROM orders)
    SELECT coalesce(o.k, n.k) AS k, coalesce(o.guard, n.guard) AS guard, CASE WHEN o.k IS NULL OR o.guard = n.guard THEN n.note ELSE o.note END AS note, false AS refused FROM old o FULL JOIN new n ON o.k = n.k
    UNION ALL SELECT n.k, n.guard, n.note, true FROM new n JOIN old o ON o.k = n.k AND o.guard <> n.guard
""")
def guarded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stored table; a fifth are changed, of which a third by a row with another
    guard, and some are new. What is refused comes out with the merged table."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    stored = orders.select(k.alias("k"), F.col("o_custkey").alias("guard"), F.col("o_orderpriority").alias("note"))
    path = keep_until_exit(spark, f"{shared_dir(spark)}/quillstone-orders-{uuid.uuid4().hex}")
    target = buckets.create(stored, path, ["k"], 16)
    changed = orders.where(k % 5 == 0).select(k.alias("k"), (F.col("o_custkey") + F.when(k % 3 == 0, 1).otherwise(0)).alias("guard"), F.lit("changed").alias("note"))
    new = orders.where((k % 7 == 0) & (k > 0)).select((-k).alias("k"), F.col("o_custkey").alias("guard"), F.lit("new").alias("note"))
    refused = target.merge(changed.unionByName(new), [F.asc("note"), F.asc("guard")], guard=["guard"])
    return target.read().withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@query("""
    SELECT sha256(coalesce(text, '')) AS checksum, substr(sha256(coalesce(text, '')), 1, 2) AS prefix, any_value(octet_length(encode(coalesce(text, '')))) AS size, count(DISTINCT coalesce(text, '')) AS files
    FROM documents GROUP BY 1, 2
""")
def stored_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as contents, put in two puts of which the second has the first one's too."""
    text = F.coalesce("text", F.lit("")).cast("binary").alias("content")
    files = table(spark, sf_dir, "documents").select("doc_id", text)
    folder = keep_until_exit(spark, f"{shared_dir(spark)}/quillstone-blobs-{uuid.uuid4().hex}")
    tables.put_blobs(files.where("doc_id % 2 = 0").select("content"), folder)
    tables.put_blobs(files.select("content"), folder)
    copies = spark.read.parquet(folder).groupBy("checksum").agg(F.count("*").alias("files"))
    return tables.stored_blobs(spark, folder).join(copies, "checksum").select("checksum", "prefix", "size", "files")


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PARTS = {
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Orders" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}"><si><t>key</t></si><si><t>status</t></si><si><t>priority</t></si></sst>',
}


def _workbooks(sheets: DataFrame) -> DataFrame:
    """path and content of workbooks whose one sheet has the rows in ``xml``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for rows in batch.column("xml").to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name, text in _PARTS.items():
                        z.writestr(name, text)
                    z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{rows}</sheetData></worksheet>')
                contents.append(out.getvalue())
            yield pa.record_batch([batch.column("path"), pa.array(contents, pa.binary())], ["path", "content"])

    return sheets.mapInArrow(run, "path string, content binary")


@query("""
    SELECT o_custkey::VARCHAR AS path, 'Orders' AS sheet, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no,
           o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS "row"
    FROM orders
""")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of every customer's orders; a third have an empty last cell."""
    cell = lambda c: F.concat(F.lit('<c t="inlineStr"><is><t>'), F.col(c), F.lit("</t></is></c>"))
    last = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(cell("o_orderpriority"))
    row = F.concat(F.lit("<row><c><v>"), F.col("o_orderkey").cast("string"), F.lit("</v></c>"), cell("o_orderstatus"), last, F.lit("</row>"))
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", row.alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))), lambda r: r["row"]), "")
    head = F.lit("<row>" + "".join(f'<c t="s"><v>{i}</v></c>' for i in range(3)) + "</row>")
    files = _workbooks(own.groupBy("path").agg(F.concat(head, body).alias("xml")).select("path", "xml"))
    return tables.read_tables(files).where("error is null").select("path", "sheet", "row_no", F.array_join("row", "|").alias("row"))
