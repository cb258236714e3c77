"""Further operators on small fixtures."""

from __future__ import annotations

import json
import struct
import zlib
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators import audit, events, falsification, integrity, jobs, promotion, relational, visibility
from quillstone.sources import locators, structure, tables
from tests.test_operators import CUTOFF, rows


def test_temporal_consistency(spark):
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    line = spark.createDataFrame([("a", t0, "EXACT", ["e1"]), ("b", t1, "EXACT", ["e2"]), ("c", t1, "APPROXIMATE", ["e2"]), ("d", None, "EXACT", ["e2"]), ("f", t0, "EXACT", ["e3"])], "id string, occurred_at timestamp, time_precision string, evidence_ids array<string>")
    tests = spark.createDataFrame([("before", "a", "b", ["e1", "e2"]), ("after", "b", "a", ["e1", "e2"]), ("equal", "a", "f", ["e1", "e3"]), ("vague", "a", "c", ["e1", "e2"]), ("none", "a", "d", ["e1", "e2"]), ("scope", "a", "b", ["e1"])], "test_id string, before_event_id string, after_event_id string, scope array<string>")
    got = dict(rows(falsification.temporal_consistency(tests, line), "test_id", "outcome"))
    assert got == {"before": "SURVIVED", "after": "CONTRADICTED", "equal": "CONTRADICTED", "vague": "INCONCLUSIVE", "none": "INCONCLUSIVE", "scope": "INCONCLUSIVE"}


def test_audit_event_rules(spark):
    schema = "stage string, actor_role string, operation string, network_host string, allowed boolean"
    data = [("BLIND", "BLIND", "READ", None, True), ("BLIND", "PROCESSOR", "READ", None, True), ("BLIND", "BLIND", "NETWORK", None, True), ("BLIND", "BLIND", "READ", "a.b", True), ("BLIND", "BLIND", "DENY", None, True), ("BLIND", "BLIND", "READ", None, False), ("BLIND", "BLIND", "NETWORK", "A_b", True)]
    got = [r.v for r in spark.createDataFrame(data, schema).select(audit.audit_violations().alias("v")).collect()]
    assert got == [[], ["ACTOR_STAGE"], ["HOST_MISSING"], ["HOST_UNEXPECTED"], ["ALLOWED_DENY"], ["BLOCKED_WITHOUT_DENY"], ["HOST_FORM"]]


def test_links_and_routes(spark):
    one = spark.range(1)
    s = lambda x: F.lit(x).cast("string")
    d = lambda **k: visibility.link_decision(*(s(k.get(n, v)) for n, v in (("state", "BLIND"), ("cutoff", "x"), ("disposition", "AI_ALLOWED"), ("checksum", "c"), ("expected", None))), F.lit(k.get("ok", True)))
    got = one.select(*(c.alias(f"c{i}") for i, c in enumerate([d(), d(state="LOCKED"), d(cutoff=None), d(disposition="LINK_ONLY"), d(checksum=None), d(expected="z"), d(ok=False)]))).first()
    assert got[:] == (None, "CASE_NOT_OPEN", "CUTOFF_MISSING", "DISPOSITION", "CHECKSUM_MISSING", "CHECKSUM_MISMATCH", "NOT_ELIGIBLE")
    got = one.select(visibility.default_disposition(s("UNKNOWN"), s(None)).alias("a"), visibility.rights_violation(s("UNKNOWN"), s("LOCAL_ONLY")).alias("b"), visibility.review_status(F.lit(0.69)).alias("c"), structure.route(s("CSV"), {"t": ("CSV",), "x": ("TEXT",)}).alias("d"), structure.route(s("PDF"), {"t": ("CSV",)}).alias("e")).first()
    assert got[:] == ("LINK_ONLY", True, "PENDING", "t", "UNSUPPORTED")


def test_secured_rows_and_guards(spark):
    sources = spark.createDataFrame([("s1", "c1"), ("s2", "c2")], "id string, case_id string")
    none = spark.createDataFrame([], "case_id string")
    locks = spark.createDataFrame([("c2",)], "case_id string")
    items = spark.createDataFrame([(1, "s1"), (2, "s2")], "i int, source string")
    assert rows(visibility.secured_by_source("evaluation", items, "source", sources, none, none, locks), "i") == [(2,)]
    cases = spark.createDataFrame([("c1", "BLIND"), ("c2", "LOCKED"), ("c3", "REVEALED")], "id string, state string")
    assert rows(integrity.locked_without_lock(cases, locks), "id") == [("c3",)]
    assert rows(integrity.written_when_closed(sources, cases), "id") == [("s2",)]
    assert rows(integrity.outside_vocabulary(cases, "state", ["BLIND", "LOCKED"]), "id") == [("c3",)]
    a = spark.createDataFrame([("table", "t", True)], "kind string, name string, flag boolean")
    b = spark.createDataFrame([("table", "t", True), ("table", "u", False)], "kind string, name string, flag boolean")
    assert rows(integrity.catalog_differences(a, b), "name") == [("u",)]
    old = spark.createDataFrame([("k", "x")], "k string, checksum string")
    new = spark.createDataFrame([("k", "y"), ("k", "x"), ("m", "z")], "k string, checksum string")
    assert rows(relational.guarded_conflicts(old, new, ["k"], "checksum")) == [("k", "y")]


def test_lock_rules(spark):
    schema = "state string, evidence_cutoff timestamp, snapshot_valid boolean, model_versions map<string,string>, prompt_versions map<string,string>, locked boolean, evidence_rows long"
    df = spark.createDataFrame([("BLIND", CUTOFF, True, {"m": "1"}, {"p": "1"}, False, 1), ("LOCKED", None, False, {}, {"p": "1"}, True, 0)], schema)
    got = [r.e for r in df.select(events.lock_errors().alias("e")).collect()]
    assert got == [[], ["ALREADY_LOCKED", "CUTOFF_MISSING", "NOT_BLIND", "NO_EVIDENCE", "SNAPSHOT", "VERSIONS"]]


def test_drafts_and_critiques(spark):
    schema = "investigation_id string, hypothesis_id string, confidence double, supporting_claim_ids array<string>, contradicting_claim_ids array<string>"
    claims = spark.createDataFrame([("k1",), ("k2",)], "claim_id string")
    good = spark.createDataFrame([("i", f"h{n}", 0.5, ["k1"], ["k2"]) for n in range(3)], schema)
    assert promotion.draft_errors(good, claims).count() == 0 and promotion.hypothesis_links(good).count() == 6
    bad = spark.createDataFrame([("i", "h", 0.50001, ["k1"], ["zz"])], schema)
    assert {e for _, e in rows(promotion.draft_errors(bad, claims))} == {"DRAFT_COUNT", "UNKNOWN_CLAIM", "CONFIDENCE"}
    c = spark.createDataFrame([("c", ["k1", "zz"], [])], "critique_id string, reference_ids array<string>, tests array<struct<status:string>>")
    assert {e for _, e in rows(promotion.critique_errors(c, claims.withColumnRenamed("claim_id", "id")))} == {"UNKNOWN_REFERENCE", "TEST_COUNT"}
    n = spark.createDataFrame([("d", "b", "PUMP"), ("d", "a", "Pump")], "draft_id string, candidate_id string, name string")
    assert rows(promotion.first_spelling(n)) == [("d", "pump", "Pump")]
    t = spark.createDataFrame([("c1", CUTOFF, "EXACT", "Power lost", ["e1"])], "candidate_id string, occurred_at timestamp, time_precision string, description string, evidence_ids array<string>")
    d = spark.createDataFrame([("d", CUTOFF, "APPROXIMATE", "power  LOST", ["e1"], ["c1"])], "draft_id string, occurred_at timestamp, time_precision string, description string, evidence_ids array<string>, source_candidate_ids array<string>")
    assert rows(promotion.timeline_errors(t, d, spark.createDataFrame([("e1",)], "evidence_id string")), "error") == [("CHANGED_TIME_PRECISION",)]


def test_jobs(spark):
    j = spark.createDataFrame([("i", "PROMOTE_CLAIMS", "SUCCEEDED"), ("i", "COMPLETE", "PENDING")], "investigation_id string, stage string, status string")
    assert rows(jobs.stage_complete(j), "stage", "next_stage") == [("PROMOTE_CLAIMS", "GENERATE_HYPOTHESES")]
    a = spark.createDataFrame([(1, "RUNNING", datetime(2024, 1, 1, 0, 0)), (2, "RUNNING", datetime(2024, 1, 1, 0, 20))], "id int, status string, leased_at timestamp")
    assert rows(jobs.expired(a, F.lit(datetime(2024, 1, 1, 0, 30))), "id") == [(1,)]
    r = spark.createDataFrame([("j", "SCHEMA_FAILED"), ("j", "SUCCEEDED")], "job_id string, status string")
    assert rows(jobs.request_accounts(r)) == [("j", 2, 1, 1, 1)]


def test_pages_and_images(spark):
    box = lambda x: (x, x, x + 0.1, x + 0.1)
    units = spark.createDataFrame([("d", 1, 2, "s", box(0.5), "second"), ("d", 1, 1, "s", box(0.1), "first"), ("d", 2, 3, None, box(0.1), "third")], "document_id string, page int, reading_order int, section string, bounding_box struct<x1:double,y1:double,x2:double,y2:double>, text string")
    asked = {"page": {}, "order": {"reading_order": 2}, "paragraph": {"paragraph": 1, "section": "s"}, "box": {"bounding_box": {"x1": 0.5, "y1": 0.5, "x2": 0.6, "y2": 0.6}}, "none": {"paragraph": 3}, "no section": {"section": "t"}}
    loc = spark.createDataFrame([(k, "d", json.dumps({"kind": "pdf", "page": 1, **v})) for k, v in asked.items()], "locator_id string, document_id string, locator string")
    got = {r.locator_id: (r.text, r.error) for r in locators.resolve_pages(units, loc).collect()}
    lost = (None, "PDF locator does not resolve to extracted text")
    assert got == {"page": ("first\nsecond", None), "order": ("second", None), "paragraph": ("first", None), "box": ("second", None), "none": lost, "no section": lost}
    pages = spark.createDataFrame([("d", 1, 10.0, 10.0), ("d", 2, 10.0, 10.0)], "document_id string, page int, width double, height double")
    pics = spark.createDataFrame([("d", 1, 0.0, 5.0, 10.0, 0.0), ("d", 1, 0.0, 10.0, 10.0, 0.0)], "document_id string, page int, l double, r double, t double, b double")
    assert rows(structure.picture_coverage(pics, pages)) == [("d", 1, 1.0), ("d", 2, 0.0)]
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x02\0\0\0" + struct.pack(">I", zlib.crc32(b""))
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00"
    df = spark.createDataFrame([(1, png), (2, jpeg), (3, b"no"), (4, None)], "i int, c binary")
    got = [tuple(r.h) for r in df.orderBy("i").select(structure.image_header("c").alias("h")).collect()]
    assert got == [("PNG", 640, 480), ("JPEG", 32, 16), (None, None, None), (None, None, None)]


def test_manifest_and_scan(spark, tmp_path):
    schema = T.StructType([T.StructField("caseId", T.StringType()), T.StructField("items", T.ArrayType(T.StructType([T.StructField("title", T.StringType())])))])
    (tmp_path / "m.json").write_text(json.dumps({"caseId": "c", "items": [{"title": "a"}, {"title": "b"}]}, indent=1))
    assert len(tables.read_manifest(spark, str(tmp_path / "m.json"), schema).first()["items"]) == 2
    spark.range(10).write.parquet(str(tmp_path / "t"))
    assert tables.scan(spark, str(tmp_path / "t"), T.StructType([T.StructField("id", T.LongType())]), F.col("id") > 6).count() == 3


def test_set_digest_is_in_key_order(spark):
    import hashlib

    df = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("g", 10, "c")], "g string, k int, t string")
    assert rows(events.set_digest(df, "g", "k", F.col("t"))) == [("g", 3, hashlib.sha256(b"[a, b, c]").hexdigest())]


def png_of(pixels, colour, filters):
    """A PNG of 8 bits a sample, each line under one of the five filters."""
    height, width, step = pixels.shape
    raw, above = b"", [0] * (width * step)
    for y in range(height):
        line = pixels[y].ravel().tolist()
        left = lambda x: line[x - step] if x >= step else 0
        corner = lambda x: above[x - step] if x >= step else 0

        def paeth(x):
            a, b, c = left(x), above[x], corner(x)
            return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]

        guess = {0: lambda x: 0, 1: left, 2: lambda x: above[x], 3: lambda x: (left(x) + above[x]) // 2, 4: paeth}[filters[y % len(filters)]]
        raw += bytes([filters[y % len(filters)], *((v - guess(x)) % 256 for x, v in enumerate(line))])
        above = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return locators.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_crops(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for colour, step in locators.CHANNELS.items():
        pixels = rng.integers(0, 256, (7, 9, step), dtype=np.uint8)
        whole = png_of(pixels, colour, [0, 1, 2, 3, 4])
        assert locators.crop_png(whole, 2, 1, 6, 7) == locators.crop_png(png_of(pixels[1:7, 2:6], colour, [4, 3]), 0, 0, 4, 6)
        beyond = np.zeros((4, 4, step), np.uint8)
        beyond[:2, :3] = pixels[5:, 6:]
        assert locators.crop_png(whole, 6, 5, 10, 9) == locators.crop_png(png_of(beyond, colour, [0]), 0, 0, 4, 4)
    image = png_of(pixels, 6, [2])
    at = lambda **k: json.dumps({"kind": "image", "width": 9, "height": 7, **k})
    data = [(1, image, at()), (2, image, at(region={"x1": 1.4, "y1": 0.6, "x2": 3.5, "y2": 2.5})), (3, image, at(width=8)), (4, b"no", at()), (5, image[:40], at(region={"x1": 0, "y1": 0, "x2": 1, "y2": 1})), (6, b"x", '{"kind": "video"}'), (7, b"\xff", '{"kind": "text", "start": 0, "end": 0}')]
    got = {r.locator_id: (r.media_type, r.content and bytes(r.content), r.error) for r in locators.resolve(spark.createDataFrame(data, "locator_id int, content binary, locator string")).collect()}
    assert got[1] == ("image/png", image, None) and got[2] == ("image/png", locators.crop_png(image, 1, 1, 4, 2), None)
    assert [got[i][2] for i in range(3, 8)] == ["image dimensions do not match locator", "image source cannot be decoded", "image source cannot be decoded", "no locator adapter supports this locator", "text source is not UTF-8"]


def test_typed_cells():
    sheet = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
        <row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row>
        <row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>1.50</v></c></row><row r="3"><c r="A3" s="2"><v>45292.5</v></c><c r="B3" t="b"><v>0</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>"""
    styles = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>"""
    book = """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>"""
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in (("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", rels), ("xl/worksheets/sheet1.xml", sheet), ("xl/styles.xml", styles)):
            z.writestr(name, text)
    assert tables.read_sheets(data.getvalue()) == [("S", ["a", "b", "c"], [["2024-01-01", "True", "1.5"], ["2024-01-01 12:00:00", "False", "7"]])]


def test_sniffing():
    cases = {b"": None, b"\xff\xfe": None, b"a\x00": None, b"PK\x03\x04": None, b" <HTML>": "HTML", b"<!DOCTYPE html>": "HTML", b"a,b\n1,2\n": "CSV", b"a|b|c\n\n1|2|3": "CSV", b'a,"b,c"\n1,2\n': "CSV", b"a,b\n1\n": "TEXT", b"a,b": "TEXT", b"words": "TEXT"}
    assert {k: structure.sniff(k) for k in cases} == cases


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    from quillstone.functions.storage import sized_broadcast

    df = spark.range(100).select(F.col("id"), F.repeat(F.lit("x"), 1000).alias("text"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in d._jdf.queryExecution().logical().toString()
    assert hinted(sized_broadcast(df)) and not hinted(sized_broadcast(df, max_rows=99)) and not hinted(sized_broadcast(df, max_bytes=100_000))


def test_a_cluster_needs_a_shared_folder():
    import types

    import pytest

    from quillstone.functions.storage import shared_dir

    session = lambda master, named: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: named), sparkContext=types.SimpleNamespace(master=master))
    assert shared_dir(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077", None))
    assert shared_dir(session("local[2]", None)) == shared_dir(session("local[2]", None))
