"""Sources, structuring and the streams of the logs."""

from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.operators import events
from quillstone.sources import structure, tables
from quillstone.streaming import logs
from tests.test_operators import build_chain, rows


def xlsx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>time</t></si><si><t>climb</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>status</t></is></c></row><row><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_tables(spark, tmp_path):
    csv = "time,status\r\n" + "".join(f"{i},s{i}\r\n" for i in range(120))
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + csv.encode())
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.xlsx").write_bytes(b"PK\x03\x04 no archive")
    with pytest.raises(ValueError):
        tables.read_sheets(b"")
    found = tables.read_tables(spark.read.format("binaryFile").load(str(tmp_path))).cache()
    assert found.where("error is not null").count() == 1
    book = found.where("path like '%b.xlsx'").first()
    assert (book.sheet, book.columns, book.row) == ("S", ["time", "status"], ["", "climb"])
    units = tables.row_group_units(found.where("path like '%a.csv'"))
    assert rows(units, "ordinal", "row", "row_end") == [(0, 2, 51), (1, 52, 101), (2, 102, 121)]
    import hashlib

    first = units.where("ordinal = 0").first()
    payload = {"columns": ["time", "status"], "rows": [[str(i), f"s{i}"] for i in range(50)], "sheet": ""}
    assert first.content_checksum == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = tables.resolve_rows(found.where("path like '%a.csv'"), "", ["time", "status"], 2, 3).first()
    assert got.error is None and got.csv == "time,status\r\n0,s0\r\n1,s1\r\n"
    assert tables.resolve_rows(found.where("path like '%a.csv'"), "", ["nope"], 2).first().error == "table locator column does not exist"
    assert tables.resolve_rows(found.where("path like '%a.csv'"), "", ["time"], 122).first().error == "table locator exceeds source rows"


def test_a_large_sheet_is_read_in_bounded_memory():
    n = 150_000
    sheet = io.BytesIO()
    name = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(sheet, "w", zipfile.ZIP_DEFLATED) as z, zipfile.ZipFile(io.BytesIO(xlsx())) as old:
        for part in old.namelist():
            if "sheet1" not in part and "sharedStrings" not in part:
                z.writestr(part, old.read(part))
        with z.open("xl/sharedStrings.xml", "w") as f:
            f.write(f"<sst {name}>".encode())
            f.writelines(f"<si><t>s{i}</t></si>".encode() for i in range(n))
            f.write(b"</sst>")
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {name}><sheetData>".encode())
            f.writelines(f'<row><c r="A{i}" t="s"><v>{n - i}</v></c><c r="B{i}"><v>{i}</v></c></row>'.encode() for i in range(1, n + 1))
            f.write(b"</sheetData></worksheet>")
    import sys

    before, most, seen = sys.getallocatedblocks(), 0, 0
    for _, columns, lines in tables.stream_sheets(sheet.getvalue()):
        assert columns == [f"s{n - 1}", "1"]
        for i, row in enumerate(lines, 2):
            seen += 1
            if i % 10_000 == 0:
                assert row == [f"s{n - i}", str(i)]
                most = max(most, sys.getallocatedblocks() - before)
    assert seen == n - 1 and most < 400_000  # 65,536 recent texts, not millions of elements


def test_broken_tables_give_no_rows():
    with pytest.raises(ValueError):
        list(tables.stream_sheets(b"a,b\n" + b"1,2\n" * 10_000 + b"\xff"))
    assert tables.read_sheets(b"a,b\n1," + b"x" * 200_000 + b"\n")[0][2] == [["1", "x" * 200_000]]


def test_zipped_export(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d.json", json.dumps([{"n": "A1", "d": "2024-01-02T03:04:05Z", "city": "X", "st": "", "co": "US", "v": [{"make": "M"}], "t": "Final", "k": 7}, {"n": "A2"}]))
    fields = {"number": "n", "event_date": "d", "city": "city", "state": "st", "country": "co", "vehicles": "v", "status": "s", "report_type": "t", "key": "k"}
    got = tables.case_rows(tables.zipped_cases(spark.read.format("binaryFile").load(str(tmp_path))), fields).collect()
    assert len(got) == 1 and (got[0].location, got[0].make, got[0].status, got[0].has_final_report, got[0].key) == ("X, US", "M", "Unknown", True, 7)


def test_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a", b"one"), ("b", b"one"), ("c", b"two")):
        (tmp_path / "in" / name).write_bytes(data)
    files, folder = spark.read.format("binaryFile").load(str(tmp_path / "in")), str(tmp_path / "store")
    for _ in range(2):
        tables.put_blobs(files, folder)
    stored = tables._blob_files(spark, folder)
    assert stored.count() == 2
    stored.select("checksum", "path", "size", "content", "prefix").limit(1).write.mode("append").partitionBy("prefix").parquet(folder)  # as by two puts at once
    assert tables.stored_blobs(spark, folder).count() == 2
    row = tables.get_blob(spark, folder, stored.first().checksum).first()
    assert row.intact and spark.range(1).select(tables.blob_path(F.lit("../x")).alias("p")).first().p is None


def test_media_types():
    known = {b"%PDF-1.4": "PDF", b"\x89PNG\r\n\x1a\n": "PNG", b"\xff\xd8\xff\xe0": "JPEG", b" <!DOCTYPE html><p>": "HTML", b"a,b\n1,2\n3,4\n": "CSV", b"hello": "TEXT", b"\x00\x01": None, b"\xff\xfe\xfd": None, b"": None}
    assert {k: structure.sniff(k) for k in known} == known and structure.sniff(xlsx()) == "XLSX"


def test_html_blocks():
    html = "before<p>Visible evidence</p><script>if (a>b) {c} </script><style>x>y<</style> <b> </b>after"
    assert [html[a:b] for a, b in structure.blocks(html)] == ["Visible evidence"]
    assert structure.blocks("plain") == [(0, 5)] and structure.blocks("") == [(0, 0)]


def test_text_blocks_count_code_points(spark):
    df = spark.createDataFrame([(1, "<p>😀é</p>x"), (2, None), (3, "plain")], "id int, html string")
    got = rows(structure.text_blocks(df, "id", "html"), "id", "ordinal", "start", "end", "text")
    assert got == [(1, 0, 3, 5, "😀é"), (3, 0, 0, 5, "plain")]


def test_page_rules(spark):
    df = spark.createDataFrame([(500, 0.1, True), (0, 0.95, False), (20, 0.7, False), (20, 0.5, False)], "c int, v double, f boolean")
    assert [r.k for r in df.select(structure.page_kind(F.col("c"), F.col("v"), F.col("f")).alias("k")).collect()] == ["DIGITAL", "SCAN_LIKE", "SCAN_LIKE", "DIGITAL"]
    one = spark.range(1)
    assert one.select(structure.normalized_box(*(F.lit(float(x)) for x in (10, 80, 60, 20, 100, 100))).alias("b")).first().b[:] == (0.1, 0.2, 0.6, 0.8)
    kinds = one.select(*(structure.timestamp_kind(F.lit(n), F.array(*map(F.lit, v)).cast("array<string>")).alias(n) for n, v in (("recorder_seconds", []), ("local_time", ["1"]), ("t", ["2024-01-01T00:00:00Z"]), ("x", ["1"]), ("empty", [])))).first()
    assert kinds[:] == ("RELATIVE", "LOCAL", "UTC", "UNKNOWN", "UTC")
    assert one.select(structure.explicit_utc(F.lit("2024-01-01T00:00:00+00:00")).isNotNull().alias("a"), structure.explicit_utc(F.lit("2024-01-01T00:00:00+01:00")).isNull().alias("b")).first()[:] == (True, True)


def test_page_units(spark):
    t = spark.createDataFrame([("d", 1, 0, "a"), ("d", 2, 1, "b")], "document_id string, page int, reading_order int, text string")
    p = spark.createDataFrame([("d", 1, "DIGITAL"), ("d", 2, "SCAN_LIKE")], "document_id string, page int, page_kind string")
    assert rows(structure.page_units(t, p), "ordinal", "kind", "page") == [(0, "TEXT_BLOCK", 1), (1, "TEXT_BLOCK", 2), (2, "IMAGE", 2)]


def test_chain_as_a_stream(spark, tmp_path):
    chained = build_chain(spark)
    bad = chained.withColumn("payload", F.when(F.col("sequence") == 4, F.lit("{}")).otherwise(F.col("payload")))
    bad.write.parquet(str(tmp_path / "in"))
    stream = logs.stream_chain_errors(spark.readStream.schema(bad.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("chain_errors").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("chain_errors"), "sequence", "error") == [(4, "DIGEST")]
        assert events.chain_errors(bad).count() == 1
    finally:
        q.stop()


def test_blocks_resolve_to_their_text(spark):
    html = "<html><head><style>p {}</style><title>A é</title></head><body>😀 <p>one</p><script>if (a<b) x('<p>no</p>')</script><p> two\n</p> </body></html>"
    df = spark.createDataFrame([(1, html), (2, "plain"), (3, None)], "id int, html string")
    found = structure.text_blocks(df, "id", "html").join(df, "id").select("id", "ordinal", "text", structure.resolve_text(F.col("html"), F.col("start"), F.col("end")).alias("again"))
    got = rows(found)
    assert all(t == a for _, _, t, a in got) and [t for i, _, t, _ in got if i == 1] == ["A é", "😀 ", "one", " two\n"] and [t for i, _, t, _ in got if i == 2] == ["plain"]


def test_stream_of_incidents(spark, tmp_path):
    schema = "id string, audit_case_id string, case_id string, stage string, capability string, operation string, target_document_id string, network_host string, occurred_at timestamp"
    e = spark.createDataFrame([("e", "c", "c", "BLIND", "WEB_SEARCH", "NETWORK", None, "evil.example", datetime(2025, 5, 1)), ("f", "c", "c", "BLIND", "MODEL_INFERENCE", "NETWORK", None, "ok.example", datetime(2025, 5, 1))], schema)
    e.write.parquet(str(tmp_path / "in"))
    sources = spark.createDataFrame([], "document_id string, visibility string, published_at timestamp, metadata_eligible boolean")
    context = spark.createDataFrame([("c", datetime(2025, 5, 1), None)], "case_id string, evidence_cutoff timestamp, locked_at timestamp")
    stream = logs.stream_incidents(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), sources, context, ["ok.example"])
    run = stream.writeStream.format("memory").queryName("incidents").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.table("incidents"), "code") == [("FORBIDDEN_BLIND_CAPABILITY",), ("FORBIDDEN_BLIND_HOST",)]
