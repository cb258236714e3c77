"""Sources, locators, promotion, jobs and guards over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import canonical, json_fields
from quillstone.functions import vocabulary as V
from quillstone.operators import integrity, jobs, promotion, relational, retrieval, snapshot, visibility
from quillstone.plans.base import query, table
from quillstone.sources import locators, structure, tables


def _text(*parts: Column | str) -> Column:
    """Parts as text, one after another; strings are literal."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _pick(n: Column, *names: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def _pick_sql(n: str, *names: str) -> str:
    return f"([{', '.join(repr(x) for x in names)}])[1 + ({n}) % {len(names)}]"


#: Lines numbered anew, as an order may hold two of one number.
_LINES_SQL = "(SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag, l_linestatus) AS l_linenumber) FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", number)


# Sources.


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file for each order: its lines, with a quoted comment."""
    line = _lines(spark, sf_dir)
    row = _text(F.col("l_linenumber"), ",", F.col("l_partkey"), ',"', F.col("l_returnflag"), ', ""', F.col("l_linestatus"), '"""')
    rows = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    body = F.concat(F.lit("﻿line,part,note\r\n"), F.array_join("rows", "\r\n"), F.lit("\r\n"))
    return rows.select(F.col("l_orderkey").cast("string").alias("path"), body.cast("binary").alias("content"))


@query(f"SELECT l_orderkey::VARCHAR AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS row_no, l_linenumber::VARCHAR || '|' || l_partkey::VARCHAR || '|' || l_returnflag || ', \"' || l_linestatus || '\"' AS row FROM {_LINES_SQL}")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_tables(_csv_files(spark, sf_dir)).where("error is null").select("path", "row_no", F.array_join("row", "|").alias("row"))


@query(f"""WITH g AS (SELECT l_orderkey, '{{"columns":["line","part","note"],"rows":[' || string_agg('["' || l_linenumber::VARCHAR || '","' || l_partkey::VARCHAR || '","' || l_returnflag || ', \\"' || l_linestatus || '\\""]', ',' ORDER BY l_linenumber) || '],"sheet":""}}' AS t, count(*) AS n FROM {_LINES_SQL} GROUP BY 1)
      SELECT l_orderkey::VARCHAR AS path, 0::BIGINT AS ordinal, 2::BIGINT AS row, n + 1 AS row_end, sha256(t) AS content_checksum FROM g""")
def table_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = tables.row_group_units(tables.read_tables(_csv_files(spark, sf_dir)))
    return units.select("path", "ordinal", F.col("row").cast("long").alias("row"), F.col("row_end").cast("long").alias("row_end"), "content_checksum")


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM {_LINES_SQL}), c AS (SELECT l_orderkey, count(*) AS n FROM n GROUP BY 1)
      SELECT l_orderkey::VARCHAR AS path, CASE WHEN any_value(c.n) < 2 THEN 'table locator exceeds source rows' END AS error,
             CASE WHEN any_value(c.n) >= 2 THEN 'part,line' || chr(13) || chr(10) || string_agg(l_partkey::VARCHAR || ',' || l_linenumber::VARCHAR || chr(13) || chr(10), '' ORDER BY rn) FILTER (rn <= 2) END AS csv
      FROM n JOIN c USING (l_orderkey) GROUP BY l_orderkey""")
def table_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.resolve_rows(tables.read_tables(_csv_files(spark, sf_dir)), "", ["part", "line"], 2, 3)


_MANIFEST = "case_id string, expected int, items array<struct<title:string,process:boolean>>"


@query("""SELECT c_custkey::VARCHAR || CASE c_custkey % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.yaml' WHEN 2 THEN '.yml' ELSE '.txt' END AS path,
             CASE WHEN c_custkey % 4 < 3 AND c_custkey % 7 > 0 THEN c_name || ':' || (c_custkey % 9)::VARCHAR || ':' || c_mktsegment || ':' || (c_custkey % 2 = 0)::VARCHAR END AS manifest,
             CASE WHEN c_custkey % 4 = 3 THEN 'unsupported manifest suffix: txt' WHEN c_custkey % 7 = 0 THEN 'unknown fields' END AS error FROM customer""")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    extra = F.when(k % 7 == 0, F.when(k % 4 == 0, ', "other": 1').otherwise("\nother: 1")).otherwise("")
    flag = (k % 2 == 0).cast("string")
    json = _text('{"case_id": "', F.col("c_name"), '", "expected": ', k % 9, ', "items": [{"title": "', F.col("c_mktsegment"), '", "process": ', flag, "}]", extra, "}")
    yaml = _text('case_id: "', F.col("c_name"), '"\nexpected: ', k % 9, "\nitems:\n- title: ", F.col("c_mktsegment"), "\n  process: ", flag, extra, "\n")
    files = c.select(_text(k, _pick(k, ".json", ".yaml", ".yml", ".txt")).alias("path"), F.when(k % 4 == 0, json).otherwise(yaml).cast("binary").alias("content"))
    m = F.col("manifest")
    told = F.concat_ws(":", m["case_id"], m["expected"].cast("string"), m["items"][0]["title"], m["items"][0]["process"].cast("string"))
    return tables.read_manifests(files, _MANIFEST).select("path", F.when(m.isNotNull(), told).alias("manifest"), "error")


def _zips(rows: DataFrame) -> DataFrame:
    """content: a zip of each row's text as a .json member after another one."""
    import io
    import zipfile

    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("readme.txt", "x")
                    z.writestr("cases.json", text)
                out.append(data.getvalue())
            yield pa.record_batch([pa.array(out, pa.binary())], ["content"])

    return rows.select("text").mapInArrow(run, "content binary")


_CASE_FIELDS = {"number": "no", "event_date": "date", "city": "city", "state": "state", "country": "country", "vehicles": "vehicles", "status": "status", "report_type": "type", "key": "key"}


@query("""SELECT s_name AS number, TIMESTAMP '2024-01-01' + to_days((s_suppkey % 300)::INT) AS event_date,
             array_to_string(list_filter([nullif('Town ' || s_suppkey::VARCHAR, 'Town 0'), coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 'S' || s_nationkey::VARCHAR END, n_name)], lambda x: x IS NOT NULL), ', ') AS location,
             CASE WHEN s_suppkey % 5 > 0 THEN 'Make ' || s_suppkey::VARCHAR END AS make, CASE WHEN s_suppkey % 2 = 0 THEN 'Completed' ELSE 'Unknown' END AS status, s_suppkey % 4 = 0 AS has_final_report, s_suppkey AS key
      FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 > 0""")
def exported_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipped exports, one for each nation, of suppliers as cases; a tenth lack a date."""
    s, k = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_suppkey")
    day = F.date_format(F.expr("timestampadd(DAY, cast(s_suppkey % 300 as int), TIMESTAMP_NTZ '2024-01-01')"), "yyyy-MM-dd'T'HH:mm:ss")
    case = F.to_json(F.struct(
        F.col("s_name").alias("no"), F.when(k % 10 > 0, day).alias("date"), _text("Town ", k).alias("city"), F.when(k % 3 > 0, _text("S", F.col("s_nationkey"))).otherwise("").alias("state"), F.col("n_name").alias("country"),
        F.array(F.struct(F.when(k % 5 > 0, _text("Make ", k)).alias("make"))).alias("vehicles"), F.when(k % 2 == 0, "Completed").otherwise("").alias("status"), F.when(k % 4 == 0, "FINAL").otherwise("Prelim").alias("type"), k.cast("string").alias("key"),
    ))
    files = _zips(s.groupBy("n_name").agg(F.concat(F.lit("["), F.array_join(F.collect_list(case), ","), F.lit("]")).alias("text")))
    found = tables.case_rows(tables.zipped_cases(files), _CASE_FIELDS)
    return found.select("number", F.col("event_date").cast("timestamp_ntz").alias("event_date"), "location", "make", "status", "has_final_report", "key")


@query("""SELECT sha256(html) AS checksum, substr(sha256(html), 1, 2) || '/' || sha256(html) AS path, octet_length(encode(any_value(html))) AS size FROM (SELECT coalesce(html, '') AS html FROM pages) GROUP BY html""")
def content_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return tables.blobs(files).select("checksum", "path", "size")


@query("SELECT page_id FROM pages WHERE page_id % 3 = 1")
def checksum_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pages expect another checksum, a third any."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    content = F.coalesce("html", F.lit("")).cast("binary")
    expected = F.when(i % 3 == 0, F.sha2(content, 256)).when(i % 3 == 1, F.sha2(i.cast("string"), 256))
    return tables.blob_errors(p.select("page_id", content.alias("content"), expected.alias("expected_checksum"))).select("page_id")


_MAGIC_SQL = "CASE WHEN coalesce(html, '') = '' THEN NULL WHEN page_id % 8 < 5 THEN ['PDF', 'PNG', 'JPEG', NULL, 'CSV'][1 + page_id % 8] WHEN page_id % 8 = 5 THEN 'TEXT' WHEN regexp_matches(html, '^\\s*<(!doctype\\s+html|html)', 'i') THEN 'HTML' ELSE 'TEXT' END"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as content of seven sorts: magic bytes, control bytes, a table, text, HTML."""
    i, html = F.col("page_id") % 8, F.coalesce("html", F.lit(""))
    body = html.cast("binary")
    head = lambda x: F.concat(F.unhex(F.lit(x)), body)
    content = (
        F.when(html == "", body).when(i == 0, head("255044462D")).when(i == 1, head("89504E470D0A1A0A")).when(i == 2, head("FFD8FF")).when(i == 3, head("6100"))
        .when(i == 4, F.lit("a;b\n1;2\n\n3;4\n").cast("binary")).when(i == 5, F.lit("a b\n1;2\n3;4;5\n").cast("binary")).otherwise(body)
    )
    return table(spark, sf_dir, "pages").select("page_id", structure.media_type(content).alias("media_type"))


@query(f"SELECT page_id, {_MAGIC_SQL} AS media_type FROM pages")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir)


@query(f"""SELECT page_id, CASE {_MAGIC_SQL} WHEN 'PDF' THEN 'pages' WHEN 'PNG' THEN 'images' WHEN 'JPEG' THEN 'images' WHEN 'CSV' THEN 'AMBIGUOUS' WHEN 'TEXT' THEN 'texts' ELSE 'UNSUPPORTED' END AS processor FROM pages""")
def processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    supports = {"pages": ("PDF",), "images": ("PNG", "JPEG"), "tables": ("CSV", "XLSX"), "texts": ("TEXT", "CSV")}
    return _typed(spark, sf_dir).select("page_id", structure.route(F.coalesce("media_type", F.lit("")), supports).alias("processor"))


_CLEAN_SQL = "regexp_replace(regexp_replace(coalesce(html, ''), '<script\\b.*?</script>', '<x>', 'gis'), '<style\\b.*?</style>', '<x>', 'gis')"


@query(rf"""WITH t AS (SELECT page_id, CASE WHEN contains(html, '<') THEN list_filter(regexp_extract_all({_CLEAN_SQL}, '>([^<]+)<', 1), lambda x: regexp_matches(x, '\S')) ELSE [html] END AS texts FROM pages WHERE html IS NOT NULL)
      SELECT page_id, generate_subscripts(texts, 1)::BIGINT - 1 AS ordinal, unnest(texts) AS text, sha256(unnest(texts)) AS content_checksum FROM t""")
def html_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.text_blocks(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "ordinal", "text", "content_checksum")


@query("SELECT doc_id, substr(text, 11, 20) AS text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE substr(text, 11, 20) END AS resolved, CASE WHEN doc_id % 3 = 0 THEN 'text locator exceeds source length' END AS error FROM documents WHERE length(text) >= 30")
def text_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in whole documents; a third point past the end."""
    d, i = table(spark, sf_dir, "documents").where("char_length(text) >= 30"), F.col("doc_id")
    end = F.when(i % 3 == 0, F.char_length("text") + 1).otherwise(30)
    asked = d.select(i.alias("locator_id"), F.col("text").cast("binary").alias("content"), _text('{"kind": "text", "start": 10, "end": ', end, "}").alias("locator"))
    found = locators.resolve(asked).join(d, F.col("locator_id") == i)
    return found.select("doc_id", F.substring("text", 11, 20).alias("text"), F.col("content").cast("string").alias("resolved"), "error")


@query("""SELECT p_partkey AS locator_id, CASE p_partkey % 4 WHEN 0 THEN 'text/plain; charset=utf-8' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/csv; charset=utf-8' END AS media_type,
             CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, 3) WHEN 2 THEN 'b,a' || chr(13) || chr(10) || p_brand || ',' || p_size::VARCHAR || chr(13) || chr(10) END AS text, CASE WHEN p_partkey % 4 = 3 THEN 'no locator adapter supports this locator' END AS error FROM part""")
def locator_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    header = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(F.col("p_size")), 8, "0")), F.unhex(F.lit("000000100802000000")))
    content = F.when(k % 4 == 0, F.col("p_name").cast("binary")).when(k % 4 == 1, header).when(k % 4 == 2, _text("a,b\r\n", F.col("p_size"), ",", F.col("p_brand"), "\r\n").cast("binary"))
    at = F.when(k % 4 == 0, '{"kind": "text", "start": 0, "end": 3}').when(k % 4 == 1, _text('{"kind": "image", "height": 16, "width": ', F.col("p_size"), "}")).when(k % 4 == 2, '{"kind": "table", "columns": ["b", "a"], "row": 2}').otherwise('{"kind": "sound"}')
    found = locators.resolve(p.select(k.alias("locator_id"), content.alias("content"), at.alias("locator")))
    return found.select("locator_id", "media_type", F.when(F.col("media_type").startswith("text"), F.col("content").cast("string")).alias("text"), "error")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the blocks of its pages, three to a page."""
    n = F.col("l_linenumber")
    box = F.struct(F.lit(0.0).alias("x1"), (n / 10).alias("y1"), F.lit(1.0).alias("x2"), ((n + 1) / 10).alias("y2"))
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("document_id"), F.floor((n - 1) / 3).cast("int").alias("page"), n.cast("int").alias("reading_order"), _pick(n, "A", "B").alias("section"), box.alias("bounding_box"), _text("part ", F.col("l_partkey")).alias("text")
    )


@query(f"""WITH b AS (SELECT l_orderkey AS d, (l_linenumber - 1) // 3 AS page, l_linenumber AS o, ['A', 'B'][1 + l_linenumber % 2] AS s, 'part ' || l_partkey::VARCHAR AS t FROM {_LINES_SQL}),
        x AS (SELECT o_orderkey AS d, range AS k FROM orders, range(5)),
        f AS (SELECT d, k, string_agg(t, chr(10) ORDER BY o) AS text FROM x JOIN b USING (d) WHERE page = 0 AND CASE k WHEN 0 THEN true WHEN 1 THEN o = 2 WHEN 2 THEN o = 3 WHEN 3 THEN s = 'A' ELSE o = 1 END GROUP BY 1, 2)
      SELECT d * 5 + k AS locator_id, text, CASE WHEN text IS NULL THEN 'PDF locator does not resolve to extracted text' END AS error FROM x LEFT JOIN f USING (d, k)""")
def page_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five locators for each order's first page: all of it, a reading order, a
    paragraph, a section, and a box."""
    at = ('{"page": 0}', '{"page": 0, "reading_order": 2}', '{"page": 0, "paragraph": 3}', '{"page": 0, "section": "A"}', '{"page": 0, "bounding_box": {"x1": 0.0, "y1": 0.1, "x2": 1.0, "y2": 0.2}}')
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.posexplode(F.array(*map(F.lit, at))).alias("k", "locator"))
    return locators.resolve_pages(_blocks(spark, sf_dir), o.withColumn("locator_id", F.col("document_id") * 5 + F.col("k")))


@query(f"""WITH b AS (SELECT l_orderkey AS document_id, 0 AS g, (l_linenumber - 1) // 3 AS page, l_linenumber AS o, 'TEXT_BLOCK' AS kind, sha256('part ' || l_partkey::VARCHAR) AS checksum FROM {_LINES_SQL}
        UNION ALL SELECT o_orderkey, 1, 9, 9, 'IMAGE', sha256('scan:9') FROM orders WHERE o_orderkey % 2 = 0)
      SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY g, o, page) - 1 AS ordinal, kind, page::INT AS page, checksum FROM b""")
def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(9).alias("page"), F.when(F.col("o_orderkey") % 2 == 0, "SCAN_LIKE").otherwise("DIGITAL").alias("page_kind"))
    return structure.page_units(_blocks(spark, sf_dir), pages)


@query("""SELECT l_orderkey, l_linenumber, round(l_linenumber / 10.0, 6)::DOUBLE AS y1, round((l_linenumber + 1 + l_quantity / 100) / 10.0, 6)::DOUBLE AS y2 FROM lineitem WHERE (l_linenumber + 1 + l_quantity / 100) / 10.0 <= 0.7""")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of lines on a page of height 10; those beyond 7 are pushed outside."""
    n, top = F.col("l_linenumber").cast("double"), F.col("l_linenumber") + 1 + F.col("l_quantity").cast("double") / 100
    box = structure.normalized_box(F.lit(0.0), F.when(top <= 7.0, top).otherwise(11.0), F.lit(5.0), n, F.lit(5.0), F.lit(10.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).where("b is not null").select("l_orderkey", "l_linenumber", F.round("b.y1", 6).alias("y1"), F.round("b.y2", 6).alias("y2"))


@query("""SELECT o_orderkey AS document_id, round(least(coalesce(sum(l_quantity::DOUBLE * 2) / 400, 0), 1), 6) AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pics = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("page"), F.lit(0.0).alias("l"), F.col("l_quantity").cast("double").alias("r"), F.lit(3.0).alias("t"), F.lit(1.0).alias("b"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("page"), F.lit(20.0).alias("width"), F.lit(20.0).alias("height"))
    return structure.picture_coverage(pics, pages).select("document_id", F.round("coverage", 6).alias("coverage"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' END AS format, CASE WHEN p_partkey % 3 < 2 THEN p_size END::BIGINT AS width, CASE WHEN p_partkey % 3 < 2 THEN 16 END::BIGINT AS height FROM part")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, wide = F.col("p_partkey") % 3, F.col("p_size")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(wide), 8, "0")), F.unhex(F.lit("000000100802000000")))
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE000046162FFC0000B080010")), F.unhex(F.lpad(F.hex(wide), 4, "0")), F.unhex(F.lit("01011100")))
    head = structure.image_header(F.when(k == 0, png).when(k == 1, jpeg).otherwise(F.unhex(F.lit("00FF"))))
    return table(spark, sf_dir, "part").select("p_partkey", head.alias("h")).select("p_partkey", "h.format", F.col("h.width").cast("long").alias("width"), F.col("h.height").cast("long").alias("height"))


@query("""SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'RELATIVE' WHEN 1 THEN 'UTC' WHEN 2 THEN 'LOCAL' WHEN 3 THEN CASE WHEN bool_and(event_id % 2 = 0) THEN 'UTC' ELSE 'UNKNOWN' END ELSE 'UTC' END AS kind FROM events GROUP BY user_id""")
def timestamp_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    stamp = F.when(F.col("user_id") % 5 == 4, "2024-01-01T00:00:00+00:00").when((F.col("user_id") % 5 < 3) | (i % 2 == 1), "12:00").otherwise("2024-01-01T00:00:00Z")
    name = _pick(F.col("user_id"), "Elapsed s", "Time UTC", "local time", "t", "t")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(stamp).alias("values")).select("user_id", structure.timestamp_kind(name, F.col("values")).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN ts END AS at FROM events""")
def utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text with Z, a zero offset, another offset, and none."""
    i, stamp = F.col("event_id") % 4, F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.concat(stamp, F.when(i == 0, "Z").when(i == 1, "+00:00").when(i == 2, "+02:00").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", structure.explicit_utc(text).cast("timestamp_ntz").alias("at"))


# Rights, visibility and guards.

_RIGHTS = ("PUBLIC_DOMAIN", *V.UNCLEAR_RIGHTS)


@query(f"""WITH r AS (SELECT doc_id, {_pick_sql('doc_id', *_RIGHTS)} AS rights, CASE doc_id % 3 WHEN 0 THEN 'AI_ALLOWED' WHEN 1 THEN 'LINK_ONLY' END AS d FROM documents),
        x AS (SELECT *, rights <> 'PUBLIC_DOMAIN' AS unclear FROM r)
      SELECT doc_id, coalesce(d, CASE WHEN unclear THEN 'LINK_ONLY' ELSE 'AI_ALLOWED' END) AS disposition, unclear AND coalesce(d, CASE WHEN unclear THEN 'LINK_ONLY' ELSE 'AI_ALLOWED' END) = 'AI_ALLOWED' AS violation FROM x""")
def rights_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rights, given = _pick(i, *_RIGHTS), F.when(i % 3 == 0, "AI_ALLOWED").when(i % 3 == 1, "LINK_ONLY")
    found = visibility.default_disposition(rights, given)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("disposition"), visibility.rights_violation(rights, found).alias("violation"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.7 THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS review FROM lineitem")
def review_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", visibility.review_status(F.col("l_discount") * 10).alias("review"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'CASE_NOT_OPEN' WHEN o_orderkey % 11 = 0 THEN 'CUTOFF_MISSING' WHEN o_orderkey % 7 = 0 THEN 'DISPOSITION' WHEN o_orderkey % 5 = 0 THEN 'CHECKSUM_MISSING'
        WHEN o_orderkey % 3 = 0 THEN 'CHECKSUM_MISMATCH' WHEN o_orderkey % 2 = 0 THEN 'NOT_ELIGIBLE' END AS reason FROM orders""")
def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "LOCKED").when(F.col("o_orderstatus") == "O", "ACQUIRING").otherwise("BLIND")
    checksum = F.when(k % 5 != 0, "c")
    reason = visibility.link_decision(state, F.when(k % 11 != 0, F.col("o_orderdate")), F.when(k % 7 == 0, "LINK_ONLY").otherwise("AI_ALLOWED"), checksum, F.when(k % 3 == 0, "other").when(k % 4 == 0, "c"), F.when(k % 2 == 1, True))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("""SELECT operation, allowed, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'READ' ELSE 'DENY' END AS operation, doc_id % 3 = 0 AS allowed FROM documents) GROUP BY ALL
      UNION ALL SELECT 'ROWS', true, count(*) FROM documents WHERE doc_id % 3 = 0""")
def blind_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    rows, audit = visibility.read_with_audit(d, d.where("doc_id % 3 = 0"), "doc_id", F.lit(1), F.lit("2025-01-01").cast("timestamp"))
    return audit.groupBy("operation", "allowed").agg(F.count("*").alias("n")).unionByName(rows.groupBy(F.lit("ROWS").alias("operation"), F.lit(True).alias("allowed")).agg(F.count("*").alias("n")))


_STATES = ("ACQUIRING", "BLIND", "LOCKED", "REVEALED")


@query(f"""WITH c AS (SELECT c_custkey AS id, {_pick_sql('c_custkey', *_STATES)} AS state FROM customer), r AS (SELECT o_orderkey, state, o_custkey % 3 = 0 AS locked FROM orders JOIN c ON id = o_custkey)
      SELECT 'blind read' AS view, count(*) AS n FROM r WHERE state IN ('BLIND', 'LOCKED') UNION ALL SELECT 'blind write', count(*) FROM r WHERE state = 'BLIND'
      UNION ALL SELECT 'evaluation read', count(*) FROM r WHERE state IN ('LOCKED', 'REVEALED') AND locked""")
def secured_case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cases = table(spark, sf_dir, "customer").select(k.alias("id"), _pick(k, *_STATES).alias("state"))
    locks, rows = cases.where("id % 3 = 0").select(F.col("id").alias("case_id")), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"))
    out = None
    for role, write, view in (("blind", False, "blind read"), ("blind", True, "blind write"), ("evaluation", False, "evaluation read"), ("evaluation", True, "none"), ("processor", False, "none")):
        one = visibility.secured_case_rows(role, rows, cases, locks, write).select(F.lit(view).alias("view"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("view").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT c_custkey, {_pick_sql('c_custkey', *_STATES)} AS state FROM customer)
      SELECT o_orderkey AS id FROM orders JOIN c ON c_custkey = o_custkey WHERE state IN ('BLIND', 'LOCKED') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 = 0)""")
def secured_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates whose evidence are their parts; a tenth of these is hidden."""
    k = F.col("c_custkey")
    cases = table(spark, sf_dir, "customer").select(k.alias("id"), _pick(k, *_STATES).alias("state"))
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("evidence_ids"))
    o = table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("case_id"), F.coalesce("evidence_ids", F.array().cast("array<bigint>")).alias("evidence_ids"))
    evidence = table(spark, sf_dir, "part").where("p_partkey % 10 != 0").select(F.col("p_partkey").alias("id"))
    return visibility.secured_candidates("blind", rows, evidence, cases, cases.select(F.col("id").alias("case_id"))).select("id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 3 > 0 AND NOT (l_partkey % 5 = 0 AND l_partkey % 2 = 0) AND NOT (l_partkey % 7 = 0 AND l_suppkey % 2 = 0)""")
def critique_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as critiques that name a part; a part is pinned for its even number,
    claimed for its supplier's."""
    p = F.col("l_partkey")
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = line.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("investigation_id"), F.col("o_custkey").alias("case_id"), F.when(p % 3 > 0, p).alias("strongest_contradiction_id"))
    some = rows.select("investigation_id", "case_id", F.col("strongest_contradiction_id").alias("id")).where("id is not null")
    found = integrity.critique_references(rows, some.where("id % 5 = 0 and id % 2 = 0"), some.where("id % 7 = 0 and investigation_id % 2 = 0"))
    return found.select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'DELETED' ELSE 'CHANGED' END AS problem FROM orders WHERE o_orderkey % 9 = 0 OR (o_orderkey % 4 = 0 AND o_orderstatus <> 'O')""")
def immutable_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = o.where("o_orderkey % 9 != 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return integrity.changed_history(o, after, ["o_orderkey"], F.col("old.o_orderstatus") == "O")


@query("""SELECT page_id AS id, 'title' AS field FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'published_at' FROM pages WHERE page_id % 5 = 0""")
def reclassified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    before = table(spark, sf_dir, "pages").select(i.alias("id"), *(F.lit("x").alias(c) for c in V.DOCKET_CLASSIFICATION))
    after = before.withColumns({"title": F.when(F.col("id") % 3 == 0, "y").otherwise("x"), "published_at": F.when(F.col("id") % 5 != 0, "x")})
    return integrity.reclassified(before, after)


@query("""SELECT n_name AS name, 'table' AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'MISSING' WHEN n_nationkey % 4 = 1 THEN 'UNEXPECTED' WHEN n_nationkey % 4 = 2 THEN 'FLAG' END AS problem FROM nation WHERE n_nationkey % 4 < 3""")
def catalog_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 4
    rows = n.select(F.lit("table").alias("kind"), F.col("n_name").alias("name"), F.lit(True).alias("flag"), k.alias("k"))
    return integrity.catalog_differences(rows.where("k != 0").drop("k"), rows.where("k != 1").withColumn("flag", F.col("k") != 2).drop("k"))


# Blocks of filters, projections and hashes.


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 2 = 0 OR (l_partkey % 4 = 1 AND l_returnflag IN ('A', 'R')) OR (l_partkey % 4 = 3 AND l_shipdate >= TIMESTAMP '1995-01-01' AND (l_linenumber % 2 = 0 OR l_shipdate <= TIMESTAMP '1997-01-01'))""")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, day = F.col("l_partkey") % 4, lambda t: F.expr(f"TIMESTAMP_NTZ '{t}'")
    flags = F.when(p == 1, F.array(F.lit("A"), F.lit("R"))).otherwise(F.array().cast("array<string>"))
    start, end = F.when(p == 3, day("1995-01-01")), F.when((p == 3) & (F.col("l_linenumber") % 2 == 1), day("1997-01-01"))
    return table(spark, sf_dir, "lineitem").where(relational.member_or_no_filter(flags, F.col("l_returnflag")) & relational.within_optional(F.col("l_shipdate"), start, end)).select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey AS id, '{"hypothesis_id":' || c_nationkey::VARCHAR || ',"text":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS record FROM customer""")
def prompt_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("hypothesis_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("text"), "c_acctbal")
    return snapshot.prompt_fields("question", c)


@query("""WITH v AS (SELECT o_custkey, list(o_orderstatus || repeat(' ', 1 + o_orderkey % 3) || o_orderpriority ORDER BY o_orderkey) AS v FROM orders GROUP BY 1),
        k AS (SELECT *, list_transform(v, lambda x: {'k': lower(regexp_replace(x, '\\s+', ' ', 'g')), 'v': x}) AS kv FROM v)
      SELECT o_custkey, CASE WHEN len(list_distinct(list_transform(kv, lambda x: x.k))) < len(kv) THEN 'DUPLICATE' END AS error,
             CASE WHEN len(list_distinct(list_transform(kv, lambda x: x.k))) = len(kv) THEN array_to_string(list_transform(list_sort(kv), lambda x: x.v), '|') END AS texts FROM k""")
def set_like_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    spaced = F.concat("o_orderstatus", F.repeat(F.lit(" "), (1 + k % 3).cast("int")), "o_orderpriority")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(k, spaced.alias("v")))), lambda x: x["v"]).alias("v"))
    return rows.select("o_custkey", snapshot.ordered_text(F.col("v")).alias("r")).select("o_custkey", "r.error", F.array_join("r.values", "|").alias("texts"))


@query("""SELECT p_partkey, '{"id": "' || p_partkey::VARCHAR || '", "names": ["' || least('Zeta  ' || p_brand, 'alpha') || '", "' || CASE WHEN lower('alpha') < lower('Zeta ' || p_brand) THEN 'Zeta  ' || p_brand ELSE 'alpha' END || '"], "confidence": "' ||
             CASE p_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.5' ELSE '0.1234' END || '", "occurred_at": "2024-01-01T00:00:00Z"}' AS record FROM part""".replace("least('Zeta  ' || p_brand, 'alpha')", "'alpha'").replace("CASE WHEN lower('alpha') < lower('Zeta ' || p_brand) THEN 'Zeta  ' || p_brand ELSE 'alpha' END", "'Zeta  ' || p_brand"))
def projection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    value = _pick(k, "0.0000", "0.5000", "0.1234")
    raw = _text('{"created_at": "2024-01-01T00:00:00Z", "confidence": "', value, '", "names": ["Zeta  ', F.col("p_brand"), '", "alpha"], "occurred_at": "2024-01-01T00:00:00+00:00", "id": "', k, '"}')
    return table(spark, sf_dir, "part").select("p_partkey", snapshot.projection_text(raw).alias("record"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, string_agg('"' || o_orderkey::VARCHAR || '"', ', ' ORDER BY o_orderkey::VARCHAR) AS ids FROM orders GROUP BY 1)
      SELECT o_custkey, sha256('{"algorithm": "postgres-investigation-config-v1", "configuration": {"n": ' || n::VARCHAR || '}, "evidence_set_hash": "h' || o_custkey::VARCHAR || '"}') AS config_hash,
             sha256('{"stage": "PROMOTE_CLAIMS", "work_key": "' || o_custkey::VARCHAR || '", "evidence_ids": [' || ids || ']}') AS input_hash, sha256('{"a":"\\u00e9","n":' || n::VARCHAR || '}') AS run_hash FROM g""")
def configuration_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    own = F.col("o_custkey").cast("string")
    return g.select(
        "o_custkey", snapshot.config_hash(canonical.object_text({"n": canonical.number_text(F.col("n"))}), F.concat(F.lit("h"), own)).alias("config_hash"),
        snapshot.job_input_hash({"stage": F.lit("PROMOTE_CLAIMS"), "work_key": own}, {"evidence_ids": F.col("ids")}).alias("input_hash"), snapshot.run_hash(_text('{"n": ', F.col("n"), ', "a": "é"}')).alias("run_hash"),
    )


# Retrieval.

_SCORES_SQL = """
    SELECT l_suppkey AS query_id, l_orderkey * 100 + l_linenumber AS id, (l_linenumber / 7.0::DECIMAL(10,1))::DECIMAL(20,10) AS fts, CASE WHEN l_partkey % 3 > 0 THEN (l_partkey % 3 / 4.0)::DECIMAL(20,10) END AS entity, l_partkey % 2 = 0 AS time_hit,
           l_returnflag AS et, l_suppkey % 2 = 0 AS by_type, l_suppkey % 3 = 0 AS by_entity, l_suppkey % 5 = 0 AS by_time FROM lineitem"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as matches of their supplier's query, which filters by type, entity and
    time if its key is even, divisible by three, and by five."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    score = lambda x: x.cast("decimal(20,10)").cast("decimal(38,20)")
    some, none = F.array(F.lit("A"), F.lit("R")), F.array().cast("array<string>")
    day = F.lit("2024-01-01").cast("timestamp")
    return table(spark, sf_dir, "lineitem").select(
        s.alias("query_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), score(F.col("l_linenumber").cast("decimal(10,0)") / F.lit("7.0").cast("decimal(10,1)")).alias("fts_score"),
        F.when(p % 3 > 0, score((p % 3).cast("decimal(10,0)") / 4)).alias("entity_score"), (p % 2 == 0).alias("time_hit"), F.col("l_returnflag").alias("evidence_type"), F.lit("TEXT").alias("document_type"),
        F.when(s % 2 == 0, some).otherwise(none).alias("evidence_types"), none.alias("document_types"), F.when(s % 3 == 0, F.array(F.lit("e"))).otherwise(none).alias("entity_ids"), F.when(s % 5 == 0, day).alias("start_at"), F.lit(None).cast("timestamp").alias("end_at"), F.lit(20).alias("limit"),
    )


_SCORED_SQL = f"""
    SELECT query_id, id, fts, coalesce(entity, 0) AS entity, time_hit::INT AS time, by_type::INT AS type, round(0.55 * fts + 0.20 * coalesce(entity, 0) + 0.15 * time_hit::INT + 0.10 * by_type::INT, 4)::DECIMAL(5,4) AS total,
           array_to_string(list_filter([CASE WHEN by_type THEN 'evidence_type' END, CASE WHEN by_entity THEN 'entity' END, CASE WHEN by_time THEN 'time' END], lambda x: x IS NOT NULL), ',') AS filters
    FROM ({_SCORES_SQL}) WHERE (NOT by_type OR et IN ('A', 'R')) AND (NOT by_entity OR entity > 0) AND (NOT by_time OR time_hit)"""


@query(f"SELECT query_id, id, total::VARCHAR AS total, type::BIGINT AS type, filters FROM ({_SCORED_SQL})")
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.scored(_components(spark, sf_dir))
    return found.select("query_id", "id", F.col("total_score").cast("string").alias("total"), F.col("type_score").cast("long").alias("type"), F.array_join("matched_filters", ",").alias("filters"))


@query(f"SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, fts DESC, entity DESC, time DESC, type DESC, id) AS rank FROM ({_SCORED_SQL})) WHERE rank <= 20")
def search_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ranked(retrieval.scored(_components(spark, sf_dir)), "id").select("query_id", "id", "rank")


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS inv, o_custkey % 50 AS c, l_orderkey * 100 + l_linenumber AS id, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 4 END AS run, l_partkey FROM {_LINES_SQL} JOIN orders ON l_orderkey = o_orderkey)
      SELECT inv AS investigation_id, id FROM m WHERE l_partkey % 5 > 0 AND l_orderkey % 4 > 0 AND l_linenumber <> 3 AND ((run IS NOT NULL AND l_partkey % 2 = 0) OR (run IS NULL AND l_linenumber % 2 = 0))""")
def searchable_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evidence: pinned with their run, or without one; a fifth is pinned with
    another run, a quarter of sources closed, a line in seven unreviewed."""
    p, n, o = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey")
    line = _lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), o == F.col("o_orderkey"))
    run = F.when(p % 3 > 0, p % 4)
    rows = line.select((o * 100 + n).alias("id"), (F.col("o_custkey") % 50).alias("case_id"), run.alias("model_run_id"), (F.col("l_suppkey") % 7).alias("investigation_id"), o.alias("source_document_id"), (o * 100 + n).alias("structural_unit_id"),
                       F.when(n == 3, "PENDING").otherwise("ACCEPTED").alias("review_status"), F.when(n % 2 == 0, "HUMAN").otherwise("MODEL").alias("extraction_method"), F.lit("TEXT").alias("type"), F.lit("x").alias("observation"), p.alias("part"))
    member = rows.select("investigation_id", "case_id", F.col("id").alias("evidence_id"), F.when(F.col("part") % 5 > 0, F.col("model_run_id")).otherwise(9).alias("model_run_id"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("case_id"), F.when(F.col("o_orderkey") % 4 > 0, "INVESTIGATION_EVIDENCE").otherwise("FINAL_FINDING").alias("visibility"), F.lit("REPORT").alias("document_type"))
    done = rows.where("part % 2 = 0 and model_run_id is not null").select("structural_unit_id", "model_run_id")
    return retrieval.searchable("blind", member, rows, sources, done).select("investigation_id", "id")


@query("""SELECT event_id AS query_id, unnest(list_filter([CASE WHEN event_id % 7 = 0 THEN 'BLANK_TEXT' END, CASE WHEN event_id % 5 = 0 THEN 'INTERVAL' END, CASE WHEN event_id % 60 NOT BETWEEN 1 AND 50 THEN 'LIMIT' END, CASE WHEN event_id % 4 = 3 THEN 'INTENT' END], lambda x: x IS NOT NULL)) AS error FROM events""")
def search_query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, at = F.col("event_id"), F.col("ts").cast("timestamp")
    q = table(spark, sf_dir, "events").select(i.alias("query_id"), _pick(i, "SUPPORT", "CONTRADICT", "NEUTRAL", "OTHER").alias("intent"), F.when(i % 7 == 0, "  \t").otherwise("valve").alias("query_text"), at.alias("start_at"),
                                                (at + F.when(i % 5 == 0, F.expr("interval -1 second")).otherwise(F.expr("interval 1 second"))).alias("end_at"), (i % 60).cast("int").alias("limit"), F.lit("fts-v1").alias("config_version"))
    return retrieval.query_errors(q)


# Promotion and materialisation.


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as claim candidates; a draft for each order uses all of its lines."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return _lines(spark, sf_dir).select((F.col("l_orderkey") * 100 + n).alias("candidate_id"), F.col("l_orderkey").alias("draft_id"), F.lit("OBSERVED").alias("status"), F.when(F.col("l_orderkey") % 3 == 0, _text("Valve  ", n % 2)).otherwise("valve").alias("text"),
                                                 F.array(p).alias("supporting_evidence_ids"), F.array(F.col("l_suppkey")).alias("contradicting_evidence_ids"), F.col("l_partkey"), F.col("l_suppkey"), n)


@query(f"""WITH g AS (SELECT l_orderkey AS d, l_orderkey % 3 = 0 AND (sum((l_linenumber % 2 = 1)::INT) > 0) AS text, l_orderkey % 4 = 0 AS status, l_orderkey % 5 = 0 AS dropped, bool_or(l_partkey % 50 = 0) AS inactive FROM {_LINES_SQL} GROUP BY 1)
      SELECT d AS draft_id, 'CHANGED_TEXT' AS error FROM g WHERE text UNION ALL SELECT d, 'CHANGED_STATUS' FROM g WHERE status UNION ALL SELECT d, 'CHANGED_SUPPORTING_EVIDENCE_IDS' FROM g WHERE dropped UNION ALL SELECT d, 'INACTIVE_EVIDENCE' FROM g WHERE inactive""")
def claim_promotion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts say the even lines' text; some change the status, or drop evidence; parts
    divisible by fifty are not active."""
    c, d = _candidates(spark, sf_dir), F.col("draft_id")
    drafts = c.groupBy("draft_id").agg(F.collect_list("candidate_id").alias("source_candidate_ids"), F.collect_set("l_partkey").alias("s"), F.collect_set("l_suppkey").alias("contradicting_evidence_ids"))
    drafts = drafts.select(d, "source_candidate_ids", F.when(d % 4 == 0, "INFERRED").otherwise("OBSERVED").alias("status"), F.when(d % 3 == 0, " valve 0 ").otherwise("VALVE").alias("text"), F.when(d % 5 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.col("s")).alias("supporting_evidence_ids"), "contradicting_evidence_ids")
    # Suppliers share numbers with parts, so as evidence theirs are negative.
    known = c.where("l_partkey % 50 != 0").select(F.col("l_partkey").alias("evidence_id")).unionByName(c.select((-1 - F.col("l_suppkey")).alias("evidence_id")))
    c = c.withColumn("contradicting_evidence_ids", F.array(-1 - F.col("l_suppkey")))
    drafts = drafts.withColumn("contradicting_evidence_ids", F.transform("contradicting_evidence_ids", lambda x: -1 - x))
    return promotion.claim_errors(c.drop("draft_id"), drafts, known)


@query(f"""SELECT l_orderkey * 100 + l_linenumber AS candidate_id, 0::BIGINT AS uses, 'UNUSED_CANDIDATE' AS error FROM {_LINES_SQL} WHERE l_linenumber = 2 UNION ALL SELECT l_orderkey * 100 + l_linenumber, 2, 'CANDIDATE_REUSED' FROM {_LINES_SQL} WHERE l_linenumber = 3
      UNION ALL SELECT o_orderkey * 100 + 99, 1, 'UNKNOWN_CANDIDATE' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM {_LINES_SQL} WHERE l_linenumber <> 2)""")
def candidate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    used = c.where("l_linenumber != 2").groupBy("draft_id").agg(F.flatten(F.collect_list(F.when(F.col("l_linenumber") == 3, F.array("candidate_id", "candidate_id")).otherwise(F.array("candidate_id")))).alias("ids"))
    return promotion.coverage_errors(c, used.select("draft_id", F.concat("ids", F.array(F.col("draft_id") * 100 + 99)).alias("source_candidate_ids")))


@query("""SELECT l_orderkey AS draft_id, 'CHANGED_OCCURRED_AT' AS error FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate) > 1 UNION ALL SELECT o_orderkey, 'CHANGED_EVIDENCE_IDS' FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def timeline_promotion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, d = _lines(spark, sf_dir), F.col("draft_id")
    c = line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("candidate_id"), F.col("l_orderkey").alias("draft_id"), F.col("l_shipdate").alias("occurred_at"), F.lit("EXACT").alias("time_precision"), F.lit("Fuel low").alias("description"), F.array("l_partkey").alias("evidence_ids"))
    drafts = c.groupBy("draft_id").agg(F.min("occurred_at").alias("occurred_at"), F.collect_list("candidate_id").alias("source_candidate_ids"), F.flatten(F.collect_list("evidence_ids")).alias("e"))
    drafts = drafts.select(d, "occurred_at", F.lit("EXACT").alias("time_precision"), F.lit(" FUEL  low").alias("description"), "source_candidate_ids", F.when(d % 6 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.col("e")).alias("evidence_ids"))
    return promotion.timeline_errors(c.drop("draft_id"), drafts, line.select(F.col("l_partkey").alias("evidence_id")).distinct())


@query(f"""WITH g AS (SELECT l_orderkey AS d, count(DISTINCT l_linenumber % 2) AS kinds FROM {_LINES_SQL} GROUP BY 1)
      SELECT d::VARCHAR AS draft_id, 'DISTINCT_IDENTITIES' AS error FROM g WHERE kinds > 1 AND d % 2 = 0 UNION ALL SELECT d::VARCHAR, 'CHANGED_TYPE' FROM g WHERE d % 3 = 0 UNION ALL SELECT d::VARCHAR, 'CANONICAL_NOT_SUPPLIED' FROM g WHERE d % 5 = 0
      UNION ALL SELECT d::VARCHAR, 'ALIASES_CHANGED' FROM g WHERE d % 5 = 0""")
def entity_resolution_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as names of their order's entity: odd ones share a name, even ones another,
    and in odd orders a common one joins both."""
    n, d = F.col("l_linenumber"), F.col("l_orderkey")
    name = _text("N", n % 2)
    c = _lines(spark, sf_dir).select((d * 100 + n).alias("candidate_id"), d.alias("draft_id"), F.lit("PART").alias("type"), F.when(d % 2 == 1, F.array(name, F.lit("Common"))).otherwise(F.array(name)).alias("names"))
    g = c.groupBy("draft_id").agg(F.collect_list("candidate_id").alias("source_candidate_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("all"))
    k = F.col("draft_id")
    drafts = g.select(k, "source_candidate_ids", F.when(k % 3 == 0, "PLANE").otherwise("PART").alias("type"), F.when(k % 5 == 0, "Other").otherwise(F.concat(F.lit(" "), F.lower(F.get("all", F.lit(0))))).alias("canonical_name"), F.slice("all", 2, 9).alias("aliases"))
    return promotion.entity_errors(c.drop("draft_id"), drafts)


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hypothesis drafts of their customer's investigation."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("investigation_id"), F.lit("case").alias("case_id"), F.lit("m").alias("model_run_id"), k.alias("draft_no"), _text("T", k).alias("title"), F.lit("d").alias("description"), (0.05 + (k % 80).cast("double") / 100 + 0.00005).alias("confidence"),
        F.array(k * 2, k * 2 + 2).alias("supporting_claim_ids"), F.array(k * 2 + 1).alias("contradicting_claim_ids"), F.array(F.lit("why  B"), F.lit("Why a")).alias("unresolved_questions"), k,
    )


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of all drafts but for every ninth one's contradiction."""
    d = _drafts(spark, sf_dir)
    ids = F.when(F.col("draft_no") % 9 == 0, F.col("supporting_claim_ids")).otherwise(F.concat("supporting_claim_ids", "contradicting_claim_ids"))
    return d.select("investigation_id", "case_id", F.explode(ids).alias("claim_id"))


_NEW_ID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_HYPOTHESES_SQL = f"""SELECT {_NEW_ID_SQL} AS hypothesis_id, * FROM (SELECT *, sha256(o_custkey::VARCHAR || chr(31) || 'hypothesis' || chr(31) || o_orderkey::VARCHAR) AS h FROM orders WHERE o_orderkey % 9 > 0)"""


@query(f"SELECT hypothesis_id, o_custkey AS investigation_id, 'T' || o_orderkey::VARCHAR AS title, round_even((0.05 + (o_orderkey % 80)::DOUBLE / 100 + 0.00005)::VARCHAR::DECIMAL(38,18), 4)::DECIMAL(5,4)::VARCHAR AS confidence, 'ACTIVE' AS status FROM ({_HYPOTHESES_SQL})")
def materialized_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = promotion.materialize_hypotheses(_drafts(spark, sf_dir), _claims(spark, sf_dir))
    return rows.select("hypothesis_id", "investigation_id", "title", F.col("current_confidence").cast("string").alias("confidence"), "status")


@query(f"""SELECT hypothesis_id, o_orderkey * 2 + n AS claim_id, CASE WHEN n = 1 THEN 'CONTRADICTING' ELSE 'SUPPORTING' END AS polarity, n + 1 AS link_no FROM ({_HYPOTHESES_SQL}), (SELECT range AS n FROM range(3))""")
def materialized_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, _ = promotion.materialize_hypotheses(_drafts(spark, sf_dir), _claims(spark, sf_dir))
    return links.select("hypothesis_id", "claim_id", "polarity", F.col("link_no").cast("long").alias("link_no"))


@query(f"""SELECT hypothesis_id, ['Why a', 'why  B'][n] AS text, n AS question_no FROM ({_HYPOTHESES_SQL}), (SELECT range AS n FROM range(1, 3))""")
def materialized_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, questions = promotion.materialize_hypotheses(_drafts(spark, sf_dir), _claims(spark, sf_dir))
    return questions.select("hypothesis_id", "text", F.col("question_no").cast("long").alias("question_no"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderkey % 9 = 0) AS lost, bool_or(true) AS fine FROM orders GROUP BY 1)
      SELECT o_custkey AS investigation_id, 'DRAFT_COUNT' AS error FROM g WHERE n < 3 OR n > 5 UNION ALL SELECT o_custkey, 'UNKNOWN_CLAIM' FROM g WHERE lost UNION ALL SELECT o_custkey, 'CONFIDENCE' FROM g WHERE fine""")
def hypothesis_draft_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion.draft_errors(_drafts(spark, sf_dir), _claims(spark, sf_dir).withColumn("claim_id", F.col("claim_id")))


_TEST = "struct<type:string,strength:string,execution_kind:string,parameters:string,evidence_ids:array<bigint>,claim_ids:array<bigint>>"


def _critiques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A critique of every order, with a test for each of its lines."""
    line = F.col("l_linenumber")
    test = F.struct(F.lit("EVIDENCE_PRESENCE").alias("type"), _pick(line, *V.STRENGTHS).alias("strength"), F.lit("DETERMINISTIC").alias("execution_kind"), F.lit("{}").alias("parameters"), F.array("l_partkey").alias("evidence_ids"), F.array().cast("array<bigint>").alias("claim_ids")).cast(_TEST)
    tests = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(line, test.alias("t")))), lambda x: x["t"]).alias("proposed_tests"))
    o = table(spark, sf_dir, "orders").join(tests, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    return o.select(k.alias("hypothesis_id"), F.col("o_custkey").alias("investigation_id"), F.lit("case").alias("case_id"), F.lit("m").alias("model_run_id"), ((k % 100).cast("double") / 100).alias("critique_confidence"), F.lit(None).cast("long").alias("strongest_contradiction_id"), "proposed_tests")


@query(f"""WITH c AS (SELECT {_NEW_ID_SQL} AS critique_id, o_orderkey FROM (SELECT o_orderkey, sha256(o_orderkey::VARCHAR || chr(31) || 'critique') AS h FROM orders)),
        n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS no FROM {_LINES_SQL}),
        t AS (SELECT *, sha256(critique_id || chr(31) || 'test' || chr(31) || no::VARCHAR) AS h FROM n JOIN c ON o_orderkey = l_orderkey)
      SELECT {_NEW_ID_SQL} AS test_id, critique_id, l_orderkey AS hypothesis_id, no AS test_no, ['LOW', 'MEDIUM', 'HIGH'][1 + l_linenumber % 3] AS strength, l_partkey AS evidence_id, 'j' || l_orderkey::VARCHAR AS job_id, 'PENDING' AS status FROM t""")
def materialized_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = _critiques(spark, sf_dir)
    _, tests = promotion.materialize_critiques(drafts, drafts.select("hypothesis_id", _text("j", F.col("hypothesis_id")).alias("job_id")))
    return tests.select("test_id", "critique_id", "hypothesis_id", F.col("test_no").cast("long").alias("test_no"), "strength", F.get("evidence_ids", F.lit(0)).alias("evidence_id"), "job_id", "status")


@query("""SELECT l_orderkey AS critique_id, 'TEST_COUNT' AS error FROM lineitem GROUP BY 1 HAVING count(*) > 5 UNION ALL SELECT l_orderkey, 'TEST_NOT_PENDING' FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'F') UNION ALL SELECT DISTINCT l_orderkey, 'UNKNOWN_REFERENCE' FROM lineitem WHERE l_partkey % 20 = 0""")
def critique_draft_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.groupBy(F.col("l_orderkey").alias("critique_id")).agg(F.collect_set("l_partkey").alias("reference_ids"), F.collect_list(F.struct(F.when(F.col("l_linestatus") == "F", "SUCCEEDED").otherwise("PENDING").alias("status"))).alias("tests"))
    return promotion.critique_errors(rows, table(spark, sf_dir, "part").where("p_partkey % 20 != 0").select(F.col("p_partkey").alias("id")))


@query("""WITH p AS (SELECT o_custkey AS inv, ['claim', 'entity', 'timeline'][1 + o_orderkey % 3] AS kind, o_orderkey, (row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1) // 3 AS batch_no FROM orders)
      SELECT inv AS investigation_id, kind, batch_no, o_orderkey AS candidate_id, CASE WHEN o_orderkey % 10 > 0 THEN kind || ' ' || o_orderkey::VARCHAR END AS candidate, CASE WHEN o_orderkey % 10 = 0 THEN 'pinned candidate batch unavailable' END AS error FROM p""")
def candidate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pinned candidates of three kinds; a tenth was made by another run."""
    k = F.col("o_orderkey")
    pinned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("investigation_id"), F.col("o_custkey").alias("case_id"), _pick(k, "claim", "entity", "timeline").alias("kind"), k.alias("candidate_id"), F.lit("m").alias("model_run_id"))
    made = pinned.select("kind", F.col("candidate_id").alias("id"), "case_id", F.when(F.col("candidate_id") % 10 == 0, "other").otherwise("m").alias("model_run_id"), F.concat_ws(" ", "kind", F.col("candidate_id").cast("string")).alias("candidate"))
    return promotion.candidate_batch(pinned, *(made.where(F.col("kind") == kind) for kind in ("claim", "entity", "timeline")))


@query("""SELECT o_custkey, count(*) AS records, sha256(string_agg('{"o_orderkey":' || o_orderkey::VARCHAR || ',"note":null,"parts":[' || coalesce(parts, '') || '],"returned":[' || coalesce(returned, '') || ']}', ';' ORDER BY o_orderkey::VARCHAR)) AS objects
      FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS ignored, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts, array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R')), ',') AS returned FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""".replace("string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS ignored, ", ""))
def stored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of their customer with two lists of links, as one object."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(None).cast("string").alias("note"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag")
    rows = relational.with_links(o, "o_orderkey", links, {"parts": "l_partkey", "returned": F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))}).select("o_custkey", "o_orderkey", "note", "parts", "returned")
    found = relational.stored_objects(rows, "o_custkey", "o_orderkey")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("objects")), lambda x: x["value"]), ";")
    return found.select("o_custkey", F.size("objects").cast("long").alias("records"), F.sha2(text, 256).alias("objects"))


# Jobs.


@query("SELECT user_id AS job_id, count(*) AS requests, count(*) - 1 AS retries, sum((event_id % 5 = 0)::INT)::BIGINT AS schema_failures, sum((event_id % 5 = 1)::INT)::BIGINT AS succeeded FROM events GROUP BY 1")
def request_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return jobs.request_accounts(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.when(i % 5 == 0, "SCHEMA_FAILED").when(i % 5 == 1, "SUCCEEDED").otherwise("FAILED").alias("status")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate + INTERVAL 30 MINUTE <= TIMESTAMP '1996-01-01'")
def expired_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("DONE").alias("status"), F.col("o_orderdate").cast("timestamp").alias("leased_at"))
    return jobs.expired(rows, F.lit("1996-01-01").cast("timestamp")).select("id")


@query("""WITH g AS (SELECT o_custkey, o_orderkey % 11 AS s, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY 1, 2)
      SELECT o_custkey AS investigation_id, s::BIGINT AS stage_no, CASE WHEN s < 10 THEN s + 1 END::BIGINT AS next_no FROM g WHERE done""")
def completed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("investigation_id"), _pick(F.col("o_orderkey"), *V.STAGES).alias("stage"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("PENDING").alias("status"))
    number = lambda c: (F.nullif(F.array_position(F.array(*map(F.lit, V.STAGES)), F.col(c)), F.lit(0)) - 1).alias("n")
    return jobs.stage_complete(rows).select("investigation_id", number("stage").alias("stage_no"), number("next_stage").alias("next_no"))


@query(f"""WITH r AS (SELECT o_orderkey AS job_id, o_orderkey % 4 AS s, count(l_linenumber) AS n, max(l_linenumber) AS m FROM orders LEFT JOIN {_LINES_SQL} ON l_orderkey = o_orderkey GROUP BY 1, 2)
      SELECT job_id, 'UNSUPPORTED_MUTATION' AS error FROM r WHERE s = 3 AND n > 0 UNION ALL SELECT job_id, 'MUTATION_COUNT' FROM r WHERE (s = 0 AND n NOT BETWEEN 3 AND 5) OR (s = 1 AND n = 0) OR (s = 2 AND n <> 1)
      UNION ALL SELECT DISTINCT l_orderkey, 'WORK_KEY' FROM {_LINES_SQL} WHERE l_orderkey % 4 = 1 AND l_linenumber = 2""")
def stage_result_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of four stages, with a mutation for each line."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    stage = _pick(k, "GENERATE_HYPOTHESES", "SEARCH_SUPPORT", "COMPLETE", "VERIFY_REPLAY")
    kind = _pick(k, "HYPOTHESIS_CREATED", "RETRIEVAL_COMPLETED", "INVESTIGATION_COMPLETED", "CLAIM_CREATED")
    key = F.when(k % 4 == 1, _text("h", k)).otherwise("case")
    line = table(spark, sf_dir, "orders").join(_lines(spark, sf_dir), k == F.col("l_orderkey"), "left")
    mutation = F.struct(kind.alias("kind"), F.when(n == 2, "other").otherwise(key).alias("subject_id"), F.array().cast("array<bigint>").alias("candidate_ids"))
    rows = line.groupBy(k.alias("job_id"), stage.alias("stage"), key.alias("work_key"), F.lit(1).alias("investigation_id")).agg(F.collect_list(F.when(n.isNotNull(), mutation)).alias("mutations"))
    none = table(spark, sf_dir, "orders").where("false").select(F.lit(1).alias("investigation_id"), F.lit("claim").alias("kind"), k.alias("candidate_id"))
    return snapshot.stage_result_errors(rows, none)


_SPANS_SQL = "SELECT event_id AS id, user_id AS job_id, event_id % 4 < 2 AS running, event_id % 1000 AS start, user_id % 3 = 0 AS lost, user_id * 7 % 900 AS attempt FROM events"


@query(f"""SELECT id, CASE WHEN running AND lost AND start >= attempt THEN 'FAILED' WHEN running THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status,
             CASE WHEN running AND lost AND start >= attempt THEN greatest(0, attempt + 500 - start) * 1000 WHEN NOT running THEN 5 END::BIGINT AS duration_ms FROM ({_SPANS_SQL})""")
def expired_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of their user's job, half still running; a third of the jobs had
    an attempt that lost its lease."""
    i, u = F.col("event_id"), F.col("user_id")
    at = lambda seconds: F.timestamp_seconds(seconds)
    running = i % 4 < 2
    spans = table(spark, sf_dir, "events").select(i.alias("id"), u.alias("job_id"), F.when(running, "RUNNING").otherwise("SUCCEEDED").alias("status"), at(i % 1000).alias("started_at"), F.when(~running, at(i % 1000 + 1)).alias("completed_at"), F.when(~running, 5).cast("long").alias("duration_ms"))
    tries = table(spark, sf_dir, "events").select(u.alias("job_id"), F.when(u % 3 == 0, "LEASE_EXPIRED").otherwise("SUCCEEDED").alias("outcome"), at(u * 7 % 900).alias("started_at"), at(u * 7 % 900 + 500).alias("completed_at")).distinct()
    return jobs.close_expired(spans, tries).select("id", "status", "duration_ms")


@query("""SELECT event_id AS id, 'PARENT_CONTEXT' AS error FROM events WHERE event_id % 9 = 1 UNION ALL SELECT event_id, 'TRANSITION' FROM events WHERE event_id % 10 = 3""")
def span_context_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    parent = F.when(i % 9 == 1, -1).when(i % 2 == 0, i)
    status = F.when(i % 10 == 3, "PAUSED").when(i % 3 == 0, "RUNNING").otherwise("FAILED")
    spans = table(spark, sf_dir, "events").select(i.alias("id"), F.col("user_id").alias("investigation_id"), F.col("user_id").alias("job_id"), parent.alias("parent_span_id"), status.alias("status"), F.when(status != "RUNNING", F.col("ts")).alias("completed_at"))
    return jobs.span_errors(spans)


_ISSUES = ("[]", '[{"path": ["a", 1], "code": "missing"}]', '[{"path": "a", "code": "x"}]', '[{"path": [], "code": 3}]', '[{"path": [], "code": "x", "input": "secret"}]', '{"path": []}', '[{"code": "x"}]', '["text"]')


@query("""WITH r AS (SELECT event_id AS id, event_id % 8 AS k, ['SCHEMA_FAILED', 'SUCCEEDED', 'LOST'][1 + event_id % 3] AS status FROM events)
      SELECT id, 'ISSUE_FORM' AS error FROM r WHERE k IN (2, 3, 4, 6, 7) UNION ALL SELECT id, 'ISSUES' FROM r WHERE k = 5 UNION ALL SELECT id, 'STATUS' FROM r WHERE status = 'LOST' UNION ALL SELECT id, 'UNEXPECTED_ISSUES' FROM r WHERE status <> 'SCHEMA_FAILED' AND k NOT IN (0, 5)""")
def request_issue_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return jobs.request_errors(table(spark, sf_dir, "events").select(i.alias("id"), _pick(i, "SCHEMA_FAILED", "SUCCEEDED", "LOST").alias("status"), _pick(i, *_ISSUES).alias("validation_issues")))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' ELSE 'number' END AS kind, p_partkey % 3 = 0 AS more FROM part)
      SELECT p_partkey, kind, kind = 'object' AS complete, CASE WHEN kind = 'object' AND more THEN 'other' ELSE '' END AS others, CASE WHEN kind = 'object' THEN '{"size":' || p_size::VARCHAR || CASE WHEN more THEN ',"other":[1,"x"]' ELSE '' END || '}' END AS rest FROM p JOIN part USING (p_partkey)""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    whole = _text('{"name": "', F.col("p_brand"), '", "size": ', F.col("p_size"), F.when(k % 3 == 0, ', "other": [1, "x"]').otherwise(""), "}")
    text = F.when(k % 4 == 0, whole).when(k % 4 == 1, "[1]").when(k % 4 == 2, '"x"').otherwise("1.5")
    kind = json_fields.kind_of(text)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), json_fields.has_keys(text, ("size", "name")).alias("complete"), F.array_join(json_fields.other_keys(text, ("size", "name")), ",").alias("others"), F.when(kind == "object", json_fields.without_keys(text, ("name",))).alias("rest"))


# Snapshots.


@query(f"""SELECT o_custkey % 20 AS case_id, count(*) AS rows, sha256('[' || string_agg('{{"item": {{"p": ' || l_partkey::VARCHAR || '}}, "evidence_id": "' || id || '", "model_run_id": "m' || (l_partkey % 3)::VARCHAR || '", "review_status": "' || CASE WHEN l_linenumber % 2 = 0 THEN 'ACCEPTED' ELSE 'NOT_REQUIRED' END || '", "source_checksum": "s' || l_orderkey::VARCHAR || '"}}', ', ' ORDER BY id) || ']') AS set_hash
      FROM (SELECT *, lpad((l_orderkey * 100 + l_linenumber)::VARCHAR, 12, '0') AS id FROM {_LINES_SQL} JOIN orders ON l_orderkey = o_orderkey)
      WHERE l_linenumber <> 3 AND l_partkey % 3 > 0 AND l_orderkey % 5 > 0 AND o_custkey % 20 % 4 > 0 AND l_orderkey % 7 > 0 AND l_partkey % 11 > 0 GROUP BY 1""")
def pinned_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evidence of their order: unreviewed thirds, failed runs, closed sources
    and cases, and units completed by another run are left out."""
    o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("case_id"))
    line = _lines(spark, sf_dir).join(order, o == F.col("o_orderkey"))
    unit = F.lpad((o * 100 + n).cast("string"), 12, "0")
    run = _text("m", p % 3)
    evidence = line.select(unit.alias("id"), "case_id", o.alias("source_document_id"), unit.alias("structural_unit_id"), F.concat(run, F.lit("-"), F.col("case_id").cast("string")).alias("model_run_id"), run.alias("run"), F.when(n == 3, "PENDING").when(n % 2 == 0, "ACCEPTED").otherwise("NOT_REQUIRED").alias("review_status"), p.alias("part"))
    done = evidence.select("structural_unit_id", F.when(F.col("part") % 11 > 0, F.col("model_run_id")).otherwise("other").alias("model_run_id"))
    sources = order.select(F.col("o_orderkey").alias("id"), "case_id", F.col("o_orderkey").alias("docket_item_id"), F.lit("Attachment").alias("title"), F.lit("FACTUAL_REPORT").alias("document_type"), F.when(F.col("o_orderkey") % 5 > 0, "INVESTIGATION_EVIDENCE").otherwise("FINAL_FINDING").alias("visibility"), F.lit("2024-01-01").cast("timestamp").alias("published_at"), _text("s", F.col("o_orderkey")).alias("checksum"))
    units = evidence.select(F.col("structural_unit_id").alias("id"), "source_document_id", F.lit("c").alias("content_checksum"))
    runs = evidence.select(F.col("model_run_id").alias("id"), "case_id", F.when(F.col("run") == "m0", "FAILED").otherwise("SUCCEEDED").alias("status"), F.lit("p").alias("prompt_hash")).distinct()
    dockets = order.select(F.col("o_orderkey").alias("id"), "case_id", F.when(F.col("o_orderkey") % 7 > 0, "AI_ALLOWED").otherwise("LINK_ONLY").alias("processing_disposition"))
    cases = spark.range(20).select("id", F.when(F.col("id") % 4 > 0, "BLIND").otherwise("LOCKED").alias("state"), F.lit("2025-01-01").cast("timestamp").alias("evidence_cutoff"))
    active = snapshot.active_evidence(evidence, done, sources, units, runs, dockets, cases)
    item = canonical.object_text({"p": canonical.number_text(F.col("part"))})
    return snapshot.snapshot_hash(active.withColumn("model_run_id", F.col("run")), item)
