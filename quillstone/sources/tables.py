"""Tables, manifests, zipped exports and blobs."""

from __future__ import annotations

import csv
import io
import json
import re
import tempfile
import zipfile
from array import array
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import lru_cache, partial
from itertools import batched, chain
from typing import IO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions.storage import durable
from quillstone.functions.udf import vectorized

ROWS_PER_GROUP = 50
BATCH_OF_ROWS = 4096
_XL = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def scan(spark: SparkSession, path: str, schema: StructType, key: Column | None = None) -> DataFrame:
    """Rows of a Parquet table under an explicit schema, filtered by key."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if key is None else rows.where(key)


def read_manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON manifest of exactly this schema; anything else fails."""
    if not path.endswith(".json"):
        raise ValueError("a manifest is a .json file")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parse_manifest(path: str, content: bytes) -> object:
    """A manifest by its suffix; an unknown one is an error, as are repeated keys."""
    suffix = path.rpartition(".")[2].lower()

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len(dict(pairs)) < len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    if suffix == "json":
        return json.loads(content, object_pairs_hook=once)
    if suffix in ("yaml", "yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML manifests need PyYAML") from e
        try:
            return yaml.safe_load(content)
        except yaml.YAMLError as e:
            raise ValueError(f"invalid YAML: {e}") from e
    raise ValueError(f"unsupported manifest suffix: {suffix}")


def read_manifests(files: DataFrame, schema: str) -> DataFrame:
    """path, manifest (of ``schema``), error of ``binaryFile`` rows of JSON or YAML
    manifests; fields beyond the schema, or of other types, are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    found, error = json.dumps(parse_manifest(path, content.as_py() or b""), sort_keys=True, default=str), None
                except ValueError as e:
                    found, error = None, str(e)
                texts.append(found)
                errors.append(error)
            yield pa.record_batch([b.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    rows = files.select("path", "content").mapInArrow(run, "path string, text string, error string")
    found = F.from_json("text", schema, {"mode": "PERMISSIVE"})
    names = F.array(*(F.lit(f.name) for f in rows.select(found.alias("m")).schema["m"].dataType.fields))
    extra = F.size(F.array_except(F.json_object_keys("text"), names)) > 0
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.json_object_keys("text").isNull(), "a manifest is an object").when(extra, "unknown fields")
    return rows.select("path", F.when(error.isNull(), found).alias("manifest"), error.alias("error"))


def _column_number(cell: str) -> int:
    n = 0
    for ch in cell:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


#: Numbers of built-in date formats; day zero of serial dates.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))
DAY_ZERO = datetime(1899, 12, 30)


def _dated_styles(styles: bytes) -> list[bool]:
    """For each cell style, whether its number format is one of dates or times."""
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{{{_XL['m']}}}numFmt")}
    cells = root.find("m:cellXfs", _XL)
    ids = [int(x.get("numFmtId") or 0) for x in cells] if cells is not None else []
    return [i in DATE_FORMATS or bool(re.search("[dmyhs]", own.get(i, ""), re.I)) for i in ids]


def _number_text(value: str, is_date: bool) -> str:
    """A number as text: dates by the calendar, whole numbers of text like 1.0 or 1E3
    with one zero after the point, others as they are."""
    if is_date:
        moment = DAY_ZERO + timedelta(days=float(value))
        moment = (moment + timedelta(microseconds=500)).replace(microsecond=moment.microsecond // 1000 * 1000) if moment.microsecond % 1000 else moment
        return str(moment.date()) if moment.time() == datetime.min.time() else str(moment)
    return value if re.fullmatch("-?[0-9]+", value) else repr(float(value))


#: Bytes of shared strings that need no file.
SPOOLED = 1 << 20


class SharedStrings:
    """A workbook's shared strings, beyond ``SPOOLED`` bytes in a file of the task and not in
    its memory: a text is found by its place, and recent ones are held."""

    def __init__(self, source: IO[bytes] | None):
        self.file, self.ends = tempfile.SpooledTemporaryFile(SPOOLED), array("q", [0])
        for item in _elements(source, "si") if source is not None else ():
            self.ends.append(self.ends[-1] + self.file.write("".join(t.text or "" for t in item.iter(_tag("t"))).encode()))
        self.text = lru_cache(65_536)(self._read)

    def _read(self, place: int) -> str:
        if not 0 <= place < len(self.ends) - 1:
            raise ValueError(f"no shared string {place}")
        self.file.seek(self.ends[place])
        return self.file.read(self.ends[place + 1] - self.ends[place]).decode()


def _tag(name: str) -> str:
    return f"{{{_XL['m']}}}{name}"


def _elements(source: IO[bytes], name: str) -> Iterator[ElementTree.Element]:
    """Elements of that name as they end, each forgotten when the next one is asked for."""
    path: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if e.tag == _tag(name):
            yield e
            if path:
                path[-1].remove(e)


def _row_values(row: ElementTree.Element, shared: SharedStrings, dated: list[bool]) -> list[str]:
    cells: dict[int, str] = {}
    for i, c in enumerate(row.findall("m:c", _XL)):
        value, kind = c.findtext("m:v", "", _XL), c.get("t")
        if kind == "b":
            value = {"1": "True", "0": "False"}.get(value, value)
        elif kind in (None, "n") and value:
            style = int(c.get("s") or 0)
            value = _number_text(value, style < len(dated) and dated[style])
        elif kind == "s" and value:
            value = shared.text(int(value))
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(_tag("t")))
        cells[_column_number(c.get("r")) if c.get("r") else i] = value
    return [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _sheets(data: bytes) -> Iterator[tuple[str, int, Callable[[], Iterator[list[str]]]]]:
    """Name, width and rows of each sheet. Rows are read from the archive as they are asked
    for; all sheets are read once before, for their widths and so that what can't be read fails
    before its first row. Sheets that fit ``BATCH_OF_ROWS`` rows together are kept from then."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = SharedStrings(z.open("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else None)
        dated = _dated_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}

        def rows(target: str) -> Iterator[list[str]]:
            for row in _elements(z.open(target if target.startswith("xl/") else f"xl/{target}"), "row"):
                yield _row_values(row, shared, dated)

        listed = ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _XL)
        found = [(sheet.get("name"), rels[sheet.get(f"{{{_XL['r']}}}id")].lstrip("/")) for sheet in listed]
        widths, kept, left = [], [], BATCH_OF_ROWS
        for _, target in found:
            width, source, own = 0, rows(target), []
            for row in source:
                width = max(width, len(row))
                own.append(row)
                if len(own) > left:
                    own = None
                    break
            width = max(width, max(map(len, source), default=0))
            left -= len(own or [])
            widths.append(width)
            kept.append(own)
        for (name, target), width, own in zip(found, widths, kept, strict=True):
            yield name, width, partial(rows, target) if own is None else partial(iter, own)


def stream_sheets(data: bytes) -> Iterator[tuple[str, list[str], Iterator[list[str]]]]:
    """(sheet, columns, rows) of an XLSX file or of UTF-8 CSV bytes; all values are text
    and an empty cell is ''. An empty CSV is an error. A sheet's rows must be read before the
    next sheet is asked for; of a sheet one row is held at a time."""
    if not data.startswith(b"PK\x03\x04"):
        csv.field_size_limit(len(data) + 1)
        for _ in io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", newline=""):  # what is no UTF-8 fails before its first row
            pass
        lines = csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", newline=""))
        first = next(lines, None)
        if first is None:
            raise ValueError("table source is empty")
        yield "", first, lines
        return
    for name, width, rows in _sheets(data):
        padded = (r + [""] * (width - len(r)) for r in rows())
        yield name, next(padded, []), padded


def read_sheets(data: bytes) -> list[tuple[str, list[str], list[list[str]]]]:
    """``stream_sheets``, all rows of a small file at once."""
    return [(name, columns, list(rows)) for name, columns, rows in stream_sheets(data)]


def read_tables(files: DataFrame) -> DataFrame:
    """path, sheet, columns, row_no (from 1), row of ``binaryFile`` rows; error is
    set, and the rest null, for a file that can't be read. Rows are streamed: of a file its
    bytes, and ``BATCH_OF_ROWS`` rows, are held."""

    text = pa.list_(pa.string())
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("columns", text), ("row_no", pa.int64()), ("row", text), ("error", pa.string())])

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for sheet, columns, rows in stream_sheets(content):
                for i, row in enumerate(rows, 1):
                    yield path, sheet, columns, i, row, None
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as e:
            yield path, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = (rows_of(path, content.as_py() or b"") for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True))
            for some in batched(chain.from_iterable(files), BATCH_OF_ROWS):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, columns array<string>, row_no long, row array<string>, error string")


def row_groups(rows: DataFrame, by: list[str], order: list[Column], size: int = ROWS_PER_GROUP) -> DataFrame:
    """by, ordinal, row, row_end, n_rows: consecutive groups; the header is row 1."""
    numbered = rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    grouped = numbered.groupBy(*by, F.floor((F.col("__n") - 1) / size).cast("long").alias("ordinal"))
    return grouped.agg((F.min("__n") + 1).cast("long").alias("row"), (F.max("__n") + 1).cast("long").alias("row_end"), F.count("*").alias("n_rows"))


def row_group_units(rows: DataFrame, size: int = ROWS_PER_GROUP) -> DataFrame:
    """Units of ``read_tables`` rows: path, sheet, ordinal, row, row_end, rows, and
    the SHA-256 of the payload as compact JSON with sorted keys."""
    cells = rows.where("error is null").withColumn("ordinal", F.floor((F.col("row_no") - 1) / size).cast("long"))
    grouped = cells.groupBy("path", "sheet", "columns", "ordinal").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda x: x["row"]).alias("rows"), (F.min("row_no") + 1).alias("row"), (F.max("row_no") + 1).alias("row_end")
    )

    return grouped.withColumn("content_checksum", F.sha2(_payload("columns", "rows", "sheet"), 256))


@vectorized("string")
def _payload(columns: pd.Series, rows: pd.Series, sheets: pd.Series) -> pd.Series:
    """Compact JSON with sorted keys, ASCII only."""
    text = lambda c, r, s: json.dumps({"columns": list(c), "rows": [list(x) for x in r], "sheet": s}, sort_keys=True, separators=(",", ":"))
    return pd.Series([text(*x) for x in zip(columns, rows, sheets, strict=True)], dtype=object)


def resolve_rows(rows: DataFrame, sheet: str, columns: list[str], row: int, row_end: int | None = None) -> DataFrame:
    """path, csv: the chosen columns of rows ``row`` to ``row_end`` (the header is 1)
    as CSV with CRLF; error if a column or row does not exist."""
    last = row_end or row
    own = rows.where((F.col("sheet") == sheet) & F.col("error").isNull())
    at = [F.array_position(F.col("columns"), c) for c in columns]
    quoted = lambda v: F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    line = F.concat_ws(",", *(quoted(F.get("row", (i - 1).cast("int"))) for i in at))
    head = ",".join(c if not set(c) & set(',"\r\n') else '"' + c.replace('"', '""') + '"' for c in columns)
    inside = F.col("row_no").between(row - 1, last - 1)
    lines = F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("row_no", line.alias("line"))))), lambda x: x["line"])
    found = own.groupBy("path").agg(F.max("row_no").alias("n"), F.first("columns").alias("columns"), lines.alias("lines"))
    missing = F.exists(F.array(*map(F.lit, columns)), lambda c: ~F.array_contains("columns", c))
    error = F.when(missing, "table locator column does not exist").when(F.lit(row < 2) | (F.col("n") < last - 1), "table locator exceeds source rows")
    return found.select("path", error.alias("error"), F.when(error.isNull(), F.concat(F.lit(head + "\r\n"), F.array_join("lines", "\r\n"), F.lit("\r\n"))).alias("csv"))


def zipped_cases(files: DataFrame) -> DataFrame:
    """row: the objects of the first .json member of each zip, as JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    name = next((n for n in z.namelist() if n.endswith(".json")), None)
                    rows = json.loads(z.read(name)) if name else None
                if not isinstance(rows, list):
                    raise ValueError("the export is no list")
                yield pa.record_batch([pa.array([json.dumps(r) for r in rows], pa.string())], ["row"])

    return files.select("content").mapInArrow(run, "row string")


def case_rows(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Cases of JSON rows; those without a number or date are dropped. ``fields``
    maps number, event_date, city, state, country, vehicles, status, report_type
    and key to the names that the export uses."""
    get = lambda name: F.get_json_object("row", f"$.{fields[name]}")
    vehicle = lambda name: F.nullif(F.get_json_object("row", f"$.{fields['vehicles']}[0].{name}"), F.lit(""))
    place = F.concat_ws(", ", F.nullif(get("city"), F.lit("")), F.coalesce(F.nullif(get("state"), F.lit("")), F.nullif(get("country"), F.lit(""))))
    return rows.where(get("number").isNotNull() & get("event_date").isNotNull()).select(
        get("number").alias("number"), F.to_timestamp(get("event_date")).alias("event_date"), place.alias("location"),
        *(vehicle(x).alias(x) for x in ("make", "model", "registrationNumber", "aircraftCategory")),
        F.coalesce(F.nullif(get("status"), F.lit("")), F.lit("Unknown")).alias("status"), F.coalesce(F.lower(get("report_type")) == "final", F.lit(False)).alias("has_final_report"),
        get("key").try_cast("long").alias("key"),
    )


def blob_path(checksum: Column, kind: Column | None = None) -> Column:
    """Where content of this SHA-256 is kept; null for what is no checksum."""
    path = F.concat_ws("/", *([] if kind is None else [kind]), F.substring(checksum, 1, 2), checksum)
    return F.when(checksum.rlike("^[0-9a-f]{64}$"), path)


def blobs(files: DataFrame, content: str = "content") -> DataFrame:
    """checksum, path, size, content: each content once."""
    keyed = files.withColumn("checksum", F.sha2(content, 256)).dropDuplicates(["checksum"])
    return keyed.select("checksum", blob_path(F.col("checksum")).alias("path"), F.octet_length(content).cast("long").alias("size"), F.col(content).alias("content"))


def blob_errors(files: DataFrame, content: str = "content", expected: str = "expected_checksum") -> DataFrame:
    """Files whose content is not what their expected checksum (null: any) says."""
    own = F.sha2(content, 256)
    return files.where(F.col(expected).isNotNull() & ~own.eqNullSafe(F.col(expected))).withColumn("checksum", own)


_BLOBS = "checksum string, path string, size long, content binary, prefix string"


def put_blobs(files: DataFrame, folder: str) -> None:
    """Add contents that the folder lacks, partitioned by the checksum's prefix; a
    file with an expected_checksum that its content has not is an error.

    Only the prefixes of incoming checksums (at most 256) are asked for what they hold.
    Puts may run beside each other: each adds files under names of its own, and of equal
    contents that two add at once readers take one (``stored_blobs``)."""
    if "expected_checksum" in files.columns and not blob_errors(files).isEmpty():
        raise ValueError("content does not match its expected checksum")
    new = durable(blobs(files).withColumn("prefix", F.substring("checksum", 1, 2)), "incoming-blobs")
    prefixes = sorted(r.prefix for r in new.select("prefix").distinct().collect())
    try:
        have = _blob_files(files.sparkSession, folder).where(F.col("prefix").isin(prefixes)).select("prefix", "checksum")
        new = new.join(have, ["prefix", "checksum"], "left_anti")
    except Exception as e:  # the first put
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.select("checksum", "path", "size", "content", "prefix").write.mode("append").partitionBy("prefix").parquet(folder)


def _blob_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOBS).parquet(folder)


def stored_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """prefix, checksum, size of every content, once."""
    return _blob_files(spark, folder).select("prefix", "checksum", "size").distinct()


def get_blob(spark: SparkSession, folder: str, checksum: str) -> DataFrame:
    """checksum, content, intact: only the prefix's partition is read."""
    rows = _blob_files(spark, folder).where((F.col("prefix") == checksum[:2]) & (F.col("checksum") == checksum))
    return rows.limit(1).select("checksum", "content", (F.sha2("content", 256) == F.col("checksum")).alias("intact"))
