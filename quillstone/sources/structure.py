"""From bytes to addressable units: media types, text blocks, pages, locators."""

from __future__ import annotations

import csv
import io
import itertools
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V
from quillstone.functions.udf import vectorized

MEDIA_TYPES = ("PDF", "PNG", "JPEG", "XLSX", "HTML", "CSV", "TEXT")
_TEXT_RUN, _SKIPPED = re.compile(r">([^<]+)<"), re.compile(r"(?is)<(script|style)\b.*?</\1>")


#: What files begin with, members of a workbook, delimiters of tables.
MAGIC = {"PDF": b"%PDF-", "PNG": b"\x89PNG\r\n\x1a\n", "JPEG": b"\xff\xd8\xff", "ZIP": b"PK\x03\x04"}
WORKBOOK = frozenset(("[Content_Types].xml", "xl/workbook.xml"))
DELIMITERS = ",;\t|"
_HTML, _CONTROL = re.compile(r"\s*<(?:!doctype\s+html|html)", re.I), re.compile(r"[\x00-\x08\x0e-\x1f]")


def _is_workbook(data: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return WORKBOOK.issubset(z.namelist())
    except zipfile.BadZipFile:
        return False


def is_table(text: str, rows: int = 10) -> bool:
    """Whether the first rows, two at least, have the same number of fields, over
    one, by one of the delimiters."""
    head = list(itertools.islice((x for x in text.splitlines() if x), rows))
    if len(head) < 2:
        return False
    for delimiter in DELIMITERS:
        if delimiter in head[0]:
            widths = set(map(len, csv.reader(head, delimiter=delimiter)))
            if len(widths) == 1 and min(widths) > 1:
                return True
    return False


def sniff(data: bytes) -> str | None:
    """The media type by content; null for what is not supported."""
    magic = next((kind for kind, first in MAGIC.items() if data.startswith(first)), None)
    if magic and magic != "ZIP":
        return magic
    if magic and _is_workbook(data):
        return "XLSX"
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    if not text or _CONTROL.search(text):
        return None
    return "HTML" if _HTML.match(text) else "CSV" if is_table(text) else "TEXT"


@vectorized("string")
def media_type(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else sniff(bytes(b)), na_action=None)


def route(media: Column, supports: dict[str, tuple[str, ...]]) -> Column:
    """The one processor that takes a media type; UNSUPPORTED or AMBIGUOUS else."""
    names = F.array_compact(F.array(*(F.when(media.isin(*kinds), name) for name, kinds in supports.items())))
    return F.when(F.size(names) == 0, "UNSUPPORTED").when(F.size(names) > 1, "AMBIGUOUS").otherwise(F.get(names, F.lit(0)))


def blocks(text: str) -> list[tuple[int, int]]:
    """Places of a document's text blocks: runs between tags that are not blank and
    not inside scripts or styles; all of a text without a tag."""
    if "<" not in text:
        return [(0, len(text))]
    skipped = [m.span() for m in _SKIPPED.finditer(text)]
    found, at = [], 0
    for m in _TEXT_RUN.finditer(text):
        start, end = m.span(1)
        while at < len(skipped) and skipped[at][1] <= start:
            at += 1
        inside = at < len(skipped) and skipped[at][0] <= start
        if not inside and m[1].strip():
            found.append((start, end))
    return found


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ordinal, start, end (code points), text, content_checksum."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [(i, n, s, e, t[s:e]) for i, t in enumerate(part.column(text_col).to_pylist()) if t is not None for n, (s, e) in enumerate(blocks(t))]
                if rows:
                    index, *columns = zip(*rows, strict=True)
                    yield pa.record_batch(
                        [part.column(id_col).take(pa.array(index)), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))],
                        [id_col, "ordinal", "start", "end", "text"],
                    )

    found = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ordinal long, start long, end long, text string")
    return found.withColumn("content_checksum", F.sha2("text", 256))


def resolve_text(text: Column, start: Column, end: Column) -> Column:
    """Text at a locator; null past the end."""
    return F.when((start >= 0) & (end <= F.char_length(text)) & (start <= end), F.substring(text, start + 1, end - start))


def page_units(text_units: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, ordinal, kind, page, checksum: text blocks in order, then one
    image per scan-like page, ordinals going on."""
    text = text_units.select("document_id", F.lit(0).alias("g"), "page", F.col("reading_order").alias("o"), F.lit("TEXT_BLOCK").alias("kind"), F.sha2("text", 256).alias("checksum"))
    scans = pages.where("page_kind = 'SCAN_LIKE'").select("document_id", F.lit(1).alias("g"), "page", F.col("page").alias("o"), F.lit("IMAGE").alias("kind"), F.sha2(F.concat(F.lit("scan:"), F.col("page").cast("string")), 256).alias("checksum"))
    both = text.unionByName(scans)
    return both.select("document_id", (F.row_number().over(W.partitionBy("document_id").orderBy("g", "o", "page")) - 1).cast("long").alias("ordinal"), "kind", "page", "checksum")


def normalized_box(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column) -> Column:
    """x1, y1, x2, y2 as shares of the page; null if empty or outside."""
    x1, x2, y1, y2 = left / width, right / width, F.least(bottom, top) / height, F.greatest(bottom, top) / height
    return F.when((x1 >= 0) & (y1 >= 0) & (x2 <= 1) & (y2 <= 1) & (x1 < x2) & (y1 < y2), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def picture_coverage(pictures: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, page, coverage: the pictures' share of the page, 1 at most."""
    area = pictures.groupBy("document_id", "page").agg(F.sum(F.abs(F.col("r") - F.col("l")) * F.abs(F.col("t") - F.col("b"))).alias("area"))
    return pages.join(area, ["document_id", "page"], "left").select("document_id", "page", F.least(F.coalesce("area", F.lit(0.0)) / (F.col("width") * F.col("height")), F.lit(1.0)).alias("coverage"))


def page_kind(characters: Column, coverage: Column, has_fonts: Column, min_characters: int = 30, min_coverage: float = 0.6) -> Column:
    return F.when((characters < min_characters) & (coverage >= min_coverage) & ~has_fonts, "SCAN_LIKE").otherwise("DIGITAL")


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """Format, width and height of PNG and JPEG bytes, from their headers."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return "PNG", *struct.unpack(">II", data[16:24])
    at = 2
    while data.startswith(b"\xff\xd8\xff") and at + 9 <= len(data):
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "JPEG", width, height
        at += 2 + size
    return None


@vectorized("struct<format:string,width:long,height:long>")
def image_header(content: pd.Series) -> pd.DataFrame:
    found = [image_size(bytes(b)) if b is not None else None for b in content]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["format", "width", "height"])


def timestamp_kind(name: Column, values: Column) -> Column:
    """RELATIVE, UTC, LOCAL or UNKNOWN by a column's name and (text) values."""
    n = F.lower(name)
    any_of = lambda *words: n.rlike("|".join(words))
    utc = F.forall(values, lambda v: v.endswith("Z") | v.endswith("+00:00"))
    return F.when(any_of("relative", "recorder", "elapsed", "seconds"), "RELATIVE").when(any_of("utc") | utc, "UTC").when(any_of("local", "clock"), "LOCAL").otherwise("UNKNOWN")


def explicit_utc(text: Column) -> Column:
    """A timestamp whose text has offset zero; null otherwise."""
    return F.when(text.rlike(r"(?:Z|[+-]00:?00(?::?00)?)$"), F.try_to_timestamp(text))


def document_type(raw: Column) -> Column:
    """Upper case, spaces and hyphens as underscores; OTHER if unknown or empty."""
    name = F.translate(F.upper(F.trim(raw)), " -", "__")
    return F.when(name.isin(*V.DOCUMENT_TYPES), name).otherwise("OTHER")
