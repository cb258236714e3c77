"""Locators: what a place in a source resolves to, by the locator's kind.

A request has locator_id, content (the source's bytes, or null for parsed pages)
and a locator as JSON with ``kind``: text (start, end), image (width, height and
perhaps region with x1, y1, x2, y2), table (sheet, columns, row, row_end), or pdf
(page, reading_order, paragraph, section, bounding_box), whose text comes from blocks
parsed before. Each kind has one resolver; an unknown kind is an error row.
"""

from __future__ import annotations

import csv
import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.sources.structure import image_size
from quillstone.sources.tables import read_sheets

PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the format's colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class LocatorError(ValueError):
    """A locator that does not fit its source."""


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], len(PNG)
    while at + 12 <= len(data):
        (size,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + body):
            raise LocatorError("image source cannot be decoded")
        out.append((name, body))
        at += 12 + size
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _rows(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Scanlines with their filters undone."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            for c in range(step):
                line[c::step] = np.add.accumulate(line[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            for x in range(stride):
                left = int(line[x - step]) if x >= step else 0
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = int(above[x - step]) if x >= step else 0
                    guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
                line[x] = (int(line[x]) + guess) & 0xFF
        elif kind:
            raise LocatorError("image source cannot be decoded")
        out[y] = above = line
    return out


def crop_png(data: bytes, x1: int, y1: int, x2: int, y2: int) -> bytes:
    """The region of a PNG of 8 bits a sample, not interlaced, as a PNG; what lies
    outside the picture is zero."""
    try:
        chunks = png_chunks(data)
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(chunks)[b"IHDR"])
        if depth != 8 or interlaced or colour not in CHANNELS:
            raise LocatorError("image source cannot be decoded")
        step = CHANNELS[colour]
        pixels = _rows(zlib.decompress(b"".join(body for name, body in chunks if name == b"IDAT")), height, width * step, step).reshape(height, width, step)
    except (KeyError, ValueError, struct.error, zlib.error) as e:
        raise LocatorError("image source cannot be decoded") from e
    out = np.zeros((max(0, y2 - y1), max(0, x2 - x1), step), np.uint8)
    part = pixels[max(0, y1) : max(0, min(y2, height)), max(0, x1) : max(0, min(x2, width))]
    out[max(0, -y1) : max(0, -y1) + part.shape[0], max(0, -x1) : max(0, -x1) + part.shape[1]] = part
    lines = np.concatenate([np.zeros((out.shape[0], 1), np.uint8), out.reshape(out.shape[0], -1)], axis=1)
    head = struct.pack(">IIBBBBB", out.shape[1], out.shape[0], 8, colour, 0, 0, 0)
    palette = b"".join(_chunk(name, body) for name, body in chunks if name in (b"PLTE", b"tRNS"))
    return PNG + _chunk(b"IHDR", head) + palette + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def _text(content: bytes, at: dict) -> tuple[str, bytes]:
    try:
        text = content.decode()
    except UnicodeDecodeError as e:
        raise LocatorError("text source is not UTF-8") from e
    if not 0 <= at["start"] <= at["end"] <= len(text):
        raise LocatorError("text locator exceeds source length")
    return "text/plain; charset=utf-8", text[at["start"] : at["end"]].encode()


def _image(content: bytes, at: dict) -> tuple[str, bytes]:
    found = image_size(content)
    if found is None:
        raise LocatorError("image source cannot be decoded")
    if found[1:] != (at["width"], at["height"]):
        raise LocatorError("image dimensions do not match locator")
    if not at.get("region"):
        return f"image/{found[0].lower()}", content
    return "image/png", crop_png(content, *(round(at["region"][c]) for c in ("x1", "y1", "x2", "y2")))


def _table(content: bytes, at: dict) -> tuple[str, bytes]:
    sheets = {name: (columns, rows) for name, columns, rows in read_sheets(content)}
    if at.get("sheet", "") not in sheets:
        raise LocatorError("table locator sheet does not exist")
    columns, rows = sheets[at.get("sheet", "")]
    wanted, first = at.get("columns") or columns, at["row"]
    last = at.get("row_end") or first
    if not set(wanted) <= set(columns):
        raise LocatorError("table locator column does not exist")
    if not 2 <= first <= last <= len(rows) + 1:
        raise LocatorError("table locator exceeds source rows")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(wanted)
    place = [columns.index(c) for c in wanted]
    writer.writerows([[row[i] for i in place] for row in rows[first - 2 : last - 1]])
    return "text/csv; charset=utf-8", out.getvalue().encode()


RESOLVERS = {"text": _text, "image": _image, "table": _table}


def resolve(requests: DataFrame) -> DataFrame:
    """locator_id, media_type, content, error of requests (locator_id, content,
    locator JSON) that point into a source's bytes."""
    kind = requests.schema["locator_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content, text in zip(b.column("content"), b.column("locator").to_pylist(), strict=True):
                try:
                    at = json.loads(text or "{}")
                    if at.get("kind") not in RESOLVERS:
                        raise LocatorError("no locator adapter supports this locator")
                    rows.append((*RESOLVERS[at["kind"]](content.as_py() or b"", at), None))
                except (LocatorError, ValueError, KeyError, TypeError) as e:
                    rows.append((None, None, str(e) if isinstance(e, ValueError) else f"locator field {e}"))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.record_batch([b.column("locator_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.string()), strict=True))], ["locator_id", "media_type", "content", "error"])

    return requests.select("locator_id", "content", "locator").mapInArrow(run, f"locator_id {kind}, media_type string, content binary, error string")


BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
PDF = f"kind string, page int, reading_order int, paragraph int, section string, bounding_box {BOX}"


def resolve_pages(blocks: DataFrame, locators: DataFrame) -> DataFrame:
    """locator_id, text, error of PDF locators (locator_id, document_id, locator JSON).

    ``blocks`` has document_id, page, reading_order, section, bounding_box (a struct of
    x1, y1, x2, y2) and text. A reading order picks that block, else a paragraph the
    page's block of that number; section and box must then be equal; what is left is
    joined by newlines in reading order."""
    at = locators.select("locator_id", "document_id", F.from_json("locator", PDF).alias("at"))
    numbered = blocks.withColumn("paragraph_no", F.row_number().over(W.partitionBy("document_id", "page").orderBy("reading_order")))
    b, l = numbered.alias("b"), at.alias("l")
    pick = F.when(F.col("l.at.reading_order").isNotNull(), F.col("b.reading_order") == F.col("l.at.reading_order")).when(F.col("l.at.paragraph").isNotNull(), F.col("b.paragraph_no") == F.col("l.at.paragraph")).otherwise(True)
    box = F.col("l.at.bounding_box")
    same_box = box.isNull() | (F.to_json("b.bounding_box") == F.to_json(box))
    on = (F.col("b.document_id") == F.col("l.document_id")) & (F.col("b.page") == F.col("l.at.page")) & pick & (F.col("l.at.section").isNull() | (F.col("b.section") == F.col("l.at.section"))) & same_box
    found = l.join(b, on, "left").groupBy("l.locator_id").agg(F.array_sort(F.collect_list(F.when(F.col("b.text").isNotNull(), F.struct("b.reading_order", "b.text")))).alias("t"))
    some = F.size("t") > 0
    return found.select("locator_id", F.when(some, F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("text"), F.when(~some, "PDF locator does not resolve to extracted text").alias("error"))
