"""WARC archives: writing with revisits, and a reader that salvages.

``write`` makes one record per row, each a gzip member of its own, in archives of
bounded size in a shared folder. Of equal payloads of at least ``min_bytes``, the
row with the smallest id is a response and the others revisit it. ``read`` checks
every record (member checksum, version line, length, closing blank lines, block
and payload digests). After a failed check it looks for the next place where a
valid member or version line begins, goes on from there, and logs the bytes in
between as a gap.

Cases: a null html is an empty payload; a null url is named by the row's id; a row
with a null id is a response, never revisited, and read back with a null id; rows that
repeat an id and its payload are all responses; a very long payload or url
is a record like any other, held whole by one task; an empty table makes no archive
and no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import durable, keep_until_exit, map_arrow, quoted, shared_dir, sized_broadcast, slices

ARCHIVE_BYTES = 16 << 20
LEVEL = 1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP, _VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(key: object) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record(key: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A response record, or with ``refers_to`` a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"\s", "%20", url) if url else f"urn:page:{key}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


class Damaged(ValueError):
    """A check of a record failed."""


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that begins at ``at``, all its checks passed, and its end."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged("no length")
    begin, end = stop + 4, stop + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    found = Record(headers, data[begin:end])
    checks = {"warc-block-digest": found.block} | ({"warc-payload-digest": found.payload} if headers.get("warc-type") == "response" else {})
    for name, content in checks.items():
        if name in headers and headers[name] != f"sha1:{digest(content)}":
            raise Damaged(name)
    return found, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's content and its end."""
    view, out, pull = memoryview(data), io.BytesIO(), zlib.decompressobj(31)
    pos = at
    try:
        while not pull.eof:
            if pos >= len(data):
                raise Damaged("the member does not end")
            out.write(pull.decompress(view[pos : pos + (1 << 15)]))
            pos += min(1 << 15, len(data) - pos)
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    return out.getvalue(), pos - len(pull.unused_data)


def _at(data: bytes, at: int) -> tuple[list[Record | str], int]:
    """The records of the member or the version line at ``at``, and its end. A
    record of a member that fails a check is why, and its next version line goes on."""
    if not data.startswith(_GZIP, at):
        found, end = parse(data, at)
        return [found], end
    content, end = _inflate(data, at)
    records, pos = [], 0
    while pos < len(content):
        try:
            found, pos = parse(content, pos)
        except Damaged as e:
            found = str(e)
            following = _VERSION.search(content, pos + 1)
            pos = following.start() if following else len(content)
            if records and isinstance(records[-1], str):
                continue  # one gap, named by its first failed check
        records.append(found)
    if not any(isinstance(x, Record) for x in records):
        raise Damaged(records[0] if records else "an empty member")
    return records, end


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(start, end, record), or (start, end, why) for a gap, in order; together
    they cover all bytes. A gap inside a member has the member's place."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            records, end = _at(data, at)
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
            following = _STARTS.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost is not None:
            yield lost, at, why
            lost = None
        for found in records:
            yield at, end, found
        at = end
    if lost is not None:
        yield lost, len(data), why


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _target(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillstone-warc-{uuid.uuid4().hex}"


def revisits(pages: DataFrame, id_col: str, payload: F.Column, min_bytes: int) -> DataFrame:
    """size, sha1 and refers_to of payloads that several rows have."""
    sized = pages.select(F.octet_length(payload).alias("size"), F.sha1(payload).alias("sha1"), quoted(id_col).alias("id")).where(F.col("size") >= min_bytes)
    return sized.groupBy("size", "sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives and return their manifest: archive, records, bytes.

    An archive's name is its task attempt's own, and readers take the manifest's
    names only, so what a failed attempt left behind is never read."""
    spark = pages.sparkSession
    own, folder = folder is None, folder or _target(spark)
    payload = F.coalesce(quoted(html_col), F.lit("")).cast("binary")
    first = durable(revisits(pages, id_col, payload, min_bytes), "warc-first")
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).alias("size"), F.sha1(payload).alias("sha1"))
    rows = rows.join(sized_broadcast(first), ["size", "sha1"], "left")
    rows = rows.select("id", "url", "payload", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        out, name, n, done = io.BytesIO(), "", 0, []

        def close() -> None:
            nonlocal out, n
            if n:
                name = f"{uuid.uuid4().hex}.warc.gz"
                store.create_dir(root, recursive=True)
                with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(out.getvalue())
                done.append((name, n, out.tell()))
            out, n = io.BytesIO(), 0

        for batch in batches:
            for part in slices(batch, "payload"):
                for key, url, body, refers_to in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to")), strict=True):
                    out.write(member(record(key, url, body, refers_to)))
                    n += 1
                    if out.tell() >= ARCHIVE_BYTES:
                        close()
        close()
        if done:
            names, counts, sizes = zip(*done, strict=True)
            yield pa.record_batch([pa.array([f"{folder}/{x}" for x in names]), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    manifest = durable(map_arrow(rows, run, "archive string, records long, bytes long"), "warc-manifest")
    if own:
        keep_until_exit(spark, folder)
    return manifest


FIELDS = {"archive": "string", "start": "long", "end": "long", "gap": "string", "record_id": "string", "record_type": "string", "refers_to": "string", "target": "string", "payload_bytes": "long", "payload_digest": "string"}


def _fields(found: Record) -> tuple:
    h = found.headers
    name = lambda x: ((re.fullmatch("<urn:page:(.*)>", x) or ["", x])[1] or None) if x else None
    if h.get("warc-type") == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", found.block)
        return name(h.get("warc-record-id")), "revisit", name(h.get("warc-refers-to")), h.get("warc-target-uri"), int(size[1]) if size else None, h.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = found.payload
    return name(h.get("warc-record-id")), h.get("warc-type"), None, h.get("warc-target-uri"), len(payload), digest(payload)


def read(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of archives given as rows of Spark's ``binaryFile`` source.

    A gap has ``gap`` (why) and its bytes' place; a record has the other fields,
    and its payload if asked for."""
    schema = ", ".join(f"`{k}` {v}" for k, v in FIELDS.items()) + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if v == "long" else pa.string() for v in FIELDS.values()] + [pa.binary()] * payloads

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*FIELDS, *["payload"] * payloads])

        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, held = [], 0
                for start, end, found in salvage(content.as_py() or b""):
                    own = (path.as_py(), start, end, found, *[None] * 6) if isinstance(found, str) else (path.as_py(), start, end, None, *_fields(found))
                    rows.append((*own, *[None if isinstance(found, str) else found.payload] * payloads))
                    held += len(found.block) if payloads and not isinstance(found, str) else 0
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return map_arrow(files.select("path", "content"), run, schema)


def read_manifest(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """``read`` of the archives that ``write`` lists."""
    spark = manifest.sparkSession
    some = manifest.select("archive").first()
    if some is None:
        return read(spark.createDataFrame([], "path string, content binary"), payloads)
    files = spark.read.format("binaryFile").load(some.archive.rpartition("/")[0])
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    names = manifest.select(last("archive").alias("name"))
    return read(files.withColumn("name", last("path")).join(sized_broadcast(names), "name", "left_semi"), payloads)
