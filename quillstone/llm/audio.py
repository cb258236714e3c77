"""Bytes kept as 8-bit audio, and features of what is read back.

``store`` pads a text's UTF-8 bytes to a positive multiple of ``ALIGN`` and keeps
them as the samples of a mono 8-bit WAV file, with the unpadded length in a chunk
of its own. ``features`` reads such files: the samples are resampled by a
polyphase filter, overlapping windows become log-mel bands, and the windows'
energy is cut into active segments with a higher threshold to begin one than to
end it. Bands are stored as Arrow fixed-shape tensors with their time spans.

Cases: null and empty texts are one block of padding; long media are read in
blocks; equal bytes give equal features, as every file is computed alone and
bands are rounded; repeated ids are rows of their own; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import map_arrow, slices, texts_of

ALIGN, PAD = 576, 0xFF
RATE_IN, UP, DOWN = 12_000, 2, 3
RATE = RATE_IN * UP // DOWN
TAPS = 24  # of each phase
WINDOW, HOP, BANDS = 256, 128, 32
TENSOR_FRAMES = 64
#: Decibels of full scale, without the mean, at which a segment begins and ends.
BEGIN_DB, END_DB = -13.0, -15.0
BLOCK = ALIGN * 512


def wav(payload: bytes, n_bytes: int) -> bytes:
    """A RIFF file of unsigned 8-bit samples; chunk ``ulen`` has the length
    before padding."""
    body = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE_IN, RATE_IN, 1, 8) + struct.pack("<4sIQ", b"ulen", 8, n_bytes) + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body


def read_wav(data: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    chunks, at = {}, 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        chunks[name] = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if struct.unpack("<HHIIHH", chunks[b"fmt "]) != (1, 1, RATE_IN, RATE_IN, 1, 8):
        raise ValueError("not mono 8-bit samples of the expected rate")
    return chunks[b"data"], struct.unpack("<Q", chunks[b"ulen"])[0]


@cache
def _phases() -> np.ndarray:
    """A windowed-sinc low-pass filter at the lower Nyquist rate, by phase."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hanning(n + 2)[1:-1]
    phases = h.reshape(TAPS, UP).T
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float64)


def resample(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``x`` (a multiple of DOWN long) at UP / DOWN times its rate; ``before`` and
    ``after`` are its neighbours, TAPS samples at most, zeros where missing."""
    padded = np.zeros(len(x) + 2 * TAPS)
    padded[TAPS - len(before) : TAPS] = before
    padded[TAPS : TAPS + len(x)] = x
    padded[TAPS + len(x) : TAPS + len(x) + len(after)] = after
    n = len(x) // DOWN
    out = np.zeros((n, UP))
    for phase, taps in enumerate(_phases()):
        # Output UP * m + phase lies at input DOWN * m + phase * DOWN / UP.
        first = TAPS + phase * DOWN // UP + TAPS // 2
        for k, h in enumerate(taps):
            at = first - k
            out[:, phase] += h * padded[at : at + DOWN * (n - 1) + 1 : DOWN]
    return out.reshape(-1)


@cache
def _mel() -> np.ndarray:
    """Triangles, evenly spaced in mels, over the bins of a window."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(RATE / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(WINDOW // 2 + 1) * RATE / WINDOW
    rising = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    falling = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rising, falling), 0, None)


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bands in decibels, rounded to 1/16, and the energy, of each window."""
    samples = np.frombuffer(payload, np.uint8)
    weight, mel = np.hanning(WINDOW), _mel()
    bands, energy, tail = [], [], np.zeros(0)
    for a in range(0, len(samples), BLOCK):
        b = min(a + BLOCK, len(samples))
        part = (samples[max(0, a - TAPS) : b + TAPS].astype(np.float64) - 128) / 128
        skip = a - max(0, a - TAPS)
        y = np.concatenate([tail, resample(part[skip : skip + b - a], part[:skip], part[skip + b - a :])])
        n = (len(y) - WINDOW) // HOP + 1
        if n > 0:
            frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
            frames = frames - frames.mean(axis=1, keepdims=True)
            power = np.abs(np.fft.rfft(frames * weight, axis=1)) ** 2 / WINDOW
            bands.append(np.round(160 * np.log10(power @ mel + 1e-6)) / 16)
            energy.append(np.round(160 * np.log10((frames**2).mean(axis=1) + 1e-9)) / 16)
            y = y[n * HOP :]
        tail = y
    return np.concatenate(bands).astype(np.float32), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of windows, ends exclusive: on from BEGIN_DB, off below END_DB."""
    said = np.where(energy >= BEGIN_DB, 1, np.where(energy < END_DB, 0, -1))
    last = np.maximum.accumulate(np.where(said >= 0, np.arange(len(said)), -1))
    on = np.where(last >= 0, said[last], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def milliseconds(frame: int) -> int:
    return frame * HOP * 1000 // RATE


def tensors(bands: np.ndarray) -> bytes:
    """An Arrow stream: start_ms, end_ms, frames (that are not filling), bands:
    fixed_shape_tensor<float16>[TENSOR_FRAMES, BANDS]."""
    n = -(-len(bands) // TENSOR_FRAMES)
    filled = np.zeros((n * TENSOR_FRAMES, BANDS), np.float16)
    filled[: len(bands)] = bands
    starts = [i * TENSOR_FRAMES for i in range(n)]
    counts = [min(TENSOR_FRAMES, len(bands) - s) for s in starts]
    batch = pa.record_batch(
        [
            pa.array([milliseconds(s) for s in starts], pa.int64()),
            pa.array([milliseconds(s + c - 1) + WINDOW * 1000 // RATE for s, c in zip(starts, counts, strict=True)], pa.int64()),
            pa.array(counts, pa.int32()),
            pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, TENSOR_FRAMES, BANDS)),
        ],
        ["start_ms", "end_ms", "frames", "bands"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media: a WAV file of each text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                files = []
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode()
                    full = max(1, -(-len(raw) // ALIGN)) * ALIGN
                    files.append(wav(raw.ljust(full, bytes([PAD])), len(raw)))
                yield pa.record_batch([part.column("id"), pa.array(files, pa.binary())], ["id", "media"])

    rows = texts_of(docs, id_col, text_col)
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, media binary").withColumnRenamed("id", id_col)


def features(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What is read back from each WAV file: n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, frames, tensors (an
    Arrow stream) and segments_ms, like ``32-256;400-512``."""

    def row(media: bytes) -> tuple:
        payload, n_bytes = read_wav(media)
        bands, energy = log_mel(payload)
        spans = ";".join(f"{milliseconds(a)}-{milliseconds(b - 1) + WINDOW * 1000 // RATE}" for a, b in segments(energy))
        return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(bands), tensors(bands), spans

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "tensors", "segments_ms"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_bytes=4 << 20):
                columns = zip(*(row(m) for m in part.column("text").to_pylist()), strict=True)
                yield pa.record_batch([part.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *names])

    rows = texts_of(stored, id_col, media_col)
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, tensors binary, segments_ms string").withColumnRenamed("id", id_col)
