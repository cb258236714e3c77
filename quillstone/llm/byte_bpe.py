"""Byte-level BPE encoding and decoding over a serialised sentencepiece model.

The rank file of a byte-level vocabulary is written out as a sentencepiece BPE
model: every token's bytes are spelled with one printable character per byte,
the score is the negative rank, and the normaliser is the identity, so the
processor's merges are the vocabulary's own. A text is cut into the matches of
the split pattern, each match is encoded separately, and ids decode through the
inverse map id -> bytes.

Cases: null and empty texts give no ids; extra columns are ignored, whatever their
names; repeated rows and ids are encoded row by row; text of any length is encoded
whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import fresh, map_arrow, quoted, slices, texts_of

#: Entries in each of the two generations of a worker's cache.
CACHE_ENTRIES = 400_000


def byte_alphabet() -> list[str]:
    """One visible character for each byte: printable Latin-1 stands for itself,
    the others follow from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks of {path} are not 0..n-1")
    return [ranks[i] for i in range(len(ranks))]


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The ModelProto of a BPE model whose piece ids are the ranks; <unk> is last."""
    alphabet = byte_alphabet()
    pieces = []
    for rank, token in enumerate(tokens):
        spelled = "".join(alphabet[b] for b in token).encode()
        pieces.append(_field(1, _field(1, spelled) + _field(2, -float(rank)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file, with a cache of encoded chunks."""

    _open: dict[tuple[str, str], ByteBpe] = {}

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.spelling = dict(enumerate(byte_alphabet()))
        # White space is the Unicode property, without the information separators.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        #: Whether words that single spaces part are encoded alone: a fact of the public pattern.
        self.by_words = pattern == public_tokenizers.PATTERN
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str | None, pattern: str | None) -> ByteBpe:
        import public_tokenizers

        key = (path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        if key not in cls._open:
            cls._open[key] = cls(*key)
        return cls._open[key]

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens as little-endian 32-bit integers."""
        out, rest, spelled = {}, [], []
        for piece in pieces:
            raw = piece.encode()
            ids = self.whole.get(raw)
            if ids is None:
                rest.append(piece)
                spelled.append(raw.decode("latin-1").translate(self.spelling))
            else:
                out[piece] = ids
        for piece, ids in zip(rest, self.model.encode(spelled, out_type=int, num_threads=1) if rest else [], strict=True):
            out[piece] = array("I", ids).tobytes()
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Put the ids of ``chunks`` into the young generation."""
        fresh = []
        for c in chunks:
            ids = self.old.get(c)
            if ids is None:
                fresh.append(c)
            else:
                self.cache[c] = ids
        cut = {c: self.split(c) for c in fresh if self.by_words and not c.lstrip(" ").isalpha()}
        plain = [c for c in fresh if c not in cut]
        known = self._pieces(list({p for parts in cut.values() for p in parts}.union(plain)))
        for c in plain:
            self.cache[c] = known[c]
        for c, parts in cut.items():
            self.cache[c] = b"".join([known[p] for p in parts])

    def chunks(self, text: str) -> list[str]:
        """Parts that are encoded alone. With another pattern than the public one,
        these are its matches. With that one, where all white space is single spaces
        and newlines between other characters, a newline is a pre-token and a
        space starts one, so the parts are words, which repeat; otherwise they
        are the pre-tokens."""
        if not self.by_words or text.replace("\n", " ").split(" ") != text.split():
            return self.split(text)
        out = []
        for line in text.split("\n"):
            first, *others = line.split(" ")
            out.append(first)
            out += [" " + x for x in others]
            out.append("\n")
        out.pop()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        chunked = [self.chunks(t) for t in texts]
        needed = set().union(*chunked)
        if len(self.cache) + len(needed) > CACHE_ENTRIES:
            self.old, self.cache = self.cache, {}
        missing = needed.difference(self.cache)
        if missing:
            self._learn(missing)
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in chunked]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col``, n_tokens, ids: the ids of each text, little-endian, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    rows = texts_of(docs, id_col, text_col)
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """The columns of ``encoded`` and decoded: the bytes that the ids spell. Where a
    column has that name already, underscores follow it."""
    names, (added,) = encoded.columns, fresh(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks, None)
        for batch in batches:
            for part in slices(batch, ids_col):
                spelled = [bpe.decode(x or b"") for x in part.column(ids_col).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(spelled, pa.binary())], [*names, added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_arrow(encoded, run, f"{kinds}, `{added}` binary")


def lengths(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """n_tokens of each text: the number of ids that ``encode`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch([pa.array([len(x) // 4 for x in ids], pa.int64())], ["n_tokens"])

    return map_arrow(docs.select(quoted(text_col).alias("text")), run, "n_tokens long")
