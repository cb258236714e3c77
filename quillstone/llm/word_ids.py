"""Token ids of whole columns: words are coded by Arrow, encoded once per batch
and gathered back with NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries in each of the two generations of a worker's cache: fewer take less
#: memory and more time.
CACHE_ENTRIES = 400_000
#: ASCII signs that are neither letters nor digits; not the apostrophe, which begins
#: units like 's.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordCache:
    """Ids of words, kept in two generations so that frequent words survive."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int):
        self.encode, self.entries = encode, entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; ``words`` are distinct."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in missing:
            known = self.old.get(words[i])
            if known is None:
                fresh.append(i)
            else:
                found[i] = self.young[words[i]] = known
        if fresh:
            for i, got in zip(fresh, self.encode([words[i] for i in fresh]), strict=True):
                found[i] = self.young[words[i]] = got
        return found


def gather(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``parts[c]`` for each code c, one after the other, and the
    number of ids before each code (one entry more than codes)."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), dtype="<u4")
    starts = np.cumsum(lengths) - lengths
    counts = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(starts[codes] - ends[:-1], counts)
    at += np.arange(ends[-1])
    return flat[at], ends


class WordBpe:
    """A tokenizer file whose normaliser and splitter treat white space only as
    a boundary, so that a text's ids are those of its words, one by one; others are
    refused. That case does not matter and marks are units of their own is known of
    the default file only: words of others are encoded as they are."""

    _open: dict[tuple[str, int], WordBpe] = {}

    def __init__(self, path: str, entries: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if not all(self._plain(f" {a}  {b}\n").tolist() == [*self._plain(a), *self._plain(b)] for a, b in (("one", "Two,"), ("the", "3.5"))):
            raise ValueError(f"white space is more than a boundary in {path}")
        self.cache = WordCache(self._encode if path == self.default() else self._alone, entries)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.bases = WordCache(self._encode_bases, entries)

    @staticmethod
    def default() -> str:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")

    @classmethod
    def of(cls, path: str | None, entries: int = CACHE_ENTRIES) -> WordBpe:
        key = (path or cls.default(), entries)
        if key not in cls._open:
            cls._open[key] = cls(*key)
        return cls._open[key]

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _encode_bases(self, words: list[str]) -> list[bytes]:
        """Words of letters are one unit each, whose last id ends a word, so
        many are encoded in one call; others are encoded alone."""
        out: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()]
        for i in range(0, len(letters), 4096):
            part = letters[i : i + 4096]
            ids = self._plain(" ".join(part))
            bounds = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(bounds) == len(part) + 1:
                raw = ids.tobytes()
                out |= {w: raw[4 * a : 4 * b] for w, a, b in zip(part, bounds, bounds[1:], strict=False)}
        rest = [w for w in words if w not in out]
        out |= dict(zip(rest, self._alone(rest), strict=True))
        return [out[w] for w in words]

    def _alone(self, words: list[str]) -> list[bytes]:
        """Ids of each word by itself."""
        out = []
        for i in range(0, len(words), 1024):
            found = self.tokenizer.encode_batch_fast(words[i : i + 1024], add_special_tokens=False)
            out += [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]
        return out

    @staticmethod
    def _units(word: str) -> tuple[str, str, str]:
        """Marks, letters and marks of a word that is no more than these, as the
        splitter has letters and runs of other signs as units; else a closing mark
        after a letter apart from the rest; or the word alone."""
        if word.isascii():
            word = word.lower()
        if word.isalpha():
            return "", word, ""
        core = word.strip(MARKS)
        if core.isalpha() and (core.isascii() or core.lower().isalpha()):
            at = word.index(core)
            return word[:at], core, word[at + len(core) :]
        if len(word) > 1 and word[-1] in ",.;:!?" and word[-2].lower().isalpha():
            return "", word[:-1], word[-1]
        return "", word, ""

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words share their letters and marks, and the case of ASCII letters is
        dropped, so few units remain to be encoded."""
        split = list(map(self._units, words))
        needed = list({x for units in split for x in units if x})
        known = dict(zip(needed, self.bases.ids(needed), strict=True))
        known[""] = b""
        return [known[a] + known[w] + known[z] for a, w, z in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one entry more)."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        words = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        if not len(coded):
            return np.zeros(0, "<u4"), words
        ids, ends = gather(self.cache.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy())
        return ids, ends[words]
