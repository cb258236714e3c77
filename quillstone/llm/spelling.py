"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters, in whatever order they
stand, so words that differ by one letter added or removed have keys that differ by
that letter's power, and words that differ by one letter exchanged keys that differ by
two letters' powers. A word is posted under its own key and under its key less each of
its distinct letters: a removal meets the shorter word's key there, an exchange the
key that both words have without their letter. What meets in a list is verified by
the order of letters: the rests after taking out the letter at its places are equal.
A list over ``LIST_MEMBERS`` is posted again under its members' rests, so that no task
holds more; its pairs stay whole.

Words come from the runs of letters of whole texts, counted within a document, then in
a task up to ``HELD_WORDS`` distinct ones, then by a shuffle. A word's form is its most
frequent near word, if that has at least ``RATIO`` times its occurrences; the root is
where forms lead, found by doubling steps, of which counts that grow by a factor need few.

Cases: a null text has no runs, an empty one neither; a null id counts as empty in
the hash; a very long text is read whole, match by match; repeated rows count each time;
ties go to the smaller word; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import durable, map_arrow, quoted, scratch, sized_broadcast

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
POWER, MODULUS = 5, 1 << 64
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
DELETED_ONE_IN = 97
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 500_000
#: Members of a list that are compared in one task.
LIST_MEMBERS = 50_000
ROWS = 20_000


def corrupted(doc_id: object, run: str, one_in: int) -> str:
    """The run, without one of its letters where the hash of id and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = DELETED_ONE_IN, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all texts, lower-cased in A-Z. With ``one_in``, one run in so
    many has lost a letter first, as a test of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            held.clear()
            for i in range(0, len(items), ROWS):
                words, counts = zip(*items[i : i + ROWS], strict=True)
                yield pa.record_batch([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                doc_id = ids[i].as_py()
                for raw, n in Counter(m.group() for m in RUN.finditer(text)).items() if len(text) > 1 << 22 else Counter(RUN.findall(text)).items():
                    word = raw.translate(LOWER)
                    if one_in:
                        word = corrupted(doc_id, word, one_in)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield from out()
        yield from out()

    named = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return map_arrow(named, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _signed(key: int) -> int:
    key %= MODULUS
    return key - MODULUS if key >= MODULUS >> 1 else key


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_POSTED = "list long, word string, n long, letter string, place int"
_POSTED_ARROW = pa.schema([("list", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("letter", pa.string()), ("place", pa.int32())])


def postings(words: DataFrame) -> DataFrame:
    """Each word under its own key (letter null) and under its key less each letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                letters = Counter(word)
                key = sum(ord(c) ** POWER * k for c, k in letters.items())
                rows.append((_signed(key), word, n, None, None))
                rows.extend((_signed(key - ord(c) ** POWER), word, n, c, None) for c in letters)
                if len(rows) >= ROWS:
                    yield _batch(rows, _POSTED_ARROW)
                    rows = []
        if rows:
            yield _batch(rows, _POSTED_ARROW)

    return map_arrow(words, run, _POSTED)


def rests(word: str, letter: str, place: int | None) -> Iterator[tuple[int, str]]:
    """The word without that letter, at the place or at each of its places."""
    if place is not None:
        yield place, word[:place] + word[place + 1 :]
        return
    at = word.find(letter)
    while at >= 0:
        yield at, word[:at] + word[at + 1 :]
        at = word.find(letter, at + 1)


def near_in(members: Iterable[tuple[str, int, str | None, int | None]]) -> dict[str, tuple[int, int, str]]:
    """Of one list: each word's number of near words in it, and the most frequent one."""
    counts: dict[str, int] = {}
    whole: set[str] = set()
    same_rest: defaultdict[tuple[int, str], set[str]] = defaultdict(set)
    for word, n, letter, place in members:
        counts[word] = n
        if letter is None:
            whole.add(word)
        else:
            for at, rest in rests(word, letter, place):
                same_rest[at, rest].add(word)
    found: dict[str, tuple[int, int, str]] = {}

    def add(word: str, other: str) -> None:
        total, best, name = found.get(word, (0, 0, ""))
        if (-counts[other], other) < (-best, name):
            best, name = counts[other], other
        found[word] = total + 1, best, name

    shortened: set[tuple[str, str]] = set()
    for (_, rest), group in same_rest.items():
        if len(group) > 1:
            for word in group:
                for other in group:
                    if word != other:
                        add(word, other)
        if rest in whole:
            shortened.update((word, rest) for word in group)
    for word, rest in shortened:  # a letter out of a run of equal ones leaves one rest at several places
        add(word, rest)
        add(rest, word)
    return found


_FOUND = f"near struct<word:string,n_near:long,best_n:long,best:string>, again struct<{', '.join(p.replace(' ', ':') for p in _POSTED.split(', '))}>"
_NEAR_ARROW = pa.struct([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
_FOUND_ARROW = pa.schema([("near", _NEAR_ARROW), ("again", pa.struct(list(_POSTED_ARROW)))])


def _lists(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[list[tuple], bool]]:
    """Members of each list of sorted rows, and whether these are all of them: a list
    over ``most`` comes in parts."""
    held: list[tuple] = []
    current, parted = None, False
    for batch in batches:
        keys = batch.column("list").to_numpy()
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        columns = [batch.column(c) for c in ("word", "n", "letter", "place")]
        start = 0
        for end in ends:
            if keys[start] != current:
                if held:
                    yield held, not parted
                held, current, parted = [], keys[start], False
            while start < end:
                step = min(end - start, (most or end) - len(held)) if most else end - start
                held.extend(zip(*(c.slice(start, step).to_pylist() for c in columns), strict=True))
                start += step
                if most and len(held) >= most and start <= end:
                    parted = True
                    yield held, False
                    held = []
    if held:
        yield held, not parted


def _compare(posted: DataFrame, most: int | None) -> DataFrame:
    """``near`` for the members of lists, ``again`` for those of lists over ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[dict] = []
        again: list[dict] = []

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if len(near) + len(again) >= least:
                rows = pa.array([*near, *[None] * len(again)], _NEAR_ARROW), pa.array([*[None] * len(near), *again], _FOUND_ARROW.field("again").type)
                near.clear()
                again.clear()
                yield pa.record_batch(list(rows), schema=_FOUND_ARROW)

        for members, complete in _lists(batches, most):
            if complete:
                if len(members) > 1:
                    near.extend({"word": w, "n_near": k, "best_n": n, "best": b} for w, (k, n, b) in near_in(members).items())
            else:
                for word, n, letter, place in members:
                    for at, rest in [(None, word)] if letter is None else rests(word, letter, place):
                        again.append({"list": xxhash.xxh64_intdigest(rest.encode()) - (MODULUS >> 1), "word": word, "n": n, "letter": letter, "place": at})
                    yield from out(ROWS)
            yield from out(ROWS)
        yield from out(1)

    # One list's members stand together; an own shuffle for them, as words are few beside texts.
    return map_arrow(posted.repartition("list").sortWithinPartitions("list"), run, _FOUND)


def near_words(words: DataFrame, list_members: int = LIST_MEMBERS) -> DataFrame:
    """word, n_near, best (the near word of largest n, then smallest), best_n, of the
    words that have any."""
    found = durable(_compare(postings(words), list_members), "near-words")
    rows = found.select("near.*").where("word is not null")
    again = found.select("again.*").where("word is not null")
    if not again.isEmpty():
        rows = rows.unionByName(_compare(again, None).select("near.*").where("word is not null"))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("first")).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.minus")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the words of ``forms`` (word, form) lead."""
    now = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = durable(now.join(sized_broadcast(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return now
        now = step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, list_members: int = LIST_MEMBERS) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words."""
    with scratch() as made:
        words = durable(word_counts(docs, id_col, text_col, one_in, min_length, min_count), "words")
        near = words.join(near_words(words, list_members), "word", "left")
        taken = F.col("best_n") >= ratio * F.col("n")
        told = durable(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")), "variants")
        ends = sized_broadcast(roots(told.where("form is not null").select("word", "form")))
        return made.keep(durable(told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling"))
