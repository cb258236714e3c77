"""SimHash near-dedup with an inverted index over byte positions.

A fingerprint has eight bytes. Two that differ in at most two bits share at
least six of them, position by position: the guaranteed minimum of matches. A
posting list of one byte would hold 1/256 of all fingerprints, and tallying its
pairs would grow with their square, so lists are of four positions: the eight
make four columns of two neighbours, a link leaves two columns whole at least,
and a fingerprint is posted under each choice of two. Pairs that meet in a list
are tallied by the bytes they share at all eight positions; those that reach six
are verified bit by bit. A list over ``LIST_MEMBERS`` is posted again under each
choice of two more positions, of which a link must share two; such lists differ
in two bytes only, so they hold at most 65,536 distinct fingerprints and their
links are looked up. What leaves a list is a forest that keeps its links'
components, not pairs.

Cases: a null or empty text has fingerprint zero, which links like any other; a
text shorter than a shingle is one shingle; a very long text is read whole, its
hashes held at eight bytes a word; repeated rows share a fingerprint; rows that
repeat an id each have a result; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import durable, map_arrow, quoted, scratch, sized_broadcast, slices, texts_of, without
from quillstone.operators.components import connected_components

BITS, MAX_BITS, SEED = 64, 2, 42
POSITIONS = BITS // 8
#: Byte positions that two fingerprints must share at least.
MATCHES = POSITIONS - MAX_BITS
#: Free positions of the lists of six, and changes of at most MAX_BITS of their 16 bits.
FREE = list(combinations(range(POSITIONS), MAX_BITS))
FLIPS = [1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)]
#: Positions of the lists of four: two of the four columns.
CHOICES = [(*range(2 * a, 2 * a + 2), *range(2 * b, 2 * b + 2)) for a, b in combinations(range(POSITIONS // 2), 2)]
#: Members of a list of four whose pairs are tallied.
LIST_MEMBERS = 256


def mask(positions: Iterable[int]) -> int:
    """The bits of some byte positions, as a signed long."""
    bits = sum(0xFF << 8 * p for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


#: Bits of the lists of four; bits of the lists of six, and which ones a list of four becomes.
FOUR = [mask(c) for c in CHOICES]
SIX = [mask(set(range(POSITIONS)) - set(free)) for free in FREE]
LONGER = [[i for i, six in enumerate(SIX) if four & ~six == 0] for four in FOUR]


def shingles(text: str, words: int) -> list[bytes]:
    """Runs of ``words`` words, ASCII lower case, joined by a space, repeats
    included; of a text with fewer words, all of them; of one without, none."""
    tokens = text.encode().lower().split()
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    return [line[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = 3, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    parts = shingles(text, words)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(p, seed) for p in parts), np.uint64, len(parts)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = SEED) -> DataFrame:
    """id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(t or "", words, seed) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.record_batch([part.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = texts_of(docs, id_col, text_col)
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").select(F.col("id").alias(id_col), "fp")


def _free_bits(fps: np.ndarray, free: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, p in enumerate(free):
        out |= ((fps >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << 8 * k
    return out


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs that connect whatever ``pairs`` of 0 to n - 1 connect."""
    label = np.arange(n)
    while True:  # smallest position reached, with jumps
        least = label.copy()
        np.minimum.at(least, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], label[pairs[:, 0]])
        least = least[least]
        if (least == label).all():
            break
        label = least
    inner = np.flatnonzero(label != np.arange(n))
    return np.stack([inner, label[inner]], axis=1)


def tallied(fps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Forest of the links inside posting lists, which ``bounds`` (ending with the
    length) cut ``fps`` into: pairs are tallied by shared bytes, then verified."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    found = []
    here = np.arange(len(fps))
    for lag in range(1, int(np.diff(bounds).max(initial=0))):
        here = here[here + lag < ends[here]]
        apart = fps[here] ^ fps[here + lag]
        tally = (apart.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
        enough = np.flatnonzero(tally >= MATCHES)
        enough = enough[np.bitwise_count(apart[enough]) <= MAX_BITS]
        if len(enough):
            found.append(np.stack([here[enough] + lag, here[enough]], axis=1))
    return _forest(np.concatenate(found), len(fps)) if found else np.zeros((0, 2), np.int64)


def looked_up(fps: np.ndarray, bounds: np.ndarray, free: tuple[int, ...]) -> np.ndarray:
    """The same for lists of six positions, by looking each change of the free ones up."""
    found = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = _free_bits(fps[low:high], free)
        at = np.full(1 << 16, -1, np.int64)
        at[bits] = np.arange(high - low)
        for flip in FLIPS:
            other = at[bits ^ flip]
            here = np.flatnonzero(other > np.arange(high - low))
            if len(here):
                found.append(np.stack([other[here], here], axis=1) + low)
    return _forest(np.concatenate(found), len(fps)) if found else np.zeros((0, 2), np.int64)


def _linked(posted: DataFrame, masks: list[int], find: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Links a, b of posting lists (rows choice, posting, fp), list by list."""
    lists = posted.repartition("choice", "posting").sortWithinPartitions("choice", "posting").select("choice", "fp")
    bits = np.array(masks, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def found(choice: np.ndarray, fp: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, int]:
            """Links of the complete lists, and where the unfinished one begins."""
            key = fp & bits[choice]
            cut = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], cut, [len(fp)]] if last else [[0], cut])
            out = []
            for c in np.unique(choice[bounds[:-1]]):
                own = np.flatnonzero((choice[bounds[:-1]] == c) & (np.diff(bounds) > 1))
                if len(own):
                    parts = [fp[bounds[i] : bounds[i + 1]] for i in own]
                    members = np.concatenate(parts)
                    out.append(members[find(int(c), members, np.cumsum([0, *map(len, parts)]))])
            pairs = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
            rows = pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"]) if len(pairs) else None
            return rows, int(bounds[-1])

        for batch in batches:
            choice = np.concatenate([rest[0], batch.column("choice").to_numpy().astype(np.int64)])
            fp = np.concatenate([rest[1], batch.column("fp").to_numpy().view(np.uint64)])
            if not len(fp):
                continue
            out, at = found(choice, fp, False)
            rest = choice[at:], fp[at:]
            if out is not None:
                yield out
        if len(rest[1]):
            out, _ = found(*rest, True)
            if out is not None:
                yield out

    return map_arrow(lists, run, "a long, b long")


def _posted(fps: DataFrame, masks: Column) -> DataFrame:
    rows = fps.select("fp", F.explode(masks).alias("m"))
    return rows.select("fp", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("posting"))


def _masks(choices: Iterable[int], masks: list[int]) -> Column:
    return F.array(*(F.struct(F.lit(i).cast("byte").alias("choice"), F.lit(masks[i]).cast("long").alias("mask")) for i in choices))


def links(fps: DataFrame) -> DataFrame:
    """Verified links between distinct values of ``fp``, as a forest of each
    posting list: columns a and b."""
    posted = _posted(fps, _masks(range(len(FOUR)), FOUR))
    # Counted with partial sums, so a list that holds a third of all costs a row a task.
    wide = durable(posted.groupBy("choice", "posting").agg(F.count("*").alias("n")).where(F.col("n") > LIST_MEMBERS).select("choice", "posting"), "wide-lists")
    if wide.isEmpty():
        return _linked(posted, FOUR, lambda _, members, bounds: tallied(members, bounds))
    known = sized_broadcast(wide)
    usual = _linked(posted.join(known, ["choice", "posting"], "left_anti"), FOUR, lambda _, members, bounds: tallied(members, bounds))
    longer = F.element_at(F.array(*(_masks(six, SIX) for six in LONGER)), F.col("choice").cast("int") + 1)
    again = _posted(posted.join(known, ["choice", "posting"], "left_semi").select("fp", "choice"), longer).distinct()
    return usual.unionByName(_linked(again, SIX, lambda c, members, bounds: looked_up(members, bounds, FREE[c])))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = SEED) -> DataFrame:
    """id, fp, component_id: the smallest id that a document's links reach."""
    fps = durable(fingerprints(docs, id_col, text_col, words, seed).toDF("id", "fp"), "fingerprints")
    distinct = durable(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    found = connected_components(links(distinct.select("fp")))
    joined = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.join(smallest, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# Similarity of five-word shingles: exact Jaccard of their sets. The sets' SimHash
# fingerprints meet in the lists of byte positions above, and each pair that keeps the
# least number of matches is verified by the exact Jaccard. Sets of resemblance t may
# still differ in any number of fingerprint bits, so an exact way finds the rest: each
# of two such sets has all but a share 1 - t of its shingles in the
# other, so under any one order of all shingles their prefixes of that share, and
# one more, meet. A shingle of the prefixes is a posting list; the order puts
# shingles that a sample finds common last, which keeps lists short and changes no
# result. A first round verifies each list's rows against its smallest row, which
# joins dense groups; a second one all pairs of a list that no link connects yet.
# Shingles are told apart by 64-bit hashes in lists, by their bytes in the check.

WIDE_WORDS, SIMILARITY = 5, 0.8
#: Longs of a parity table. Tables of two sets differ in at most as many bits as
#: the sets have shingles apart, so a pair that differs in more needs no check.
PARITY = 8
#: Members of a posting list that are compared at once.
WIDE_BLOCK = 2_048
#: One document of so many is asked for common shingles; occurrences there that
#: make one common, and how many are put last at most.
SAMPLE, COMMON_LEAST, COMMON_MOST = 64, 4, 65_536
#: Shingles of recent texts that a task keeps for its next checks.
HELD_SHINGLES = 500_000
EPSILON = 1e-9


def shingle_hashes(text: str, words: int = WIDE_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted hashes of the set of shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = set(shingles(text, words))
    return np.unique(np.fromiter((digest(p, seed) for p in parts), np.uint64, len(parts)))


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, common ones last: of two similar sets, one at least is
    in both prefixes."""
    n = len(hashes)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = np.where(common[at] == hashes, ranks[at] + 1, 0)
        hashes = hashes[np.argsort(late, kind="stable")]
    return hashes[: n - int(np.ceil(similarity * n - EPSILON)) + 1]


def parity(hashes: np.ndarray, places: int = 64 * PARITY) -> np.ndarray:
    """Parity of the number of hashes at each of ``places``, a power of two, in bytes."""
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8))


def wide_parity(hashes: np.ndarray) -> bytes:
    """Parity at over four places for each hash, which is folded to compare."""
    return parity(hashes, 1 << max(9, (4 * len(hashes)).bit_length())).tobytes()


def parity_apart(a: bytes, b: bytes) -> int:
    """Differing bits at the fewer places of the two."""
    least = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(t, np.uint8).reshape(-1, least), axis=0) for t in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their ranks, at most COMMON_MOST, of rows id, text; only the
    order of prefixes depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_hashes(t or "", words) for t in part.column("text").to_pylist()]
                yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64))], ["hash"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text")
    counts = map_arrow(some, run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_LEAST)
    rows = counts.orderBy(F.desc("n"), "hash").limit(COMMON_MOST).collect()
    found = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(rows) - 1 - np.arange(len(rows)))[order]


PARITIES = [f"p{i}" for i in range(PARITY)]


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """id, sig (a digest of the set), size, prefix, the parity tables and fp, the set's
    fingerprint."""
    rows = texts_of(docs, id_col, text_col)
    common, ranks = common_shingles(rows, words)
    known = docs.sparkSession.sparkContext.broadcast((common, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_hashes(t or "", words) for t in part.column("text").to_pylist()]
                sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                first = [prefix(s, *known.value, similarity).view(np.int64) for s in sets]
                tables = np.stack([parity(s).view(np.int64) for s in sets])
                fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                columns = [pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array([wide_parity(s) for s in sets], pa.binary()), pa.array(fps)]
                yield pa.record_batch([part.column("id"), *columns, *(pa.array(tables[:, i]) for i in range(PARITY))], ["id", "sig", "size", "prefix", "wide", "fp", *PARITIES])

    kinds = ", ".join(f"{p} long" for p in PARITIES)
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, sig binary, size long, prefix array<long>, wide binary, fp long, {kinds}")


def _near(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b that size and parity do not rule out."""
    sides = [classes.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), *(F.col(p).alias(f"{s}_{p}") for p in PARITIES)) for s in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b")
    apart = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES[1:]), F.bit_count(F.col(f"a_{PARITIES[0]}").bitwiseXOR(F.col(f"b_{PARITIES[0]}"))))
    fits = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * similarity - EPSILON
    return rows.where(fits & (apart <= (F.col("a_size") + F.col("b_size")) * ((1 - similarity) / (1 + similarity)) + EPSILON)).select("a", "b").distinct()


def _nearer(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b that wide parity does not rule out."""
    kind = pairs.schema["a"].dataType.simpleString()
    sides = [classes.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("wide").alias(f"{s}_wide")) for s in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", (F.col("a_size") + F.col("b_size")).alias("size"), "a_wide", "b_wide")
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, x, y = (batch.column(c).to_pylist() for c in ("size", "a_wide", "b_wide"))
            good = [i for i, n in enumerate(sizes) if parity_apart(x[i], y[i]) <= n * share + EPSILON]
            if good:
                yield batch.select(["a", "b"]).take(pa.array(good))

    return map_arrow(rows, run, f"a {kind}, b {kind}").distinct()


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b whose texts (``node, text``) are similar."""
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = durable(_nearer(pairs, classes, similarity), "candidates")
    asked = durable(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "asked")
    some = texts.join(sized_broadcast(asked), "node", "left_semi")
    rows = pairs.join(some.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b").join(some.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset] = {}
        held = 0

        def of(text: str) -> frozenset:
            nonlocal held
            if text not in known:
                found = frozenset(shingles(text, words))
                if held + len(found) > HELD_SHINGLES:
                    known.clear()
                    held = 0
                known[text] = found
                held += len(found)
            return known[text]

        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].as_py() or "" for c in ("a_text", "b_text"))
                if jaccard(of(a), of(b)) >= similarity:
                    good.append(i)
            if good:
                yield batch.select(["a", "b"]).take(pa.array(good))

    return durable(map_arrow(rows.select("a", "b", "a_text", "b_text"), run, f"a {kind}, b {kind}").distinct(), "similar")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each maximal run of equal values of integer ``keys`` in sorted batches."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            new |= column[1:] != column[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[0].column(k)[0] == batch.column(k)[-1] for k in keys):
            held.append(batch)  # a long run is put together once, at its end
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        bounds = cut(table)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(bounds[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = [*cut(table), table.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield table.slice(a, b - a)


def _compared(table: pa.Table, own: np.ndarray, low: int, high: int, share: float, similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs of a list's rows in block ``low`` with those in block ``high`` that may
    be similar, and are in different components."""
    nodes, sizes = table.column("node").combine_chunks(), table.column("size").to_numpy()
    parts = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    bits = np.stack([table.column(p).to_numpy() for p in PARITIES], axis=1).view(np.uint64)
    first, second, held = [], [], 0
    for i in range(len(nodes) - 1):
        least = np.minimum(sizes[i], sizes[i + 1 :]) >= np.maximum(sizes[i], sizes[i + 1 :]) * similarity - EPSILON
        rest = np.flatnonzero((parts[i + 1 :] != parts[i]) & least & ((own[i + 1 :] != own[i]) | (low == high))) + i + 1
        if len(rest):
            apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            rest = rest[apart <= (sizes[rest] + sizes[i]) * share + EPSILON]
        first.append(np.full(len(rest), i))
        second.append(rest)
        held += len(rest)
        if held and (held > 8192 or i == len(nodes) - 2):
            yield pa.record_batch([nodes.take(pa.array(np.concatenate(x))) for x in (first, second)], ["a", "b"])
            first, second, held = [], [], 0


def _across(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each list's rows (``list, node, component, size``, parity) in
    different components that size and parity do not rule out."""
    kind = rows.schema["node"].dataType.simpleString()
    share = (1 - similarity) / (1 + similarity)
    # A list over WIDE_BLOCK is dealt into blocks; each two of them meet in a group of their own.
    blocks = F.ceil(F.col("n") / WIDE_BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "list"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["list", "low", "high"]):
            yield from _compared(table, table.column("own").to_numpy(), table["low"][0].as_py(), table["high"][0].as_py(), share, similarity)

    keys = ["list", "low", "high"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(dealt.select(*keys, "own", "node", "component", "size", *PARITIES), run, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs a, b of ``classes`` (node, fp) that connect whatever equal and linked
    fingerprints connect."""
    first = durable(classes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprint-classes")
    same = classes.join(first, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    sides = [first.select(F.col("fp").alias(f"{s}_fp"), F.col("least").alias(s)) for s in "ab"]
    met = links(first.select("fp")).toDF("a_fp", "b_fp").join(sides[0], "a_fp").join(sides[1], "b_fp")
    return same.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def similar_links(classes: DataFrame, texts: DataFrame, words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links a, b that connect whatever pairs of ``classes`` (node and profile) at
    that similarity connect; ``texts`` has node and text."""
    posted = classes.select("node", F.explode("prefix").alias("list"))
    roots = posted.groupBy("list").agg(F.min("node").alias("root"), F.max("node").alias("top"), F.count("*").alias("n")).where("root != top")
    lists = durable(posted.join(roots.select("list", "root", "n"), "list"), "posting-lists")
    stars = _near(lists.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct(), classes, similarity)
    near = _near(fingerprint_pairs(classes), classes, similarity).unionByName(stars).distinct()
    joined = durable(connected_components(verified(near, classes, texts, words, similarity)), "joined")
    # In a list of two, that was the only pair.
    told = lists.where("n > 2").select("list", "node").join(joined, "node", "left").select("list", "node", F.coalesce("component", "node").alias("component"))
    told = durable(told, "told")
    several = told.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low != high").select("list", "n")
    rows = told.join(several, "list").join(classes.select("node", "size", *PARITIES), "node")
    more = verified(_across(rows, similarity), classes, texts, words, similarity)
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """id and component_id, the smallest id reached, of each row with an id."""
    docs = docs.where(quoted(id_col).isNotNull())
    sets = durable(profiles(docs, id_col, text_col, words, similarity), "profiles")
    classes = durable(sets.groupBy("sig").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("size", "prefix", "wide", "fp", *PARITIES))), "classes")
    texts = docs.select(quoted(id_col).alias("node"), quoted(text_col).alias("text"))
    found = connected_components(similar_links(classes, texts, words, similarity))
    joined = classes.join(found, "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
    return sets.select("id", "sig").join(joined, "sig").select(F.col("id").alias(id_col), "component_id")


def near_deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the smallest id of each group of similar texts, all columns
    kept; rows without an id stay, and rows that repeat an id stay or go together."""
    with scratch() as made:
        gone = representatives(docs, id_col, text_col, words, similarity).where(quoted(id_col) != F.col("component_id")).select(quoted(id_col).alias("id")).distinct()
        gone = made.keep(durable(gone, "near-copies"))
    return without(docs, gone, id_col)
