"""Checks that promoted records say what their candidates said, and nothing else."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.storage import durable, ship, sized_broadcast
from quillstone.functions.udf import vectorized
from quillstone.operators.components import connected_components
from quillstone.operators.relational import row_batches


def identity(text: Column) -> Column:
    """Collapsed white space, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def coverage_errors(candidates: DataFrame, drafts: DataFrame) -> DataFrame:
    """candidate_id, uses, error of candidates not used exactly once. ``drafts`` has
    draft_id, source_candidate_ids."""
    used = drafts.select(F.explode("source_candidate_ids").alias("candidate_id")).groupBy("candidate_id").agg(F.count("*").alias("uses"))
    both = candidates.select("candidate_id", F.lit(True).alias("known")).join(used, "candidate_id", "full")
    error = F.when(F.col("known").isNull(), "UNKNOWN_CANDIDATE").when(F.col("uses").isNull(), "UNUSED_CANDIDATE").when(F.col("uses") > 1, "CANDIDATE_REUSED")
    return both.select("candidate_id", F.coalesce("uses", F.lit(0).cast("long")).alias("uses"), error.alias("error")).where("error is not null")


def record_errors(candidates: DataFrame, drafts: DataFrame, same: Sequence[str], text: str, links: Sequence[str], active: DataFrame) -> DataFrame:
    """draft_id, error. Drafts must keep the columns ``same`` and the identity of
    ``text`` of every candidate, and for each of ``links`` exactly the union of
    their evidence, all of it active."""
    cut = drafts.select("draft_id", *dict.fromkeys((*same, text, *links)), F.explode("source_candidate_ids").alias("candidate_id"))
    c = candidates.select("candidate_id", *(F.col(x).alias(f"c_{x}") for x in dict.fromkeys((*same, text, *links))))
    changed = {x: ~F.col(x).eqNullSafe(F.col(f"c_{x}")) for x in same} | {text: ~identity(F.col(text)).eqNullSafe(identity(F.col(f"c_{text}")))}
    union = lambda x: F.sort_array(F.array_distinct(F.flatten(F.collect_list(f"c_{x}"))))
    rules = [F.max(broken).alias(f"r{i}") for i, broken in enumerate(changed.values())]
    lists = [x for i, name in enumerate(links) for x in (union(name).alias(f"e{i}"), F.sort_array(F.array_distinct(F.first(name))).alias(f"g{i}"))]
    found = cut.join(c, "candidate_id").groupBy("draft_id").agg(*rules, *lists)
    differ = {x: ~F.col(f"e{i}").eqNullSafe(F.col(f"g{i}")) for i, x in enumerate(links)}
    broken = {x: F.col(f"r{i}") for i, x in enumerate(changed)} | differ
    errors = F.array_compact(F.array(*(F.when(rule, f"CHANGED_{x.upper()}") for x, rule in broken.items())))
    # The candidates are joined and dealt once; what is left of them is small, and read twice.
    drawn = durable(found.select("draft_id", errors.alias("errors"), F.array_distinct(F.flatten(F.array(*(F.col(f"e{i}") for i in range(len(links)))))).alias("evidence")), "draft-checks")
    ids = drawn.select("draft_id", F.explode("evidence").alias("evidence_id"))
    lost = ids.join(active.select("evidence_id").distinct(), "evidence_id", "left_anti").select("draft_id", F.lit("INACTIVE_EVIDENCE").alias("error")).distinct()
    return drawn.select("draft_id", F.explode("errors").alias("error")).unionByName(lost)


def claim_errors(candidates: DataFrame, drafts: DataFrame, active: DataFrame) -> DataFrame:
    return record_errors(candidates, drafts, ["status"], "text", ["supporting_evidence_ids", "contradicting_evidence_ids"], active)


def timeline_errors(candidates: DataFrame, drafts: DataFrame, active: DataFrame) -> DataFrame:
    return record_errors(candidates, drafts, ["occurred_at", "time_precision"], "description", ["evidence_ids"], active)


def entity_components(names: DataFrame, by: str = "draft_id", member: str = "candidate_id", name: str = "name") -> DataFrame:
    """by, member, component: members of a group that share a name, directly or
    through others, are one component, called after its smallest member."""
    keyed = names.select(F.col(by).cast("string").alias("g"), F.col(member).cast("string").alias("m"), identity(F.col(name)).alias("n")).distinct()
    node = F.concat_ws("\x1f", "g", "m")
    hub = keyed.groupBy("g", "n").agg(F.min("m").alias("first"))
    edges = keyed.join(hub, ["g", "n"]).select(node.alias("a"), F.concat_ws("\x1f", "g", "first").alias("b"))
    part = lambda c, i: F.element_at(F.split(c, "\x1f"), i)
    return connected_components(edges).select(part(F.col("node"), 1).alias(by), part(F.col("node"), 2).alias(member), part(F.col("component"), 2).alias("component"))


@vectorized("long")
def name_components(sets: pd.Series) -> pd.Series:
    """Into how many components sets of names fall that are linked by shared names."""

    def one(names: Sequence[Sequence[str]]) -> int:
        above: dict[str, str] = {}

        def root(x: str) -> str:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for own in names:
            for x in own[1:]:
                above[root(x)] = root(own[0])
            if len(own):
                root(own[0])
        return sum(x == y for x, y in above.items())

    return sets.map(one)


def entity_errors(candidates: DataFrame, drafts: DataFrame) -> DataFrame:
    """draft_id, error. ``candidates`` has candidate_id, type, names (canonical
    first, then aliases); ``drafts`` has type, canonical_name, aliases."""
    key = F.col("draft_id").cast("string")
    joined = drafts.select(key.alias("g"), "type", F.explode("source_candidate_ids").alias("candidate_id")).join(candidates.select("candidate_id", F.col("type").alias("c_type"), "names"), "candidate_id")
    # A draft's candidates are one row of it already; so are their names.
    own = joined.select("g", (F.col("type") != F.col("c_type")).alias("changed"), F.transform("names", identity).alias("names"))
    known = own.groupBy("g").agg(F.max("changed").alias("changed"), F.collect_list("names").alias("sets"))
    known = known.select("g", "changed", name_components(F.transform("sets", lambda x: F.array_compact(x))).alias("n"), (F.size(F.flatten("sets")) > 0).alias("named"), F.array_sort(F.array_compact(F.array_distinct(F.flatten("sets")))).alias("known"))
    given = F.sort_array(F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), identity)))
    d = drafts.select(key.alias("draft_id"), identity(F.col("canonical_name")).alias("canonical"), given.alias("given"))
    both = d.join(known, F.col("draft_id").eqNullSafe(F.col("g")))
    spelled = F.col("named") & F.col("draft_id").isNotNull()
    rules = {"CHANGED_TYPE": F.col("changed"), "DISTINCT_IDENTITIES": F.col("n") > 1, "CANONICAL_NOT_SUPPLIED": spelled & ~F.array_contains("known", F.col("canonical")), "ALIASES_CHANGED": spelled & ~F.col("known").eqNullSafe(F.col("given"))}
    errors = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return both.select("draft_id", errors.alias("errors")).select("draft_id", F.explode_outer("errors").alias("error")).where("error is not null").distinct()


def first_spelling(names: DataFrame, by: str = "draft_id", member: str = "candidate_id") -> DataFrame:
    """by, identity, spelling: as the smallest member spells each name."""
    return names.groupBy(by, identity(F.col("name")).alias("identity")).agg(F.min_by("name", member).alias("spelling"))


def token_overlap(left: Column, right: Column) -> tuple[Column, Column]:
    """Shared and all distinct tokens of two token arrays; both empty: 1 and 1."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1).otherwise(F.size(F.array_intersect(left, right))), F.when(union == 0, 1).otherwise(union)


#: Buckets of the table of frequencies, and those that one row of it holds.
BUCKETS, BUCKETS_OF_A_ROW = 1 << 24, 1 << 16
#: Bits of a set's parity table, each whether an odd number of tokens has its hash: two
#: tables differ in no more bits than their sets in tokens.
PARITY_BITS = 512


def _frequencies(sets: DataFrame) -> Broadcast[bytes]:
    """How often the hashes of ``sets`` (hashes) of each bucket occur, as a byte: exactly up
    to 32, by twelfths of doublings beyond. It takes ``BUCKETS`` bytes of the driver."""
    bucket, n = F.pmod("h", F.lit(BUCKETS)), F.col("n")
    counts = sets.select(F.explode("hashes").alias("h")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    level = F.when(n <= 32, n).otherwise(F.least(F.lit(255), F.lit(32) + F.floor(12 * F.log2(n / 32)))).cast("int")
    cells = counts.select(F.floor(F.col("bucket") / BUCKETS_OF_A_ROW).cast("int").alias("row"), (F.col("bucket") % BUCKETS_OF_A_ROW).cast("int").alias("at"), level.alias("level"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (row, cell) in enumerate(zip(batch.column("row").to_pylist(), batch.column("cells"), strict=True)):
                held = np.zeros(BUCKETS_OF_A_ROW, np.uint8)
                held[cell.values.field("at").to_numpy()] = cell.values.field("level").to_numpy()
                yield pa.record_batch([pa.array([row], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["row", "held"])

    ship(sets.sparkSession)
    rows = cells.groupBy("row").agg(F.collect_list(F.struct("at", "level")).alias("cells")).mapInArrow(run, "row int, held binary").collect()
    held = bytearray(BUCKETS)
    for r in rows:
        held[r.row * BUCKETS_OF_A_ROW : (r.row + 1) * BUCKETS_OF_A_ROW] = r.held
    return sets.sparkSession.sparkContext.broadcast(bytes(held))


def _postings(sets: DataFrame, frequencies: Broadcast[bytes]) -> DataFrame:
    """list, id, size, place, short, bits: the lists of each of ``sets`` (id, hashes), which
    are its rarest hashes, made where the set is. A hash of one set alone needs no list."""
    mask = BUCKETS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(frequencies.value, np.uint8)
        for batch in batches:
            hashes = batch.column("hashes")
            sizes, flat = hashes.value_lengths().to_numpy().astype(np.int64), hashes.flatten().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            odd = np.bincount(owner * PARITY_BITS + (flat & (PARITY_BITS - 1)), minlength=len(sizes) * PARITY_BITS) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(len(sizes), PARITY_BITS), axis=1)
            often = level[flat & mask]
            order = np.lexsort((flat, often, owner))
            place, n = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes[owner]
            kept = np.flatnonzero((place < n + 1 - -(-3 * n // 4)) & (often[order] > 1))
            short = place < n + 1 - -(-6 * n // 7)
            tables = pa.array([b.tobytes() for b in bits], pa.binary()).take(pa.array(owner[kept]))
            columns = [pa.array(flat[order][kept]), batch.column("id").take(pa.array(owner[kept])), *(pa.array(c[kept].astype(np.int32)) for c in (n, place)), pa.array(short[kept]), tables]
            yield pa.record_batch(columns, ["list", "id", "size", "place", "short", "bits"])

    ship(sets.sparkSession)
    return sets.mapInArrow(run, "list long, id long, size int, place int, short boolean, bits binary")


#: Members of a list that are compared in one group; a longer list is dealt into blocks.
LIST_MEMBERS = 4096
_KEYS = ["list", "low", "high"]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each run of several equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] = ()

    def whole() -> Iterator[pa.Table]:
        if sum(b.num_rows for b in held) > 1:
            yield pa.Table.from_batches(held).combine_chunks()
        held.clear()

    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(k).to_numpy() for k in _KEYS])
            bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            if tuple(keys[:, 0]) != last:
                yield from whole()
            last = tuple(keys[:, -1])
            for a, b in zip(bounds[:-2], bounds[1:-1], strict=True):
                if held or b - a > 1:
                    held.append(batch.slice(a, b - a))
                    yield from whole()
            held.append(batch.slice(bounds[-2]))
    yield from whole()


def _meeting(posted: DataFrame) -> DataFrame:
    """a, b of the members of a list that size, place and parity don't rule out; the smaller is
    there by its short prefix. Two blocks of a long list meet in a group of their own."""
    long = posted.groupBy("list").agg(F.ceil(F.count("*") / LIST_MEMBERS).cast("int").alias("blocks")).where("blocks > 1")
    rows = posted.join(sized_broadcast(durable(long, "long-lists")), "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "list"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lists(batches):
            size, left, short, own = (table.column(c).to_numpy() for c in ("size", "left", "short", "own"))
            across = table["low"][0].as_py() != table["high"][0].as_py()
            bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(size), -1)
            ends = np.searchsorted(size * 3, size * 4)  # sizes are sorted
            first, second = [], []
            for i in np.flatnonzero(short & (ends > np.arange(len(size)) + 1)):
                j = slice(i + 1, ends[i])
                both = size[j] + size[i]
                fit = np.minimum(left[j], left[i]) * 7 > both * 3
                if across:
                    fit &= own[j] != own[i]
                some = np.flatnonzero(fit)
                some = some[np.bitwise_count(bits[j][some] ^ bits[i]).sum(axis=1, dtype=np.int64) * 7 < both[some]]
                if len(some):
                    first.append(np.full(len(some), i))
                    second.append(some + i + 1)
            if first:
                ids = table.column("id").to_numpy()
                one, two = ids[np.concatenate(first)], ids[np.concatenate(second)]
                yield pa.record_batch([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    ship(posted.sparkSession)
    dealt = rows.withColumn("left", F.col("size") - F.col("place")).drop("place").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "size")
    return dealt.mapInArrow(run, "a long, b long")


#: Sets of one block in which pairs are verified, and blocks that are made of fewer sets, so
#: that tasks share the work.
BLOCK_SETS, SPREAD = 4096, 8


def _grouped(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """list, low, high, a, b, tokens: the ``pairs`` (a, b), and the ``sets`` (id, tokens) as a,
    in groups in which two blocks of sets meet. A set goes once to each group in which it has
    pairs, not with each pair."""
    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired-sets")
    n = ids.count()
    blocks = max(-(-n // BLOCK_SETS), min(SPREAD, -(-n * SPREAD // BLOCK_SETS)), 1)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    pairs = pairs.select(F.lit(0).alias("list"), F.least(block("a"), block("b")).alias("low"), F.greatest(block("a"), block("b")).alias("high"), "a", "b")
    wanted = pairs.select(*_KEYS, F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = sets.join(sized_broadcast(ids), "id", "left_semi")
    given = wanted.join(texts, "id").select(*_KEYS, F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    return given.unionByName(pairs, allowMissingColumns=True)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared, total of the ``pairs`` (a, b) of ``sets`` (id, tokens) that overlap by
    over 3/4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lists(batches):
            n = table["b"].null_count
            own, ids = table.slice(0, n), table["a"].slice(0, n).to_numpy()
            tokens = own["tokens"].combine_chunks()
            sizes = tokens.value_lengths().to_numpy().astype(np.int64)
            coded = tokens.flatten().dictionary_encode("encode")
            codes, marked = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), bool)
            starts = np.cumsum(sizes) - sizes
            a, b = (np.searchsorted(ids, table[c].slice(n).to_numpy()) for c in ("a", "b"))
            shared, bounds = [], [*np.flatnonzero(np.diff(a, prepend=-1)), len(a)]
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                mine = codes[starts[a[x]] : starts[a[x]] + sizes[a[x]]]
                marked[mine] = True
                shared += [np.count_nonzero(marked[codes[starts[j] : starts[j] + sizes[j]]]) for j in b[x:y]]
                marked[mine] = False
            both = np.array(shared, np.int64)
            total = sizes[a] + sizes[b] - both
            good = np.flatnonzero(4 * both > 3 * total)
            yield pa.record_batch([pa.array(c[good]) for c in (ids[a], ids[b], both, total)], ["a", "b", "shared", "total"])

    ship(pairs.sparkSession)
    dealt = _grouped(pairs, sets).repartition(*_KEYS).sortWithinPartitions(*_KEYS, F.col("b").isNotNull(), "a")
    return dealt.mapInArrow(run, "a long, b long, shared long, total long")


def too_similar(drafts: DataFrame, by: str, id_col: str, tokens: str) -> DataFrame:
    """Pairs of a group's drafts whose overlap is over 3/4, with shared and total tokens.

    Equal sets are compared as one and their pairs told at the end. Of a set of n tokens,
    rarest first, any set with such an overlap has one among the first n - ceil(3n/4) + 1,
    and among the first n - ceil(6n/7) + 1 if it is no smaller. Of the sets that meet so,
    those are compared whose sizes, places of that token and parity tables allow it, which
    rules out no similar pair. Hashes of tokens and their frequencies choose who meets and
    decide nothing. Tokens are written once, and go only to where a set has pairs. Empty sets
    overlap wholly; a null set counts as empty; a group that is null has no pairs."""
    own = drafts.where(F.col(by).isNotNull() & F.col(id_col).isNotNull())
    own = own.select(F.col(by).alias("g"), F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.coalesce(F.col(tokens), F.array().cast("array<string>")))).alias("tokens"))
    own = durable(own.select("*", F.unhex(F.sha2(F.to_json("tokens"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "token-sets")
    # Equal sets are called after one of their rows; the others' are left out, which are fewer.
    called = F.min("row").over(W.partitionBy("g", "digest")).alias("set")
    members = durable(own.select("g", "id", "row", F.size("tokens").cast("long").alias("n"), called), "set-members")
    others = members.where("row <> set").select("row")
    sets = own.where("size(tokens) > 0").join(sized_broadcast(others), "row", "left_anti").select(F.col("row").alias("id"), "g", "tokens")
    hashes = F.transform("tokens", lambda t: F.xxhash64(F.col("g"), t)).alias("hashes")
    frequencies = _frequencies(sets.select(hashes))
    posted = durable(_postings(sets.select("id", hashes), frequencies), "token-prefixes")
    frequencies.unpersist()
    pairs = _meeting(posted).where("a <> b").distinct()
    alike = durable(_verified(durable(pairs, "token-pairs"), sets), "similar-sets")
    one, two = (members.select(F.col("set").alias(c), F.col("g").alias(f"g{c}"), F.col("id").alias(id_)) for c, id_ in (("a", "x"), ("b", "y")))
    across = alike.join(one, "a").join(two, "b").where("ga = gb and x <> y").select(F.col("ga").alias("g"), "x", "y", "shared", "total")
    n = F.greatest("n", F.lit(1).cast("long"))
    same = members.select("set", "g", F.col("id").alias("x"), n.alias("shared"), n.alias("total")).join(two.select(F.col("b").alias("set"), "y"), "set").where("x < y").select("g", "x", "y", "shared", "total")
    found = across.unionByName(same)
    return found.select(F.col("g").alias(by), F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "shared", "total")


def new_id(*parts: Column) -> Column:
    """An id made of what it stands for, in the form of a UUID."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def materialize_hypotheses(drafts: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hypotheses, claim links and questions of accepted drafts.

    ``drafts`` has investigation_id, case_id, model_run_id, draft_no, title,
    description, confidence, supporting_claim_ids, contradicting_claim_ids and
    unresolved_questions; ``claims`` has investigation_id, case_id, claim_id.
    Drafts with a claim that is not their investigation's are left out (``draft_errors``
    names them). Hypotheses start ACTIVE at their confidence, half to even at four
    places; links are ordered by hypothesis, claim and polarity, questions by their
    folded text."""
    context = ["investigation_id", "case_id"]
    keyed = drafts.withColumn("hypothesis_id", new_id(F.col("investigation_id").cast("string"), F.lit("hypothesis"), F.col("draft_no").cast("string")))
    named = keyed.select("hypothesis_id", *context, F.explode(F.concat("supporting_claim_ids", "contradicting_claim_ids")).alias("claim_id"))
    foreign = named.join(claims.select(*context, "claim_id").distinct(), [*context, "claim_id"], "left_anti").select("hypothesis_id").distinct()
    good = keyed.join(foreign, "hypothesis_id", "left_anti")
    confidence = F.bround(F.col("confidence").cast("string").cast("decimal(38,18)"), 4).cast("decimal(5,4)")
    hypotheses = good.select("hypothesis_id", *context, "model_run_id", "title", "description", confidence.alias("initial_confidence"), confidence.alias("current_confidence"), F.lit("ACTIVE").alias("status"))
    links = hypothesis_links(good).withColumn("link_no", F.row_number().over(W.partitionBy("hypothesis_id").orderBy("claim_id", "polarity")))
    asked = good.select("hypothesis_id", *context, F.explode("unresolved_questions").alias("text"))
    questions = asked.withColumn("question_no", F.row_number().over(W.partitionBy("hypothesis_id").orderBy(identity(F.col("text")), "text")))
    return hypotheses, links, questions


def hypothesis_links(drafts: DataFrame) -> DataFrame:
    """hypothesis_id, claim_id, polarity."""
    side = lambda c, p: drafts.select("hypothesis_id", F.explode(c).alias("claim_id"), F.lit(p).alias("polarity"))
    return side("supporting_claim_ids", "SUPPORTING").unionByName(side("contradicting_claim_ids", "CONTRADICTING"))


def materialize_critiques(drafts: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Critiques and their pending tests. ``drafts`` has hypothesis_id,
    investigation_id, case_id, model_run_id, critique_confidence,
    strongest_contradiction_id and proposed_tests (array of struct: type, strength,
    execution_kind, parameters, evidence_ids, claim_ids); ``jobs`` has hypothesis_id and
    job_id. A test has no model run until it is executed."""
    keyed = drafts.withColumn("critique_id", new_id(F.col("hypothesis_id").cast("string"), F.lit("critique"))).join(jobs.select("hypothesis_id", "job_id"), "hypothesis_id")
    confidence = F.bround(F.col("critique_confidence").cast("string").cast("decimal(38,18)"), 4).cast("decimal(5,4)")
    context = ["hypothesis_id", "investigation_id", "case_id"]
    critiques = keyed.select("critique_id", *context, "model_run_id", "strongest_contradiction_id", confidence.alias("critique_confidence"), F.size("proposed_tests").alias("tests"))
    each = keyed.select("critique_id", *context, "job_id", F.posexplode("proposed_tests").alias("test_no", "t"))
    tests = each.select(new_id(F.col("critique_id"), F.lit("test"), F.col("test_no").cast("string")).alias("test_id"), "critique_id", *context, "job_id", "test_no", "t.*", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("model_run_id"))
    return critiques, tests


def candidate_batch(pinned: DataFrame, claims: DataFrame, entities: DataFrame, timeline: DataFrame) -> DataFrame:
    """investigation_id, kind, batch_no, candidate_id, candidate, error: the pinned
    candidates in batches of three, each found in the table of its kind by id, case and
    model run. ``pinned`` has investigation_id, case_id, kind, candidate_id,
    model_run_id; the tables have id, case_id, model_run_id, candidate."""
    tables = [t.select(F.lit(kind).alias("kind"), F.col("id").alias("candidate_id"), "case_id", "model_run_id", "candidate") for kind, t in (("claim", claims), ("entity", entities), ("timeline", timeline))]
    known = tables[0].unionByName(tables[1]).unionByName(tables[2])
    batched = row_batches(pinned, ["investigation_id", "kind"], [F.col("candidate_id")])
    found = batched.join(known, ["kind", "candidate_id", "case_id", "model_run_id"], "left")
    return found.select("investigation_id", "kind", "batch_no", "candidate_id", "candidate", F.when(F.col("candidate").isNull(), "pinned candidate batch unavailable").alias("error"))


def draft_errors(drafts: DataFrame, claims: DataFrame, by: str = "investigation_id") -> DataFrame:
    """investigation, error: three to five drafts, known claims, four-place
    confidence in [0.05, 0.85]."""
    count = drafts.groupBy(by).agg(F.count("*").alias("n")).where("n < 3 or n > 5").select(by, F.lit("DRAFT_COUNT").alias("error"))
    ids = drafts.select(by, F.explode(F.concat("supporting_claim_ids", "contradicting_claim_ids")).alias("claim_id"))
    unknown = ids.join(claims.select("claim_id").distinct(), "claim_id", "left_anti").select(by, F.lit("UNKNOWN_CLAIM").alias("error"))
    c = F.col("confidence").cast("decimal(20,10)")
    value = drafts.where((c < 0.05) | (c > 0.85) | (c != F.round(c, 4))).select(by, F.lit("CONFIDENCE").alias("error"))
    return count.unionByName(unknown).unionByName(value).distinct()


def critique_errors(critiques: DataFrame, known: DataFrame) -> DataFrame:
    """critique_id, error: references must be known, one to five tests, pending.
    ``critiques`` has critique_id, reference_ids, tests array<struct<status>>."""
    ids = critiques.select("critique_id", F.explode("reference_ids").alias("id"))
    unknown = ids.join(known.select("id").distinct(), "id", "left_anti").select("critique_id", F.lit("UNKNOWN_REFERENCE").alias("error"))
    count = critiques.where(~F.size("tests").between(1, 5)).select("critique_id", F.lit("TEST_COUNT").alias("error"))
    ready = critiques.where(F.exists("tests", lambda t: t["status"] != "PENDING")).select("critique_id", F.lit("TEST_NOT_PENDING").alias("error"))
    return unknown.unionByName(count).unionByName(ready).distinct()
