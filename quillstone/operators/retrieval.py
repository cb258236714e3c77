"""Ranked evidence search, batched over a table of queries.

Documents become rows (doc, term, position); the terms of a query must all occur.
``config`` is ``english`` (stop words, stems) or ``simple`` (lower case only).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V
from quillstone.functions.english import STOP_WORDS, stem_words, tokens
from quillstone.functions.storage import durable, sized_broadcast
from quillstone.operators.relational import member_or_no_filter, within_optional

FTS_WEIGHTS = {"fts": "0.55", "entity": "0.20", "time": "0.15", "type": "0.10"}
HYBRID_WEIGHTS = {"vector": "0.35", "fts": "0.30", "entity": "0.15", "time": "0.12", "type": "0.08"}
DEFAULT_WEIGHT = 0.1  # of a term in cover density ranking


def positions(docs: DataFrame, id_col: str, text_col: str, config: str = "english") -> DataFrame:
    """id, term, position: an inverted index's rows. A stem is computed once for
    each distinct word."""
    words = docs.select(F.col(id_col), F.posexplode(tokens(F.col(text_col))).alias("position", "word"))
    if config == "simple":
        return words.select(id_col, F.col("word").alias("term"), (F.col("position") + 1).alias("position"))
    words = words.where(~F.col("word").isin(*sorted(STOP_WORDS)))  # the hottest words, before any exchange
    stems = durable(words.select("word").distinct().withColumn("term", stem_words("word")), "stems")
    return words.join(sized_broadcast(stems), "word").select(id_col, "term", (F.col("position") + 1).alias("position"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query_text", config: str = "english") -> DataFrame:
    """query_id, term, terms (how many distinct terms the query has)."""
    found = positions(queries, id_col, text_col, config).select(F.col(id_col).alias("query_id"), "term").distinct()
    return found.withColumn("terms", F.count("*").over(W.partitionBy("query_id")))


def hits(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, config: str = "english") -> DataFrame:
    """The rows of ``positions`` whose term is one of ``terms``.

    The corpus is never exchanged: its distinct words, with partial counts, meet the
    terms first, and the few words that become a term filter its tokens where they
    are (broadcast by their measured size)."""
    return _placed(docs, _forms(docs, terms, text_col, config), id_col, text_col)


def _forms(docs: DataFrame, terms: DataFrame, text_col: str, config: str) -> DataFrame:
    """word, term: the corpus's words that become one of ``terms``."""
    wanted = durable(terms.select("term").distinct(), "terms")
    if config == "simple":
        return wanted.select(F.col("term").alias("word"), "term")
    words = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("word")).distinct()
    return durable(words.withColumn("term", stem_words("word")).where("term is not null").join(sized_broadcast(wanted), "term"), "word-forms")


def _placed(docs: DataFrame, forms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col), F.posexplode(tokens(F.col(text_col))).alias("position", "word"))
    return rows.join(sized_broadcast(forms), "word").select(id_col, "term", (F.col("position") + 1).alias("position"))


def matches_in(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, config: str = "english") -> DataFrame:
    """``matches`` without an index: only documents that hold a query's rarest term are
    asked for its others and for positions, so common terms are never joined."""
    forms = _forms(docs, terms, text_col, config)
    each = docs.select(F.col(id_col), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("word"))
    held = each.join(sized_broadcast(forms), "word").select(id_col, "term")
    counts = held.groupBy("term").agg(F.count("*").alias("n"))
    rare = terms.join(counts, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    candidates = durable(held.join(sized_broadcast(durable(rare, "rarest")), "term").select("query_id", id_col).distinct(), "candidates")
    some = docs.join(sized_broadcast(candidates.select(id_col).distinct()), id_col, "left_semi")
    at = _placed(some, forms, id_col, text_col).groupBy(id_col, "term").agg(F.sort_array(F.collect_list("position")).alias("at"))
    hit = candidates.join(terms, "query_id").join(at, [id_col, "term"])
    found = hit.groupBy("query_id", id_col, "terms").agg(F.array_sort(F.collect_list(F.struct("term", "at"))).alias("hits"))
    return found.where(F.size("hits") == F.col("terms")).select("query_id", id_col, "hits")


def matches(index: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """query_id, id, hits: documents that have every term of a query, with the
    sorted positions of each term."""
    hit = index.join(terms, "term").groupBy("query_id", id_col, "term", "terms").agg(F.sort_array(F.collect_list("position")).alias("at"))
    found = hit.groupBy("query_id", id_col, "terms").agg(F.array_sort(F.collect_list(F.struct("term", "at"))).alias("hits"))
    return found.where(F.size("hits") == F.col("terms")).select("query_id", id_col, "hits")


def cover_density(hits: list[list[int]]) -> float:
    """Rank of minimal covers: each adds the terms' harmonic weight, divided by
    one more than the words in it that are no terms; normalised to rank / (1 + rank)."""
    events = sorted((p, k) for k, at in enumerate(hits) for p in at)
    last: dict[int, int] = {}
    total = 0.0
    for i, (p, k) in enumerate(events):
        last[k] = i
        if len(last) < len(hits):
            continue
        first = min(last.values())  # the narrowest cover that ends here
        size = i - first + 1
        noise = (p - events[first][0]) - (size - 1)
        total += DEFAULT_WEIGHT / (1 + max(0, noise))
        del last[events[first][1]]
    return total / (1 + total)


def rank_matches(found: DataFrame, id_col: str) -> DataFrame:
    """query_id, id, fts_score decimal(38,20), six significant digits."""
    kind = found.schema[id_col].dataType.simpleString()
    query = found.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [float(f"{cover_density([h['at'] for h in hits]):.6g}") for hits in b.column("hits").to_pylist()]
            yield pa.record_batch([b.column("query_id"), b.column(id_col), pa.array(scores, pa.float64())], ["query_id", id_col, "score"])

    scored = found.select("query_id", id_col, "hits").mapInArrow(run, f"query_id {query}, `{id_col}` {kind}, score double")
    return scored.select("query_id", id_col, F.col("score").cast("string").cast("decimal(38,20)").alias("fts_score"))


def entity_scores(links: DataFrame, wanted: DataFrame, id_col: str, scope: Sequence[str] = ()) -> DataFrame:
    """query_id, id, entity_score: the share of a query's entities that a document
    is linked to. ``wanted`` has query_id, entity_id; ``links`` has id, entity_id; both
    have the columns of ``scope``, in which they must agree."""
    of = wanted.distinct().withColumn("__n", F.count("*").over(W.partitionBy("query_id")))
    hit = of.join(links.select(id_col, "entity_id", *scope).distinct(), ["entity_id", *scope])
    return hit.groupBy("query_id", id_col, "__n").agg(F.count("*").alias("hit")).select("query_id", id_col, (F.col("hit").cast("decimal(38,0)") / F.col("__n")).cast("decimal(38,20)").alias("entity_score"))


#: Intervals that each event is compared with; of more, those of its bucket.
COMPARED_WINDOWS = 256


def time_hits(links: DataFrame, windows: DataFrame, id_col: str, buckets: int = 256, scope: Sequence[str] = (), compared: int = COMPARED_WINDOWS) -> DataFrame:
    """query_id, id of documents with a linked event inside the query's closed
    interval. ``links`` has id, occurred_at; ``windows`` has query_id, start_at,
    end_at; both have the columns of ``scope``, in which they must agree; queries
    without either end are left out.

    Up to ``compared`` intervals are broadcast and compared where the events are. Of more,
    times are cut into buckets of about equal rows, found by binary search, so an interval
    meets the buckets that it touches by an equal join, however many intervals there are."""
    w = windows.where("(start_at is not null or end_at is not null) and (start_at is null or end_at is null or start_at <= end_at)").select("query_id", *scope, "start_at", "end_at")
    timed = links.where("occurred_at is not null").select(id_col, *scope, "occurred_at")
    inside = within_optional(F.col("occurred_at"), F.col("start_at"), F.col("end_at"))
    if w.limit(compared + 1).count() <= compared:
        spread = F.broadcast(w.withColumnsRenamed({c: f"w_{c}" for c in scope}))
        for c in scope:
            inside &= F.col(c) == F.col(f"w_{c}")
        return timed.join(spread, inside).select("query_id", id_col).distinct()
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shares = [i / buckets for i in range(1, buckets)]
    edges = timed.agg(F.array_sort(F.array_distinct(F.percentile_approx(micros("occurred_at"), shares, 10_000)))).first()[0] or []
    placed = _with_bucket(timed.withColumn("__at", micros("occurred_at")), "__at", edges)
    ends = _with_bucket(_with_bucket(w.withColumns({"__a": F.coalesce(micros("start_at"), F.lit(-(1 << 62))), "__b": F.coalesce(micros("end_at"), F.lit(1 << 62))}), "__a", edges, "low"), "__b", edges, "high")
    spread = ends.select("query_id", *scope, "start_at", "end_at", F.explode(F.sequence("low", "high")).alias("bucket"))
    return placed.join(spread, ["bucket", *scope]).where(inside).select("query_id", id_col).distinct()


def _with_bucket(df: DataFrame, at: str, edges: Sequence[int], name: str = "bucket") -> DataFrame:
    """``df`` with the number of sorted ``edges`` up to each value, in place of the value:
    nested halves, so that a value meets a few edges only."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(at) < edges[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return df.withColumn(name, between(0, len(edges))).drop(at)


def weighted_score(components: dict[str, Column], weights: dict[str, str] = FTS_WEIGHTS) -> Column:
    """Exact weighted sum, rounded half up once to four places; null if a component
    is null or outside [0, 1]."""
    total, valid = None, F.lit(True)
    for name, weight in weights.items():
        c = F.coalesce(components[name], F.lit(None).cast("decimal(30,20)")) if name in components else F.lit(0).cast("decimal(30,20)")
        part = (c.cast("decimal(30,20)") * F.lit(weight).cast("decimal(2,2)")).cast("decimal(38,22)")
        total = part if total is None else (total + part).cast("decimal(38,22)")
        valid = valid & (c >= 0) & (c <= 1)
    return F.when(valid, F.round(total, 4).cast("decimal(5,4)"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def query_errors(queries: DataFrame) -> DataFrame:
    """query_id, error of queries that are no valid search: ``queries`` has query_id,
    intent, query_text, start_at, end_at, limit, config_version."""
    rules = {
        "BLANK_TEXT": ~F.coalesce(F.col("query_text").rlike(r"(?U)\S"), F.lit(False)), "NUL_TEXT": F.contains("query_text", F.lit("\0")), "LONG_TEXT": F.char_length("query_text") > 4096,
        "INTERVAL": F.col("end_at") < F.col("start_at"), "LIMIT": ~F.coalesce(F.col("limit").between(1, 50), F.lit(False)),
        "INTENT": ~F.coalesce(F.col("intent").isin("SUPPORT", "CONTRADICT", "NEUTRAL"), F.lit(False)), "CONFIG": ~F.col("config_version").eqNullSafe("fts-v1"),
    }
    return queries.select("query_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), n) for n, r in rules.items())))).alias("error"))


def normalized_queries(queries: DataFrame) -> DataFrame:
    """``queries`` with filter lists sorted and without repeats; null is no filter."""
    lists = ("evidence_types", "document_types", "entity_ids")
    return queries.withColumns({c: F.sort_array(F.array_distinct(F.coalesce(F.col(c), F.array().cast(queries.schema[c].dataType)))) for c in lists})


def searchable(role: str, membership: DataFrame, evidence: DataFrame, sources: DataFrame, completions: DataFrame) -> DataFrame:
    """investigation_id, id, observation, evidence_type, document_type of what a search
    may find: pinned evidence of the very run it was pinned with (no run equals no
    run), from an open source, reviewed, and of a completed unit or made without a
    model. ``role`` is that of the reader; only the blind role may search.

    ``membership`` has investigation_id, case_id, evidence_id, model_run_id; ``evidence``
    has id, case_id, model_run_id, source_document_id, structural_unit_id,
    review_status, extraction_method, type, observation; ``sources`` has id, case_id,
    visibility, document_type; ``completions`` has structural_unit_id, model_run_id."""
    if role != "blind":
        raise PermissionError("a search needs the blind role")
    m, e, s, c = membership.alias("m"), evidence.alias("e"), sources.alias("s"), completions.select("structural_unit_id", "model_run_id").distinct().alias("c")
    eq = lambda a, b: F.col(a) == F.col(b)
    rows = m.join(e, eq("m.evidence_id", "e.id") & eq("m.case_id", "e.case_id") & F.col("m.model_run_id").eqNullSafe(F.col("e.model_run_id")))
    rows = rows.join(s, eq("s.id", "e.source_document_id") & eq("s.case_id", "e.case_id")).join(c, eq("c.structural_unit_id", "e.structural_unit_id") & eq("c.model_run_id", "e.model_run_id"), "left")
    made = F.col("c.model_run_id").isNotNull() | (F.col("e.model_run_id").isNull() & F.col("e.extraction_method").isin("DETERMINISTIC", "HUMAN"))
    open_ = (F.col("s.visibility") == "INVESTIGATION_EVIDENCE") & F.col("e.review_status").isin("NOT_REQUIRED", "ACCEPTED") & made
    return rows.where(open_).select("m.investigation_id", "e.id", F.coalesce("e.observation", F.lit("")).alias("observation"), F.col("e.type").alias("evidence_type"), "s.document_type")


def scored(rows: DataFrame) -> DataFrame:
    """``rows`` (fts_score, entity_score and time_hit or null, evidence_type,
    document_type and a query's filters) that pass the filters, with the component
    scores, total_score and matched_filters. Filters that are empty neither boost nor
    exclude."""
    zero, one = (F.lit(x).cast("decimal(38,20)") for x in (0, 1))
    some = lambda c: F.size(c) > 0
    by_time = F.col("start_at").isNotNull() | F.col("end_at").isNotNull()
    rows = rows.where(member_or_no_filter(F.col("evidence_types"), F.col("evidence_type")) & member_or_no_filter(F.col("document_types"), F.col("document_type")))
    rows = rows.withColumns(
        {"entity_score": F.coalesce("entity_score", zero), "time_score": F.when(F.coalesce("time_hit", F.lit(False)), one).otherwise(zero), "type_score": F.when(some("evidence_types") | some("document_types"), one).otherwise(zero)}
    )
    rows = rows.where((~some("entity_ids") | (F.col("entity_score") > 0)) & (~by_time | (F.col("time_score") > 0)))
    filters = F.array_compact(F.array(F.when(some("evidence_types"), "evidence_type"), F.when(some("document_types"), "document_type"), F.when(some("entity_ids"), "entity"), F.when(by_time, "time")))
    return rows.withColumns({"total_score": weighted_score({k: F.col(f"{k}_score") for k in FTS_WEIGHTS}), "matched_filters": filters})


#: Results that a query may ask for.
MOST_RESULTS = 50


def ranked(rows: DataFrame, id_col: str) -> DataFrame:
    """The first ``limit`` rows (at most ``MOST_RESULTS``) of each query by total, then by
    each component, then by id, with their rank from 1. The constant bound lets a task keep
    only so many rows of a query before they are exchanged."""
    order = [F.desc(c) for c in ("total_score", "fts_score", "entity_score", "time_score", "type_score")]
    first = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order, F.asc(id_col)))).where(F.col("rank") <= MOST_RESULTS)
    return first.where(F.col("rank") <= F.col("limit")).withColumn("rank", F.col("rank").cast("long"))


def search(index: DataFrame | None, docs: DataFrame, queries: DataFrame, id_col: str, config: str = "english", entity_links: DataFrame | None = None, time_links: DataFrame | None = None, found: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Ranked results of all queries: query_id, rank, id, the component scores,
    total_score, matched_filters.

    ``index`` holds rows of ``positions`` or ``hits``, or ``found`` those of
    ``matches_in`` or of a stored index; ``docs`` (secured already) has
    id, evidence_type, document_type; ``queries`` has query_id, query_text,
    evidence_types, document_types, entity_ids, start_at, end_at, limit. All but ``found``
    have the columns of ``scope``, in which they must agree. ``search_index.evidence_search``
    is the whole search, with its guards."""
    queries = normalized_queries(queries)
    found = rank_matches(matches(index, query_terms(queries, config=config), id_col) if found is None else found, id_col)
    q = queries.select("query_id", *scope, "evidence_types", "document_types", "entity_ids", "start_at", "end_at", "limit")
    rows = found.join(q, "query_id").join(docs.select(id_col, *scope, "evidence_type", "document_type"), [id_col, *scope])
    if entity_links is not None:
        wanted = queries.select("query_id", *scope, F.explode("entity_ids").alias("entity_id"))
        rows = rows.join(entity_scores(entity_links, wanted, id_col, scope), ["query_id", id_col], "left")
    else:
        rows = rows.withColumn("entity_score", F.lit(None).cast("decimal(38,20)"))
    if time_links is not None:
        rows = rows.join(time_hits(time_links, queries, id_col, scope=scope).withColumn("time_hit", F.lit(True)), ["query_id", id_col], "left")
    else:
        rows = rows.withColumn("time_hit", F.lit(None).cast("boolean"))
    return ranked(scored(rows), id_col).select("query_id", "rank", id_col, "fts_score", "entity_score", "time_score", "type_score", "total_score", "matched_filters")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """query_id, id, cosine (rounded to six places), rank: the k nearest of all vectors
    for each of ``queries`` (rows like ``vectors``'), ties by id.

    Both sides are cut into blocks; each two blocks meet in one task as matrices, which
    keeps k candidates a query, so what is merged is blocks times k."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def blocks(rows: DataFrame, side: str) -> DataFrame:
        n = rows.count()
        number = F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-n // block))))
        return rows.groupBy(number.alias("b")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))).alias(side)).select(side)

    pairs = blocks(vectors, "rows").crossJoin(blocks(queries, "asked"))  # a stated query set, block against block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        unpack = lambda cell: (cell.values.field("id"), np.stack(cell.values.field("v").to_numpy(zero_copy_only=False)))
        for b in batches:
            for rows, asked in zip(b.column("rows"), b.column("asked"), strict=True):
                (ids, x), (names, q) = unpack(rows), unpack(asked)
                scores = np.round((q @ x.T) / np.sqrt(np.outer((q * q).sum(axis=1), (x * x).sum(axis=1))), 6)
                order = np.asarray(ids.to_pylist())
                best = np.stack([np.lexsort((order, -row))[:k] for row in scores])
                width = best.shape[1]
                flat = pa.array(best.ravel())
                yield pa.record_batch([names.take(pa.array(np.repeat(np.arange(len(names)), width))), ids.take(flat), pa.array(np.take_along_axis(scores, best, axis=1).ravel())], ["query_id", id_col, "cosine"])

    near = pairs.mapInArrow(run, f"query_id {kind}, `{id_col}` {kind}, cosine double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc(id_col))).cast("long")
    return near.withColumn("rank", place).where(F.col("rank") <= k)


def recall_parts(ranked: Column, expected: Column) -> tuple[Column, Column]:
    """Numerator and denominator of Recall@10."""
    return F.size(F.array_intersect(F.array_distinct(F.slice(ranked, 1, 10)), expected)).cast("long"), F.size(F.array_distinct(expected)).cast("long")


def recall_gate(samples: DataFrame, categories: Sequence[str] = V.PROBE_CATEGORIES, least: int = 12) -> DataFrame:
    """One row: passed, and why it could not be judged (error). Means are exact: gains
    of one category and denominator are summed as integers, and those cells, of which
    there are few, are added as fractions in one task."""
    up, down = recall_parts(F.col("hybrid"), F.col("expected"))
    base, _ = recall_parts(F.col("baseline"), F.col("expected"))
    cells = samples.groupBy("category", down.alias("down")).agg(F.sum(up - base).alias("gain"), F.count("*").alias("n"))
    facts = samples.agg(F.count("*").alias("all"), F.count_distinct("query_id").alias("ids"), F.array_sort(F.collect_set("category")).alias("named"), F.count_if(F.size("expected") <= 0).alias("empty"))
    names = F.array(*map(F.lit, sorted(categories)))
    error = F.when(F.col("all") < least, "TOO_FEW").when(F.col("ids") < F.col("all"), "REPEATED_QUERY").when(F.col("named") != names, "CATEGORY_MISSING").when(F.col("empty") > 0, "NOTHING_EXPECTED")
    judged = cells.agg(F.collect_list(F.struct("category", "down", "gain", "n")).alias("cells")).crossJoin(facts.select(error.alias("error")))  # one row each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdicts = [None if e is not None else passes(c) for c, e in zip(b.column("cells").to_pylist(), b.column("error").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("error"), pa.array(verdicts, pa.bool_())], ["error", "passed"])

    return judged.mapInArrow(run, "error string, passed boolean")


def passes(cells: list[dict]) -> bool:
    """The gate's three conditions on summed gains by category and denominator."""
    gains: dict[str, Fraction] = {}
    sizes: dict[str, int] = {}
    for c in cells:
        gains[c["category"]] = gains.get(c["category"], Fraction(0)) + Fraction(c["gain"], c["down"])
        sizes[c["category"]] = sizes.get(c["category"], 0) + c["n"]
    better = sum(g > 0 for g in gains.values())
    return 10 * sum(gains.values()) >= sum(sizes.values()) and better >= 2 and all(20 * g >= -sizes[k] for k, g in gains.items())
