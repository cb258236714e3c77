"""Stored state: the search index, appends to chains, job commands, merges; set joins."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V
from quillstone.operators import events, job_commands, promotion, retrieval, search_index
from quillstone.sources import buckets

T0 = datetime(2024, 1, 1)


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=str)


def texts_read(df):
    """Which columns the scans of a plan read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line or "Scan " in line]


@pytest.mark.parametrize("config", ["simple", "english"])
def test_a_stored_index_finds_what_texts_hold(spark, config, monkeypatch):
    rng = random.Random(8)
    words = ["the", "of", "engine", "engines", "valve", "Weather", "rare", "power"]
    data = [(i, " ".join(rng.choices(words, [9, 9, 3, 3, 2, 2, 1, 2], k=12)) if i % 17 else None) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    asked = [(i, " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(20)] + [(90, "absent the"), (91, ""), (92, "absent")]
    terms = retrieval.query_terms(spark.createDataFrame(asked, "query_id long, query_text string"), config=config)
    index = search_index.temporary(spark, "bigint", config, 4)
    flat = lambda df: sorted((r.query_id, r.doc_id, str(r.hits)) for r in df.collect())
    assert flat(search_index.matches(index, terms, "doc_id")) == []
    search_index.append(index, docs.where("doc_id < 50"), "doc_id", "text")
    search_index.append(index, docs.where("doc_id < 100"), "doc_id", "text")  # 50 of them are known already
    search_index.append(index, docs.where("doc_id >= 90").unionByName(docs.where("doc_id >= 110")), "doc_id", "text")
    assert search_index.append(index, docs, "doc_id", "text") is None and len(index.segments()) == 3
    want = flat(retrieval.matches_in(docs, terms, "doc_id", "text", config))
    assert want and flat(search_index.matches(index, terms, "doc_id")) == want
    monkeypatch.setattr(search_index, "LITERAL_TERMS", 0)
    assert flat(search_index.matches(index, terms, "doc_id")) == want


def test_a_search_reads_the_buckets_of_its_terms(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(200)], "doc_id long, text string")
    index = search_index.temporary(spark, "bigint", "simple", 16)
    search_index.append(index, docs, "doc_id", "text")
    asked = spark.createDataFrame([("word7", None)], "term string, x int").select("term", index.bucket(F.col("term")).alias("bucket"))
    part = search_index._of(index.postings(), asked)
    files = part.inputFiles()  # before pruning; the scan's partition filter is in the plan
    (scan,) = texts_read(part)
    assert files and "PartitionFilters: [isnotnull(bucket" in scan and "PushedFilters: [IsNotNull(term), EqualTo(term,word7)" in scan and "text" not in scan.split("ReadSchema")[1]


def test_bounds_on_ranks_are_known_to_the_plan(spark):
    """At most tasks x queries x 50 rows are exchanged."""
    names = ("total_score", "fts_score", "entity_score", "time_score", "type_score")
    df = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("doc_id"), F.lit(60).alias("limit"), *((F.col("id") % 7).alias(n) for n in names))
    found = retrieval.ranked(df, "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "50, Partial" in plan
    assert {r.query_id: r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {0: 50, 1: 50, 2: 50}


def test_evidence_search_in_one_call(spark):
    index = search_index.temporary(spark, "string", "english", 4)
    evidence = spark.createDataFrame([("e1", 1, None, "s1", "u1", "ACCEPTED", "HUMAN", "TEXT", "Engine power fell"), ("e2", 1, "r", "s1", "u2", "ACCEPTED", "MODEL", "TABLE", "powering the engines"), ("e3", 1, None, "s1", "u3", "PENDING", "HUMAN", "TEXT", "engine power")],
                                     "id string, case_id long, model_run_id string, source_document_id string, structural_unit_id string, review_status string, extraction_method string, type string, observation string")
    search_index.append(index, evidence, "id", "observation")
    member = spark.createDataFrame([(7, 1, e, r) for e, r in (("e1", None), ("e2", "r"), ("e3", None))] + [(8, 1, "e2", "r")], "investigation_id long, case_id long, evidence_id string, model_run_id string")
    sources = spark.createDataFrame([("s1", 1, "INVESTIGATION_EVIDENCE", "REPORT")], "id string, case_id long, visibility string, document_type string")
    done = spark.createDataFrame([("u2", "r")], "structural_unit_id string, model_run_id string")
    schema = "query_id int, investigation_id long, case_id long, intent string, query_text string, evidence_types array<string>, document_types array<string>, entity_ids array<string>, start_at timestamp, end_at timestamp, limit int, config_version string"
    ask = lambda q, inv, case=1, text="engine powers", limit=10, entities=(), end=None: (q, inv, case, "NEUTRAL", text, [], [], list(entities), None, end, limit, "fts-v1")
    queries = spark.createDataFrame([ask(1, 7), ask(2, 8), ask(3, 7, case=2), ask(4, 7, limit=51), ask(5, 7, text=" "), ask(6, 7, entities=["n"]), ask(7, 8, entities=["n"]), ask(8, 7, end=T0)], schema)
    links = spark.createDataFrame([(7, "e2", "n")], "investigation_id long, id string, entity_id string")
    times = spark.createDataFrame([(7, "e1", T0), (7, "e2", T0 + timedelta(1)), (8, "e1", T0)], "investigation_id long, id string, occurred_at timestamp")
    got = search_index.evidence_search(index, "blind", queries, member, evidence, sources, done, links, times)
    assert rows(got, "query_id", "rank", "id", "error") == [(1, 1, "e1", None), (1, 2, "e2", None), (2, 1, "e2", None), (4, None, None, "LIMIT"), (5, None, None, "BLANK_TEXT"), (6, 1, "e2", None), (8, 1, "e1", None)]
    with pytest.raises(PermissionError):
        search_index.evidence_search(index, "evaluation", queries, member, evidence, sources, done)


def test_appends_to_stored_chains(spark):
    schema = "investigation_id string, case_id string, sequence long, id string, event_type string, target_type string, target_id string, payload string, model_run_id string"
    made = lambda inv, n: (inv, "c", n, f"{inv}{n}", "CLAIM_CREATED", "claim", f"t{n}", '{"n": %d}' % n, None)
    whole = spark.createDataFrame([made(i, n) for i in "abc" for n in range(1, 8)], schema)
    chained = events.append(whole)
    none = spark.createDataFrame([], "investigation_id string, sequence long, event_hash string")
    unseen = spark.createDataFrame([(i, 0, None) for i in "abcd"], none.schema)
    first, errors, heads = events.append_stored(none, whole.where("sequence <= 3"), unseen)
    assert errors.count() == 0
    late = whole.where("sequence > 3").withColumn("sequence", F.col("sequence") - 3)
    second, errors, heads = events.append_stored(heads, late, heads)
    assert errors.count() == 0
    both = first.unionByName(second)
    assert rows(both, "id", "sequence", "event_hash", "previous_event_hash") == rows(chained, "id", "sequence", "event_hash", "previous_event_hash")
    assert {r.error for r in events.chain_errors(both).collect()} == {"FIRST_EVENT"} and rows(heads) == rows(events.chain_heads(chained))
    more = spark.createDataFrame([made("a", 1), made("b", 1), made("c", 2), made("d", 1), made("e", 1)], schema)
    stale = heads.withColumn("event_hash", F.when(F.col("investigation_id") == "b", "0").otherwise(F.col("event_hash"))).unionByName(unseen.where("investigation_id = 'd'"))
    states = heads.withColumn("status", F.when(F.col("investigation_id") == "a", "SUCCEEDED").otherwise("RUNNING"))
    third, errors, after = events.append_stored(states, more, stale)
    assert rows(errors) == [("a", "NOT_WRITABLE"), ("b", "STALE_HEAD"), ("c", "NUMBERING"), ("e", "NOT_EXPECTED")]
    assert rows(third, "investigation_id", "sequence") == [("d", 1)] and rows(after.where("investigation_id <> 'd'")) == rows(heads)


def test_job_commands_over_several_jobs(spark):
    stage = V.STAGES[0]
    inv = spark.createDataFrame([("i", "PENDING", stage), ("z", "SUCCEEDED", stage)], "investigation_id string, status string, current_stage string")
    schema = "id string, investigation_id string, stage string, work_key string, status string, attempt_count int, model_request_count int, worker_id string, claimed_at timestamp, lease_expires_at timestamp, failure_code string, created_at timestamp, completed_at timestamp"
    job = lambda id_, key, own="i", of=stage: (id_, own, of, key, "PENDING", 0, 0, None, None, None, None, T0, None)
    jobs = spark.createDataFrame([job("a", "1"), job("b", "0"), job("n", "0", of=V.STAGES[1]), job("z", "0", "z"), job("lost", "0", "none")], schema)
    steps = [("CLAIM", None, None), ("CLAIM", None, None), ("CLAIM", None, None), ("COMPLETE", "b", 1), ("COMPLETE", "a", 1), ("COMPLETE", "a", 1), ("CLAIM", None, None), ("WHAT", "n", 1), ("RESERVE", "n", 1)]
    commands = [(n, "i", T0 + timedelta(minutes=n), kind, "w", j, a, None) for n, (kind, j, a) in enumerate(steps)] + [(20, "z", T0, "CLAIM", "w", None, None, None), (21, "none", T0, "CLAIM", "w", None, None, None), (22, "i", T0, "CLAIM", "", None, None, None)]
    asked = spark.createDataFrame(commands, "command_no long, investigation_id string, at timestamp, kind string, worker_id string, job_id string, attempt int, failure_code string")
    owners, after, results = job_commands.run_commands(inv, jobs, asked)
    assert rows(owners) == [("i", "RUNNING", V.STAGES[1], None), ("z", "SUCCEEDED", stage, None)]
    assert rows(after, "id", "status", "attempt_count", "model_request_count", "worker_id") == [("a", "SUCCEEDED", 1, 0, None), ("b", "SUCCEEDED", 1, 0, None), ("lost", "PENDING", 0, 0, None), ("n", "RUNNING", 1, 1, "w"), ("z", "PENDING", 0, 0, None)]
    got = {r.command_no: (r.job_id, r.attempt, r.request, r.error) for r in results.collect()}
    assert got == {
        0: ("b", 1, None, None), 1: ("a", 1, None, None), 2: (None, None, None, None), 3: ("b", 1, None, None), 4: ("a", 1, None, None), 5: ("a", 1, None, "LEASE_LOST"), 6: ("n", 1, None, None), 7: ("n", 1, None, "UNKNOWN_COMMAND"),
        8: ("n", 1, 1, None), 20: (None, None, None, None), 21: (None, None, None, "UNKNOWN_INVESTIGATION"), 22: (None, None, None, "WORKER_REQUIRED"),
    }
    r = after.where("id = 'n'").first()
    assert (r.claimed_at, r.lease_expires_at) == (T0 + timedelta(minutes=6), T0 + timedelta(minutes=36))


def test_merges_touch_only_their_buckets(spark, tmp_path):
    data = [(k, k % 3, f"v{k}") for k in range(60)]
    df = spark.createDataFrame(data, "k long, g int, v string")
    t = buckets.create(df, str(tmp_path / "t"), ["k"], 8)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(t.path) for f in names if f.endswith(".parquet")}
    before = files()
    assert rows(t.read()) == rows(df)
    new = spark.createDataFrame([(5, 2, "new"), (6, 1, "other guard"), (6, 2, "worse"), (99, None, "added"), (None, 1, "no key")], "k long, g int, v string")
    refused = t.merge(new, [F.asc("g")], guard=["g"])
    assert rows(refused, "k", "v") == [(6, "other guard"), (None, "no key")]
    want = {k: (k, g, v) for k, g, v in data} | {5: (5, 2, "new"), 99: (99, None, "added")}
    assert rows(t.read()) == sorted(want.values(), key=str)
    touched = {r[0] for r in spark.createDataFrame([(5,), (6,), (99,)], "k long").select(t.bucket()).collect()}
    same = {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched}
    assert same and same <= files()
    t.merge(spark.createDataFrame([(7, 0, "ignored"), (100, 0, "more")], "k long, g int, v string"), [F.asc("v")], update=False)
    assert rows(t.read().where("k in (7, 100)")) == [(100, 0, "more"), (7, 1, "v7")]


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(6)
    data = []
    for i in range(160):
        base = [f"w{x}" for x in range(i % 5 * 10, i % 5 * 10 + rng.randint(3, 16))]
        data.append((i % 3, i, [w for w in base if rng.random() < 0.93] + ["the"]))
    data += [(0, 200, []), (0, 201, []), (0, 202, None), (1, 203, []), (None, 204, []), (None, 205, []), (2, 300, list("abc")), (2, 301, list("abcd")), (2, 302, list("abcde")), (2, 303, list("aabcde")), (2, 304, [*"abcde", None])]
    df = spark.createDataFrame([(*r, "x") for r in data], "lang int, doc_id long, tokens array<string>, id string")
    want = []
    for g, a, s in data:
        for h, b, t in data:
            if g is not None and g == h and a < b:
                s_, t_ = set(s or ()), set(t or ())
                shared, total = (len(s_ & t_), len(s_ | t_)) if s_ | t_ else (1, 1)
                if 4 * shared > 3 * total:
                    want.append((g, a, b, shared, total))
    assert rows(promotion.too_similar(df, "lang", "doc_id", "tokens")) == sorted(want, key=str)
    assert len(want) > 50 and not any((a, b) == (300, 301) for _, a, b, _, _ in want)  # exactly 3/4 is not over it
