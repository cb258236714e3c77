"""Operators on small fixtures with known results."""

from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstone.functions import canonical, english, vocabulary
from quillstone.operators import audit, components, events, falsification, integrity, jobs, materiality, promotion, relational, replay, replay_fold, retrieval, visibility

CUTOFF = datetime(2025, 5, 1)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_visibility_classes(spark):
    cases = [
        ("FINAL_REPORT", "Aircraft Accident Final Report", None, "FINAL_FINDING"), ("REPORT", "Probable Cause", None, "FINAL_FINDING"), ("REPORT", "Adopted report", None, "FINAL_FINDING"),
        ("ANALYSIS", "Human Performance Analysis", None, "OFFICIAL_ANALYSIS"), ("FINDINGS", "Findings and recommendations", None, "OFFICIAL_ANALYSIS"),
        ("FACTUAL_REPORT", "Aircraft factual report", datetime(2025, 5, 1, 0, 0, 0, 1), "OFFICIAL_ANALYSIS"), ("FACTUAL_REPORT", "Aircraft factual report", CUTOFF, "INVESTIGATION_EVIDENCE"),
        ("WITNESS_STATEMENT", "Witness statement", None, "OFFICIAL_ANALYSIS"), (None, "Unclassified attachment", None, "OFFICIAL_ANALYSIS"), ("", "Attachment", CUTOFF, "OFFICIAL_ANALYSIS"),
    ]
    df = spark.createDataFrame(cases, "document_type string, title string, published_at timestamp, expected string")
    got = df.select("expected", visibility.classify_visibility(F.col("document_type"), F.col("title"), F.col("published_at"), F.lit(CUTOFF)).alias("v")).collect()
    assert all(r.v == r.expected for r in got)


def test_roles_see_eligible_sources_only(spark):
    cases = spark.createDataFrame([("c", "BLIND", CUTOFF)], "id string, state string, evidence_cutoff timestamp")
    dockets = spark.createDataFrame([(i, "c", "LINK_ONLY" if i == 3 else "AI_ALLOWED") for i in range(1, 5)], "id int, case_id string, processing_disposition string")
    title = {4: "Final Report"}
    src = [(i, i, "c", title.get(i, "Witness"), "WITNESS_STATEMENT", "INVESTIGATION_EVIDENCE", datetime(2025, 5, 2) if i == 2 else CUTOFF) for i in range(1, 5)]
    sources = spark.createDataFrame(src, "id int, docket_item_id int, case_id string, title string, document_type string, visibility string, published_at timestamp")
    locks = spark.createDataFrame([], "case_id string")
    counts = {r: visibility.secured_sources(r, sources, dockets, cases, locks).count() for r in ("blind", "processor", "evaluation", "acquisition")}
    assert counts == {"blind": 1, "processor": 1, "evaluation": 0, "acquisition": 4}
    seen, log = visibility.read_with_audit(sources, visibility.secured_sources("blind", sources, dockets, cases, locks), "id", F.col("case_id"), F.lit(CUTOFF))
    assert seen.count() == 1 and rows(log.groupBy("operation", "allowed").count()) == [("DENY", False, 3), ("READ", True, 1)]


def test_null_title_is_not_eligible(spark):
    df = spark.range(1).select(visibility.blind_eligible(F.lit(None).cast("string"), F.lit("TEXT"), F.lit("INVESTIGATION_EVIDENCE"), F.lit(CUTOFF), F.lit(CUTOFF), F.lit("AI_ALLOWED")).alias("e"))
    assert df.first().e is None


@pytest.mark.parametrize(
    ("kind", "text", "material"),
    [("claim", "The flight-control cable was fractured.", True), ("timeline", "Observation in Row 437, Column 5: 0.63", False), ("entity", "0.63", False), ("timeline", "Data recorded for Row 188", False), ("claim", "  ", False), ("claim", "Row 4 of\nthe log, column 7", False)],
)
def test_materiality(spark, kind, text, material):
    df = spark.createDataFrame([(kind, json.dumps({materiality.TEXT_FIELDS[kind]: text}))], "kind string, candidate string")
    assert df.select(materiality.is_material(materiality.candidate_text(F.col("kind"), F.col("candidate"))).alias("m")).first().m is material


def revise(spark, before, tests):
    h = spark.createDataFrame([("h", Decimal(before))], "hypothesis_id string, current_confidence decimal(5,4)")
    t = spark.createDataFrame([(f"t{i}", "h", s, o, w) for i, (s, o, w) in enumerate(tests)], "test_id string, hypothesis_id string, status string, outcome string, strength string")
    r = falsification.revise(h, t).first()
    return str(r.delta), str(r.after), r.rationale


def test_confidence_revision(spark):
    ok = "SUCCEEDED"
    assert revise(spark, "0.5432", [(ok, "CONTRADICTED", "MEDIUM"), (ok, "SURVIVED", "MEDIUM"), (ok, "INCONCLUSIVE", "HIGH")])[:2] == ("-0.1400", "0.4032")
    assert revise(spark, "0.5000", [(ok, "CONTRADICTED", "HIGH")] * 4)[:2] == ("-1.4000", "0.0500")
    assert revise(spark, "0.5000", [(ok, "SURVIVED", "HIGH")] * 20)[:2] == ("1.2000", "0.9500")
    assert revise(spark, "0.1000", [(ok, "CONTRADICTED", "HIGH"), (ok, "SURVIVED", "HIGH")])[:2] == ("-0.2900", "0.0500")
    delta, after, why = revise(spark, "0.5000", [("FAILED", "CONTRADICTED", "HIGH")])
    assert (delta, after) == ("0.0000", "0.5000") and "no SUCCEEDED tests" in why and "delta=+0.0000" in why


def test_statuses(spark):
    data = [("a", "0.1500"), ("a", "0.1501"), ("a", "0.3499"), ("a", "0.3500"), ("a", "0.4999"), ("b", "0.5000"), ("c", "0.9000"), ("c", "0.9000")]
    df = spark.createDataFrame([(i, c, Decimal(x)) for i, (c, x) in enumerate(data)], "id int, investigation_id string, current_confidence decimal(5,4)")
    got = [s for _, s in rows(falsification.assign_statuses(df), "id", "status")]
    assert got == ["REJECTED", "WEAKENED", "WEAKENED", "ACTIVE", "ACTIVE", "LEADING", "ACTIVE", "ACTIVE"]


def test_confidence_is_rounded_half_to_even(spark):
    df = spark.createDataFrame([(0.12345,), (0.12355,), (0.7,)], "x double")
    assert [str(r.c) for r in df.select(falsification.to_confidence(F.col("x")).alias("c")).collect()] == ["0.1234", "0.1236", "0.7000"]


def test_evidence_presence(spark):
    t = spark.createDataFrame([("vague", "c", [], None, None), ("hit", "c", [], "TEXT", None), ("miss", "c", ["e2"], "TEXT", None), ("named", "c", ["e2"], None, None)], "test_id string, case_id string, evidence_ids array<string>, evidence_type string, subtype string")
    e = spark.createDataFrame([("e1", "c", "TEXT", "x"), ("e2", "c", "TABLE", None), ("e3", "other", "TEXT", None)], "id string, case_id string, type string, subtype string")
    got = {r.test_id: (r.outcome, r.result_evidence_ids) for r in falsification.evidence_presence(t, e).collect()}
    assert got == {"vague": ("INCONCLUSIVE", []), "hit": ("SURVIVED", ["e1"]), "miss": ("EXPECTED_EVIDENCE_MISSING", []), "named": ("SURVIVED", ["e2"])}


def test_claim_contradiction(spark):
    schema = "test_id string, claim_id string, supporting array<string>, contradicting array<string>, scope array<string>"
    data = [("no claims", None, None, None, ["e1"]), ("against", "c", ["e1"], ["e2"], ["e1", "e2"]), ("backed", "c", ["e1"], ["e2"], ["e1"]), ("both", "c", ["e1"], ["e1"], ["e1"])]
    got = dict(rows(falsification.claim_contradiction(spark.createDataFrame(data, schema)), "test_id", "outcome"))
    assert got == {"no claims": "INCONCLUSIVE", "against": "CONTRADICTED", "backed": "SURVIVED", "both": "INCONCLUSIVE"}


def test_leakage_of_a_wrong_case_and_host(spark):
    e = spark.createDataFrame([("e", "c", "x", "BLIND", "MODEL_INFERENCE", "NETWORK", None, "evil.example", CUTOFF)], "id string, audit_case_id string, case_id string, stage string, capability string, operation string, target_document_id string, network_host string, occurred_at timestamp")
    s = spark.createDataFrame([], "document_id string, visibility string, published_at timestamp, metadata_eligible boolean")
    c = spark.createDataFrame([("c", CUTOFF, None)], "case_id string, evidence_cutoff timestamp, locked_at timestamp")
    assert rows(audit.leakage_incidents(e, s, c, ["ok.example"]), "code") == [("FORBIDDEN_BLIND_HOST",), ("MALFORMED_AUDIT_EVENT",)]


def test_canonical_json(spark):
    value = {"zz": [True, None, 1e-7], "é": "Δ", "a": "x"}
    assert canonical.canonical(value) == '{"a": "x", "zz": [true, null, 0.0000001], "é": "Δ"}'
    with pytest.raises(ValueError):
        canonical.canonical(float("nan"))
    with pytest.raises(ValueError):
        canonical.canonical("\0")
    texts = ["plain", 'quote " back \\ slash', "tab\tnew\nline", "bell\x07 esc\x1b vt\x0b", "\\u001F stays", "Δ é 😀", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", canonical.string_text(F.col("t")).alias("j")).collect()}
    assert got == {i: json.dumps(t, ensure_ascii=False) for i, t in enumerate(texts)}
    numbers = [0.0, -0.0, 1e-7, 123456789012.5, 1e21, -2.5e-10, 0.1, 100.0, 1.5e300]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = {r.i: r.j for r in df.select("i", canonical.double_text(F.col("x")).alias("j")).collect()}
    assert {i: Decimal(t) for i, t in got.items()} == {i: Decimal(repr(abs(x) if x == 0 else x)) for i, x in enumerate(numbers)} and not any("E" in t for t in got.values())
    assert spark.createDataFrame([('{"b": 1, "aa": [1.0]}',), ("nope",)], "t string").select(canonical.json_text("t").alias("j")).collect()[0].j == '{"b": 1, "aa": [1.0]}'


INV, CASE = "11111111-0000-0000-0000-000000000001", "22222222-0000-0000-0000-000000000002"
NOW = "2025-01-01T00:00:00Z"
LOG = "investigation_id string, case_id string, sequence long, id string, event_type string, target_type string, target_id string, payload string, model_run_id string"


def record(id_, run="m", **fields):
    return {"id": id_, "investigation_id": INV, "case_id": CASE, "model_run_id": run, "created_at": NOW, **fields}


def draft(**fields):
    return {"type": "TEMPORAL_CONSISTENCY", "expected_observation": "x", "strength": "HIGH", "execution_kind": "DETERMINISTIC", "parameters": {"schema_version": "temporal-consistency-v1", "before_event_id": "t1", "after_event_id": "t2"}, "evidence_ids": [], "claim_ids": ["c1"], **fields}


def good_log():
    """Kinds, targets, payloads and model runs of an investigation from start to end."""
    V = vocabulary.STAGES
    pending = record("x1", None, hypothesis_id="h1", critique_id="k1", job_id="j", status="PENDING", outcome=None, completed_at=None, result_evidence_ids=[], **draft())
    done = pending | {"status": "SUCCEEDED", "outcome": "SURVIVED", "completed_at": NOW, "result_evidence_ids": ["e2", "e1"]}
    rationale = "weighted-delta-v1; x1:SURVIVED:HIGH:+0.0600; before=0.4800; delta=+0.0600; after=0.5400; clamp=[0.0500,0.9500]"
    log = [
        ("INVESTIGATION_STARTED", INV, {"configuration_hash": "a" * 64, "current_stage": V[0], "status": "PENDING"}, None), ("STAGE_TRANSITION", INV, {"previous_stage": V[0], "next_stage": V[0]}, None),
        ("TIMELINE_CREATED", "t1", {"record": record("t1", occurred_at="2024-01-01T00:00:00+00:00", evidence_ids=["e1"])}, "m"), ("TIMELINE_CREATED", "t2", {"record": record("t2", occurred_at=None, evidence_ids=[])}, "m"),
        ("STAGE_TRANSITION", INV, {"previous_stage": V[0], "next_stage": V[1]}, None), ("ENTITY_CREATED", "n1", {"record": record("n1", aliases=["b  A", "a b"])}, "m"), ("STAGE_TRANSITION", INV, {"previous_stage": V[1], "next_stage": V[2]}, None),
        ("CLAIM_CREATED", "c1", {"record": record("c1", confidence="0.5000")}, "m"), ("STAGE_TRANSITION", INV, {"previous_stage": V[2], "next_stage": V[3]}, None),
        ("HYPOTHESIS_CREATED", "h1", {"record": record("h1", status="ACTIVE", initial_confidence="0.4800", current_confidence="0.4800"), "supporting_claim_ids": ["c1"], "contradicting_claim_ids": [], "questions": [{"id": "q1", "investigation_id": INV, "case_id": CASE, "hypothesis_id": "h1", "text": "Why?"}]}, "m"),
        ("STAGE_TRANSITION", INV, {"previous_stage": V[3], "next_stage": V[4]}, None),
        ("RETRIEVAL_COMPLETED", "r1", {"query_id": "r1", "hypothesis_id": "h1", "query": {"investigation_id": INV, "case_id": CASE, "entity_ids": ["n1"], "limit": 10}, "results": [{"evidence_id": "e2", "rank": 1}, {"evidence_id": "e1", "rank": 2}]}, None),
    ]
    for n in (4, 5):
        log.append(("STAGE_TRANSITION", INV, {"previous_stage": V[n], "next_stage": V[n + 1]}, None))
    log.append(("CRITIQUE_CREATED", "k1", {"record": record("k1", hypothesis_id="h1", missing_evidence=[], critique_confidence="0.9000", proposed_tests=[draft()])}, "m"))
    log += [("TEST_CREATED", "x1", {"record": pending}, None), ("STAGE_TRANSITION", INV, {"previous_stage": V[6], "next_stage": V[7]}, None), ("TEST_RESOLVED", "x1", {"record": done}, None), ("STAGE_TRANSITION", INV, {"previous_stage": V[7], "next_stage": V[8]}, None)]
    log.append(("CONFIDENCE_REVISED", "v1", {"record": record("v1", None, hypothesis_id="h1", before="0.4800", delta="0.0600", after="0.5400", rationale=rationale, test_deltas=[{"test_id": "x1", "delta": "0.0600"}])}, None))
    log.append(("HYPOTHESIS_STATUS_CHANGED", "h1", {"hypothesis_id": "h1", "before": "ACTIVE", "after": "LEADING"}, None))
    log += [("STAGE_TRANSITION", INV, {"previous_stage": V[8], "next_stage": V[9]}, None), ("STAGE_TRANSITION", INV, {"previous_stage": V[9], "next_stage": V[10]}, None)]
    return log


def build_chain(spark):
    return as_events(spark, good_log()[:5]).cache()


def as_events(spark, log):
    rows_ = [(INV, CASE, n, f"e{n}", kind, vocabulary.EVENT_TARGETS[kind], target, canonical.canonical({"kind": kind, "schema_version": "1", **payload}), run) for n, (kind, target, payload, run) in enumerate(log, 1)]
    return events.append(spark.createDataFrame(rows_, LOG))


def brute_state():
    """The state of ``good_log``, written out."""
    own = lambda id_, **f: {k: v for k, v in record(id_, **f).items() if k != "created_at"}
    test = own("x1", run=None, hypothesis_id="h1", critique_id="k1", job_id="j", status="SUCCEEDED", outcome="SURVIVED", result_evidence_ids=["e1", "e2"], **draft())
    return {
        "investigation_id": INV, "case_id": CASE, "entities": {"n1": own("n1", aliases=["a b", "b  A"])}, "timeline": {"t1": own("t1", occurred_at="2024-01-01T00:00:00Z", evidence_ids=["e1"]), "t2": own("t2", occurred_at=None, evidence_ids=[])},
        "claims": {"c1": own("c1", confidence="0.5")}, "hypotheses": {"h1": own("h1", status="LEADING", initial_confidence="0.48", current_confidence="0.54")}, "hypothesis_claim_links": {"h1": {"supporting": ["c1"], "contradicting": []}},
        "questions": {"q1": {"id": "q1", "investigation_id": INV, "case_id": CASE, "hypothesis_id": "h1", "text": "Why?"}}, "critiques": {"k1": own("k1", hypothesis_id="h1", missing_evidence=[], critique_confidence="0.9", proposed_tests=[draft()])}, "tests": {"x1": test},
        "revisions": {"v1": own("v1", run=None, hypothesis_id="h1", before="0.48", delta="0.06", after="0.54", rationale=good_log()[19][2]["record"]["rationale"], test_deltas=[{"test_id": "x1", "delta": "0.06"}])},
        "retrievals": {"r1": {"query_id": "r1", "hypothesis_id": "h1", "query": {"investigation_id": INV, "case_id": CASE, "entity_ids": ["n1"], "limit": 10}, "results": [{"evidence_id": "e2", "rank": 1}, {"evidence_id": "e1", "rank": 2}]}},
    }


def test_chain_and_tampering(spark):
    chained = as_events(spark, good_log()).cache()
    assert events.chain_errors(chained).count() == 0
    assert chained.count() == 23 and rows(events.with_contract_errors(chained).where("size(errors) > 0"), "sequence", "errors") == []
    last = chained.orderBy("sequence").collect()[-1]
    envelope = {"previous_hash": last.previous_event_hash, "investigation_id": INV, "case_id": CASE, "sequence": 23, "event_type": "STAGE_TRANSITION", "target_type": "investigation", "target_id": INV, "payload": json.loads(last.payload), "model_run_id": None}
    import hashlib

    assert last.event_hash == hashlib.sha256(canonical.canonical(envelope).encode()).hexdigest()
    for column, value in (("target_id", "zz"), ("payload", '{"kind": "X"}'), ("event_hash", "0" * 64), ("case_id", "d"), ("sequence", 9)):
        bad = chained.withColumn(column, F.when(F.col("sequence") == 3, F.lit(value)).otherwise(F.col(column)))
        assert events.chain_errors(bad).count() > 0, column


def changed_logs(spark, changes):
    """Events of ``good_log`` once for each change, each an investigation of its own."""
    rows_ = []
    for i, change in enumerate(changes):
        log = good_log()
        change(log)
        inv = f"{INV[:-3]}{i:03d}"
        for n, (kind, target, payload, run) in enumerate(log, 1):
            text = canonical.canonical({"kind": kind, "schema_version": "1", **payload}).replace(INV, inv)
            rows_.append((inv, CASE, n, f"e{i}-{n}", kind, vocabulary.EVENT_TARGETS[kind], target.replace(INV, inv), text, run))
    return events.append(spark.createDataFrame(rows_, LOG))


def edit(at, run=None, target=None, **fields):
    """A change of one event: fields of its payload, ``record`` fields, run or target."""

    def change(log):
        kind, old, payload, was = log[at]
        inner = fields.get("record")
        rest = {k: v for k, v in fields.items() if k != "record"}
        log[at] = (kind, target or old, payload | rest | ({"record": payload["record"] | inner} if inner else {}), run or was)

    return change


def test_event_contract(spark):
    question = good_log()[9][2]["questions"][0]
    cases = [
        (edit(2, run="other"), "MODEL_RUN"), (edit(2, record={"case_id": "z"}), "RECORD_CONTEXT"), (edit(7, target="c9"), "TARGET_ID"), (edit(0, status="RUNNING"), "START_STATE"), (edit(4, next_stage="COMPLETE"), "STAGE_ORDER"),
        (edit(9, record={"current_confidence": "0.5"}), "HYPOTHESIS_START"), (edit(9, supporting_claim_ids=[]), "HYPOTHESIS_LINKS"), (edit(9, supporting_claim_ids=["c1", "c1"]), "REPEATED_REFERENCE"),
        (edit(11, results=[{"evidence_id": "e1", "rank": 2}]), "RESULT_RANKS"), (edit(11, query=good_log()[11][2]["query"] | {"limit": 1}), "RESULT_LIMIT"), (edit(15, record={"status": "FAILED"}), "TEST_PENDING"),
        (edit(17, record={"status": "PENDING"}), "TEST_RESOLUTION"), (edit(17, record={"outcome": None}), "TEST_RESULT"), (edit(20, before="LEADING"), "STATUS_UNCHANGED"), (edit(5, kind="X"), "KIND"),
        (edit(9, questions=[question | {"hypothesis_id": "z"}]), "QUESTION_CONTEXT"), (edit(9, questions=[question, question | {"id": "q2", "text": " why? "}]), "QUESTION_TEXT"),
    ]
    found = events.with_contract_errors(changed_logs(spark, [c for c, _ in cases])).select("investigation_id", F.explode("errors").alias("e"))
    assert rows(found) == [(f"{INV[:-3]}{i:03d}", e) for i, (_, e) in enumerate(cases)]


def test_replay(spark):
    log = good_log()
    state = brute_state()
    text = canonical.canonical(state)
    import hashlib

    closed = [*log, ("INVESTIGATION_COMPLETED", INV, {"projection_hash": hashlib.sha256(text.encode()).hexdigest()}, None)]
    good = as_events(spark, closed).cache()
    found = replay.projections(replay.replay_state(good), good).first()
    assert json.loads(found.projection) == state and found.projection == text
    assert rows(replay.replay_errors(good), "sequence", "error") == []
    life = replay.replay_lifecycle(good).first()
    assert (life.current_stage, life.status, life.configuration_hash) == ("COMPLETE", "SUCCEEDED", "a" * 64)
    assert replay.replay_lifecycle(good.where("sequence = 1")).first().status == "PENDING" and replay.replay_lifecycle(good.where("sequence < 3")).first().status == "RUNNING"
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", None)], "k string, v string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4"), ("n", None)], "k string, v string")
    assert rows(replay.state_differences(a, b, ["k"], "v")) == [("y", "DIFFERS"), ("z", "NOT_REPLAYED")]


def test_replay_rules(spark):
    end = ("INVESTIGATION_COMPLETED", INV, {"projection_hash": "0" * 64}, None)
    twin = lambda at, id_: (lambda log: log.insert(at + 1, (log[at][0], id_, log[at][2] | {"record": log[at][2]["record"] | {"id": id_}}, log[at][3])))
    exact = [
        (lambda log: log.insert(8, log[7]), "DUPLICATE_CLAIM"), (lambda log: log.pop(7), "UNKNOWN_CLAIM"), (lambda log: log.pop(3), "UNKNOWN_TIMELINE_EVENT"), (lambda log: log.pop(5), "UNKNOWN_ENTITY"), (lambda log: log.pop(14), "UNKNOWN_CRITIQUE"),
        (lambda log: log.insert(18, log[17]), "TEST_NOT_PENDING"), (edit(17, record={"expected_observation": "y"}), "TEST_FIELDS_CHANGED"), (twin(15, "x2"), "TEST_PROPOSED_ONCE"),
        (edit(19, record={"test_deltas": [{"test_id": "x1", "delta": "0.2000"}]}), "REVISION_DELTA"), (edit(19, record={"rationale": "because"}), "REVISION_RATIONALE"),
        (edit(20, before="WEAKENED"), "STATUS_BEFORE"), (edit(20, after="REJECTED"), "STATUS_AFTER"), (lambda log: log.insert(2, log[1]), "STARTED_AGAIN"),
        (lambda log: log.append(("CLAIM_CREATED", "c9", {"record": record("c9")}, "m")), "COMPLETE_STAGE_ONLY_COMPLETES"), (lambda log: log.append(end), "COMPLETION_HASH"),
    ]
    among = [
        (lambda log: log.pop(9), "UNKNOWN_HYPOTHESIS"), (edit(15, record={"strength": "LOW"}), "TEST_NOT_PROPOSED"), (edit(19, record={"before": "0.4100"}), "REVISION_BEFORE"), (edit(19, record={"test_deltas": []}), "REVISION_LEAVES_TESTS_OUT"),
        (lambda log: log.pop(17), "REVISION_NEEDS_SUCCEEDED"), (twin(19, "v2"), "REVISED_TWICE"), (edit(4, previous_stage="GENERATE_HYPOTHESES"), "WRONG_STAGE"), (edit(4, previous_stage="GENERATE_HYPOTHESES"), "STAGE_ORDER"),
        (lambda log: log.insert(22, end), "COMPLETION_STAGE"), (lambda log: log.insert(22, end), "TERMINAL"), (edit(14, record={"hypothesis_id": "h9"}), "TEST_OF_OTHER_HYPOTHESIS"), (edit(19, record={"hypothesis_id": "h9"}), "REVISION_OF_OTHER_HYPOTHESIS"),
        (lambda log: log.insert(6, log[0]), "STARTED_AFTER_START"),
    ]
    got = {}
    logs = changed_logs(spark, [c for c, _ in exact + among]).cache()
    found = rows(replay.replay_errors(logs), "investigation_id", "sequence", "error")
    assert rows(replay_fold.replay_errors(logs), "investigation_id", "sequence", "error") == found
    for split in (1, 16, 30):  # a later replay goes on from the snapshots of an earlier one
        part = logs.where(F.col("sequence") <= split)
        early, (_, kept) = replay_fold.replay_errors(part), replay_fold.fold(part)
        late = replay_fold.replay_errors(logs, kept)
        assert rows(early.unionByName(late), "investigation_id", "sequence", "error") == found
    forged = kept.withColumn("event_hash", F.lit("0" * 64)).withColumn("sequence", F.lit(20).cast("long"))
    assert {r.error for r in replay_fold.fold(logs.where("sequence <= 21"), forged)[0].collect()} >= {"SNAPSHOT_HEAD"}
    for inv, _, error in found:
        got.setdefault(int(inv[-3:]), set()).add(error)
    assert [got[i] for i in range(len(exact))] == [{e} for _, e in exact]
    assert all(e in got[len(exact) + i] for i, (_, e) in enumerate(among)), [(e, got[len(exact) + i]) for i, (_, e) in enumerate(among)]


def test_execution(spark):
    schema = "test_id string, case_id string, investigation_id string, type string, status string, execution_kind string, parameters string, evidence_ids array<string>, claim_ids array<string>, created_at timestamp, completed_at timestamp"
    V = falsification.PARAMETERS
    p = lambda kind, **f: json.dumps({"schema_version": V.get(kind, "x"), **f})
    one = lambda id_, kind, params, ev=(), cl=(), status="PENDING", how="DETERMINISTIC", done=CUTOFF: (id_, "c", "i", kind, status, how, params, list(ev), list(cl), CUTOFF, done)
    E, T, C = V
    data = [
        one("presence", E, p(E, evidence_type="TEXT")), one("named", E, p(E, evidence_type="TEXT"), ["e2"]), one("vague", E, p(E)), one("time", T, p(T, before_event_id="t1", after_event_id="t2")),
        one("scope", T, p(T, before_event_id="t1", after_event_id="t2"), ["e1"]), one("claims", C, p(C), [], ["k1"]), one("no claims", C, p(C)), one("against", C, p(C), ["e2"], ["k1"]),
        one("unknown", T, p(T, before_event_id="t1", after_event_id="zz")), one("same", T, p(T, before_event_id="t1", after_event_id="t1")), one("done", E, p(E), status="SUCCEEDED"), one("ai", "SEMANTIC_COMPARISON", "{}", how="AI"),
        one("foreign", E, p(E), ["e9"]), one("twice", E, p(E), ["e1", "e1"]), one("version", E, p(T)), one("early", E, p(E), done=CUTOFF.replace(year=2000)), one("claim?", C, p(C), [], ["k9"]),
    ]
    evidence = spark.createDataFrame([("e1", "c", "TEXT", "A"), ("e2", "c", "TABLE", "B"), ("e9", "other", "TEXT", "A")], "id string, case_id string, type string, subtype string")
    claims = spark.createDataFrame([("k1", "c", "i", ["e1"], ["e2"]), ("k9", "c", "j", [], [])], "id string, case_id string, investigation_id string, supporting array<string>, contradicting array<string>")
    line = spark.createDataFrame([("t1", "c", "i", CUTOFF, "EXACT", ["e1"]), ("t2", "c", "i", CUTOFF.replace(year=2031), "EXACT", ["e2", "e1"])], "id string, case_id string, investigation_id string, occurred_at timestamp, time_precision string, evidence_ids array<string>")
    got = {r.test_id: (r.outcome, r.result_evidence_ids, r.error) for r in falsification.execute(spark.createDataFrame(data, schema), evidence, claims, line).collect()}
    assert got["presence"] == ("SURVIVED", ["e1"], None) and got["named"] == ("EXPECTED_EVIDENCE_MISSING", [], None) and got["vague"] == ("INCONCLUSIVE", [], None)
    assert got["time"] == ("SURVIVED", ["e1", "e2"], None) and got["scope"] == ("SURVIVED", ["e1"], None)
    assert got["claims"] == ("CONTRADICTED", ["e1", "e2"], None) and got["no claims"] == ("INCONCLUSIVE", [], None) and got["against"] == ("CONTRADICTED", ["e2"], None)
    want = {"unknown": "UNKNOWN_EVENT", "same": "SAME_EVENT", "done": "NOT_PENDING", "ai": "NEEDS_MODEL,UNSUPPORTED_TYPE", "foreign": "UNKNOWN_EVIDENCE", "twice": "REPEATED_REFERENCE", "version": "PARAMETERS", "early": "COMPLETED_BEFORE_CREATION", "claim?": "UNKNOWN_CLAIM"}
    assert {k: v[2] for k, v in got.items() if v[2]} == want and all(got[k][:2] == (None, None) for k in want)
    again = evidence.unionAll(evidence.where("id = 'e1'"))
    assert {e for _, e in rows(falsification.execution_errors(spark.createDataFrame(data[:1], schema), again, claims, line), "test_id", "error")} == {"DUPLICATE_EVIDENCE"}


def test_promotion_checks(spark):
    c = spark.createDataFrame([("c1", "OBSERVED", "Fuel  low", ["e1"], []), ("c2", "OBSERVED", "fuel LOW", ["e2"], ["e3"])], "candidate_id string, status string, text string, supporting_evidence_ids array<string>, contradicting_evidence_ids array<string>")
    active = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "evidence_id string")
    schema = "draft_id string, status string, text string, supporting_evidence_ids array<string>, contradicting_evidence_ids array<string>, source_candidate_ids array<string>"
    good = spark.createDataFrame([("d", "OBSERVED", "Fuel low", ["e2", "e1"], ["e3"], ["c1", "c2"])], schema)
    assert promotion.claim_errors(c, good, active).count() == 0 and promotion.coverage_errors(c, good).count() == 0
    bad = spark.createDataFrame([("d", "INFERRED", "Fuel high", ["e1"], ["e3"], ["c1", "c1"])], schema)
    assert {e for _, e in rows(promotion.claim_errors(c, bad, active))} >= {"CHANGED_STATUS", "CHANGED_TEXT", "CHANGED_CONTRADICTING_EVIDENCE_IDS"}
    assert rows(promotion.coverage_errors(c, bad), "candidate_id", "error") == [("c1", "CANDIDATE_REUSED"), ("c2", "UNUSED_CANDIDATE")]


def test_entities_merge_by_shared_names_only(spark):
    c = spark.createDataFrame([("c1", "PART", ["Pump", "Fuel pump"]), ("c2", "PART", ["fuel  pump", "P-1"]), ("c3", "PART", ["Valve"])], "candidate_id string, type string, names array<string>")
    schema = "draft_id string, type string, canonical_name string, aliases array<string>, source_candidate_ids array<string>"
    good = spark.createDataFrame([("d", "PART", "Pump", ["fuel pump", "p-1"], ["c1", "c2"])], schema)
    assert promotion.entity_errors(c, good).count() == 0
    bad = spark.createDataFrame([("d", "PART", "Rotor", ["fuel pump"], ["c1", "c2", "c3"])], schema)
    assert {e for _, e in rows(promotion.entity_errors(c, bad))} == {"DISTINCT_IDENTITIES", "CANONICAL_NOT_SUPPLIED", "ALIASES_CHANGED"}


def test_overlap_of_exactly_three_quarters_is_allowed(spark):
    df = spark.createDataFrame([("g", 1, ["a", "b", "c"]), ("g", 2, ["a", "b", "c", "d"]), ("h", 1, []), ("h", 2, [])], "g string, id int, tokens array<string>")
    assert rows(promotion.too_similar(df, "g", "id", "tokens"), "g") == [("h",)]
    t = spark.createDataFrame([("Fuel–pump pressure ABNORMAL abnormal",), ("ＦＵＥＬ pump Pressure abnormal!",)], "t string").select(english.folded_tokens("t").alias("w")).collect()
    assert t[0].w == t[1].w


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (700, 700)], "a long, b long")
    got = dict(rows(components.connected_components(edges)))
    assert {got[i] for i in range(n + 1)} == {0} and got[501] == 500 and got[700] == 700


def test_stemmer():
    pairs = {"caresses": "caress", "flies": "fli", "dying": "die", "happily": "happili", "generalization": "general", "running": "run", "hopping": "hop", "hoping": "hope", "national": "nation", "skies": "sky", "knightly": "knight", "consignment": "consign", "sensational": "sensat", "agreed": "agre", "controll": "control"}
    assert {w: english.stem(w) for w in pairs} == pairs


def brute_covers(hits):
    """All narrowest intervals that hold every term, by trying each pair of ends."""
    at = sorted({p for h in hits for p in h})
    covers = [(a, b) for a in at for b in at if a <= b and all(any(a <= p <= b for p in h) for h in hits)]
    covers = [c for c in covers if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in covers)]
    total = sum(0.1 / (1 + max(0, (b - a) - (sum(a <= p <= b for h in hits for p in h) - 1))) for a, b in covers)
    return total / (1 + total)


def test_cover_density():
    import random

    random.seed(4)
    for _ in range(300):
        spots = random.sample(range(1, 30), random.randint(3, 12))
        hits = [sorted(spots[k::3]) for k in range(3)]
        assert abs(retrieval.cover_density(hits) - brute_covers(hits)) < 1e-12


def test_search(spark):
    docs = spark.createDataFrame([(1, "Engine power decreased before landing", "TEXT", "TEXT"), (2, "The power of the engines", "TABLE", "TEXT"), (3, "Weather was fine", "TEXT", "TEXT")], "doc_id long, text string, evidence_type string, document_type string")
    schema = "query_id long, query_text string, evidence_types array<string>, document_types array<string>, entity_ids array<long>, start_at timestamp, end_at timestamp, limit int"
    q = spark.createDataFrame([(1, "the engine's powers", [], [], [], None, None, 10), (2, "engine power", ["TABLE"], [], [7], None, None, 10), (3, "the of", [], [], [], None, None, 10)], schema)
    links = spark.createDataFrame([(2, 7)], "doc_id long, entity_id long")
    got = retrieval.search(retrieval.positions(docs, "doc_id", "text"), docs, q, "doc_id", entity_links=links).collect()
    found = {(r.query_id, r.doc_id): r for r in got}
    assert (1, 1) not in found or found[(1, 1)].rank == 1  # a lone s is a term of its own in this tokeniser
    r = found[(2, 2)]
    assert r.rank == 1 and r.entity_score == 1 and r.type_score == 1 and r.matched_filters == ["evidence_type", "entity"]
    assert not any(k[0] == 3 for k in found)


def test_weighted_scores(spark):
    d = lambda x: F.lit(x).cast("decimal(38,20)")
    f = lambda *v: {k: d(x) for k, x in zip(("fts", "entity", "time", "type"), v, strict=False)}
    h = lambda *v: {k: d(x) for k, x in zip(("vector", "fts", "entity", "time", "type"), v, strict=False)}
    w = retrieval.HYBRID_WEIGHTS
    scores = [retrieval.weighted_score(f(".4", ".5", "1", "1")), retrieval.weighted_score(f(".4")), retrieval.weighted_score(f(".003")), retrieval.weighted_score(f(".123456", ".222222")), retrieval.weighted_score(h(".8", ".4", ".5", "1", "1"), w), retrieval.weighted_score(h(".001", "0"), w), retrieval.weighted_score(f("1.5"))]
    got = [str(x) for x in spark.range(1).select(*(s.alias(f"s{i}") for i, s in enumerate(scores))).first()]
    assert got == ["0.5700", "0.2200", "0.0017", "0.1123", "0.6750", "0.0004", "None"]


@pytest.mark.parametrize(("hits", "base", "passed"), [((10, 9, 5, 4), 5, True), ((9, 9, 5, 4), 5, False), ((10, 0, 0, 0), 0, False), ((10, 10, 7, 3), 5, False)])
def test_recall_gate(spark, hits, base, passed):
    ids = [f"e{i}" for i in range(20)]
    data = [(f"q{i}", c, ids, ids[:base], ids[: hits[i % 4]]) for i, c in enumerate(vocabulary.PROBE_CATEGORIES * 3)]
    r = retrieval.recall_gate(spark.createDataFrame(data, "query_id string, category string, expected array<string>, baseline array<string>, hybrid array<string>")).first()
    assert r.error is None and r.passed is passed


def test_recall_gate_is_exact(spark):
    schema = "query_id string, category string, expected array<string>, baseline array<string>, hybrid array<string>"

    def judged(*gains, names=vocabulary.PROBE_CATEGORIES):
        """Three samples a category, of denominators 3, 7 and 11, with these gains."""
        data = []
        for c, own in zip(names, gains, strict=True):
            for i, (n, g) in enumerate(zip((3, 7, 11), own, strict=True)):
                ids = [f"e{x}" for x in range(n)]
                data.append((f"{c}{i}", c, ids, ids[: max(0, -g)], ids[: max(0, g)]))
        return retrieval.recall_gate(spark.createDataFrame(data, schema)).first()

    from fractions import Fraction

    for gains in [((1, 1, 1), (0, 1, 0), (0, 0, 0), (0, 0, 0)), ((1, 0, 0), (0, 2, 1), (1, 0, 0), (0, 0, -1)), ((2, 1, 1), (1, 0, 0), (0, 0, -2), (0, 0, 0)), ((0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1))]:
        each = [sum(Fraction(g, n) for g, n in zip(own, (3, 7, 11), strict=True)) for own in gains]
        want = sum(each) / 12 >= Fraction(1, 10) and sum(g > 0 for g in each) >= 2 and all(g / 3 >= -Fraction(1, 20) for g in each)
        assert judged(*gains)[:] == (None, want), gains
    assert judged(*[(1, 1, 1)] * 4, names=("A", "B", "C", "D")).error == "CATEGORY_MISSING"


def test_search_query_rules_and_guard(spark):
    schema = "query_id int, intent string, query_text string, start_at timestamp, end_at timestamp, limit int, config_version string"
    q = spark.createDataFrame([(1, "SUPPORT", "x", None, None, 50, "fts-v1"), (2, "X", " ", CUTOFF, CUTOFF.replace(year=2000), 51, "v2"), (3, "NEUTRAL", "a\0b", None, CUTOFF, 0, "fts-v1"), (4, "NEUTRAL", "y" * 4097, None, None, 1, "fts-v1")], schema)
    assert rows(retrieval.query_errors(q)) == [(2, "BLANK_TEXT"), (2, "CONFIG"), (2, "INTENT"), (2, "INTERVAL"), (2, "LIMIT"), (3, "LIMIT"), (3, "NUL_TEXT"), (4, "LONG_TEXT")]
    with pytest.raises(PermissionError):
        retrieval.searchable("evaluation", q, q, q, q)
    lists = spark.createDataFrame([(["b", "a", "b"], None, [2, 1])], "evidence_types array<string>, document_types array<string>, entity_ids array<long>")
    assert retrieval.normalized_queries(lists).first()[:] == (["a", "b"], [], [1, 2])


@pytest.mark.parametrize("config", ["simple", "english"])
def test_matches_with_and_without_an_index(spark, config):
    import random

    rng = random.Random(8)
    words = ["the", "of", "engine", "engines", "valve", "Weather", "rare", "power"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, [9, 9, 3, 3, 2, 2, 1, 2], k=12)) if i % 17 else None) for i in range(150)], "doc_id long, text string")
    asked = [(i, " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(25)] + [(90, "absent the"), (91, "")]
    terms = retrieval.query_terms(spark.createDataFrame(asked, "query_id long, query_text string"), config=config)
    flat = lambda df: sorted((r.query_id, r.doc_id, str(r.hits)) for r in df.collect())
    assert flat(retrieval.matches_in(docs, terms, "doc_id", "text", config)) == flat(retrieval.matches(retrieval.positions(docs, "doc_id", "text", config), terms, "doc_id")) != []


@pytest.mark.parametrize("config", ["simple", "english"])
def test_hits_are_the_positions_of_the_terms(spark, config):
    docs = spark.createDataFrame([(1, "Engine engines powering the power"), (2, "the weather"), (3, None)], "doc_id long, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(1, "the engine power"), (2, "weather")], "query_id long, query_text string"), config=config)
    whole = retrieval.positions(docs, "doc_id", "text", config).join(terms.select("term").distinct(), "term", "left_semi")
    assert rows(retrieval.hits(docs, terms, "doc_id", "text", config), "doc_id", "term", "position") == rows(whole, "doc_id", "term", "position") != []


def test_nearest_in_blocks(spark):
    import random

    rng = random.Random(4)
    data = [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)
    want = sorted((q, i, r) for q, v in data if q % 50 == 0 for r, (i, _) in enumerate(sorted(((i, cos(v, w)) for i, w in data), key=lambda x: (-x[1], x[0]))[:7], 1))
    for block in (2048, 16):
        assert rows(retrieval.nearest(df.where("vec_id % 50 = 0"), df, 7, block=block), "query_id", "vec_id", "rank") == want


def test_time_hits_in_buckets(spark):
    import random
    from datetime import timedelta

    rng = random.Random(5)
    at = [CUTOFF + timedelta(hours=rng.choice([0, 0, 0, 1, 5, rng.randrange(999)])) for _ in range(300)]
    links = spark.createDataFrame([(i, t if i % 9 else None) for i, t in enumerate(at)], "id long, occurred_at timestamp")
    spans = [(q, CUTOFF + timedelta(hours=rng.randrange(1000)) if q % 4 else None, CUTOFF + timedelta(hours=rng.randrange(1000)) if q % 3 else None) for q in range(40)]
    windows = spark.createDataFrame([*spans, (99, CUTOFF, CUTOFF)], "query_id long, start_at timestamp, end_at timestamp")
    want = sorted((q, i) for q, a, b in [*spans, (99, CUTOFF, CUTOFF)] for i, t in enumerate(at) if (a or b) and i % 9 and (a is None or t >= a) and (b is None or t <= b))
    for n, compared in ((256, 256), (256, 5), (4, 5)):
        assert rows(retrieval.time_hits(links, windows, "id", n, compared=compared), "query_id", "id") == want
    assert retrieval.time_hits(links.where("false"), windows, "id").count() == 0


def test_deep_trees_and_cycles(spark):
    chain = spark.range(300).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_span_id"))
    assert rows(relational.ancestors(chain)) == [(i, 0, i) for i in range(300)]
    with pytest.raises(ValueError):
        relational.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent_span_id long"))


def test_scratch_tables_end(spark):
    import os

    from quillstone.functions.storage import durable, scratch

    path = lambda df: df._durable_path
    with scratch() as outer:
        with scratch() as inner:
            a, b = durable(spark.range(3), "a"), inner.keep(durable(spark.range(4), "b"))
            assert os.path.exists(path(a))
        assert not os.path.exists(path(a)) and b.count() == 4
        c = outer.keep(durable(spark.range(5), "c"))
    assert not os.path.exists(path(b)) and c.count() == 5


def test_integrity(spark):
    h = spark.createDataFrame([("c", 1, "ACQUIRING", None), ("c", 2, "BLIND", CUTOFF), ("c", 3, "REVEALED", CUTOFF), ("d", 1, "LOCKED", CUTOFF), ("d", 2, "LOCKED", None)], "id string, n int, state string, evidence_cutoff timestamp")
    assert rows(integrity.illegal_transitions(h, ["id"], [F.col("n")], "state"), "id", "n") == [("c", 3)]
    assert rows(integrity.moved_cutoffs(h, ["id"], [F.col("n")]), "id", "n") == [("d", 2)]
    urls = ["https://docs.agency.gov/x", "https://agency.gov.evil.com/", "https://user@AGENCY.gov:8080/p", "ftp//agency.gov", "https://fake-agency.gov"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r.ok for r in df.orderBy("i").select(integrity.host_allowed(F.col("u"), "agency.gov").alias("ok")).collect()] == [True, False, True, False, False]


def test_jobs_and_batches(spark):
    u = spark.createDataFrame([("i", n, "h") for n in range(7)], "investigation_id string, unit_id int, input_hash string")
    none = spark.createDataFrame([], "investigation_id string, stage string, work_key string, input_hash string")
    assert rows(jobs.work_list("PROMOTE_CLAIMS", u, none), "work_key") == [("0",), ("1",), ("2",)]
    assert rows(jobs.work_list("VERIFY_REPLAY", u, none), "work_key") == [("case",)]
    assert spark.range(1).select(jobs.next_stage(F.lit("VERIFY_REPLAY")).alias("n"), jobs.next_stage(F.lit("COMPLETE")).alias("z")).first()[:] == ("COMPLETE", None)
    g = spark.createDataFrame([("c", i, n) for i, n in enumerate([60, 50, 150, 10, 90])], "c string, o int, n long")
    assert [b for *_, b in rows(relational.pack_groups(g, "c", "o", "n", 100), "o", "batch_no")] == [0, 1, 2, 3, 3]
