"""What the third round's findings were about."""

import json

from pyspark.sql import functions as F

from quillstone.functions import canonical
from quillstone.operators import events
from tests.test_operators import LOG, as_events, good_log, rows


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_contract_parses_a_payload_once(spark):
    """No filter repeats the rules."""
    log = events.append(spark.createDataFrame([], LOG))
    plan = plan_of(events.each(events.with_contract_errors(log).select("sequence", "errors"), "errors", "error"))
    assert plan.count("from_json(") == 1 and not [line for line in plan.splitlines() if "Filter" in line and "from_json" in line]


def test_texts_are_escaped_as_json(spark):
    data = ["", "plain", 'a"b', "back\\slash", "\\u001F", "\x1f\x0b\\\x1a", "tab\t\n", "\x7fé 😀", "/", None]
    got = spark.createDataFrame(list(enumerate(data)), "i int, x string").orderBy("i").select(canonical.string_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [None if x is None else json.dumps(x, ensure_ascii=False) for x in data]


def test_a_log_is_chained_where_it_is_dealt(spark):
    """One small shuffle: no sort or exchange has a payload."""
    from quillstone.plans import logs

    plan = logs.log(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "payload" not in "".join(line for line in plan.splitlines() if "Sort [" in line or "Exchange" in line)


def test_a_state_is_made_in_one_reading(spark):
    """Nothing is written for it, the log is scanned and dealt once, and kinds may be named."""
    import os

    from quillstone.functions.storage import shared_dir
    from quillstone.operators import replay

    log = as_events(spark, good_log())
    before = set(os.listdir(shared_dir(spark)))
    state = replay.replay_state(log)
    assert set(os.listdir(shared_dir(spark))) == before and plan_of(state).count("Aggregate") == 1 and plan_of(state).count("Join") == 0
    some = replay.replay_state(log, kinds=["hypothesis", "links"])
    assert rows(some) == [r for r in rows(state) if r[1] in ("hypothesis", "links")] and len({r[1] for r in rows(some)}) == 2
    assert replay.replay_lifecycle(log).first().events == len(good_log())


def test_a_fold_deals_no_hashes(spark, monkeypatch):
    """Neither way of reading newer events ships an event's hashes, and both give the same."""
    from quillstone.operators import replay_fold

    log = as_events(spark, good_log())
    made = []
    keep = lambda df, label: made.append(df) or df
    whole = rows(replay_fold.fold(log)[1], "sequence", "event_hash", "state")
    _, kept = replay_fold.fold(log.where("sequence <= 9"))
    monkeypatch.setattr(replay_fold, "durable", keep)
    for few in (lambda df: df, replay_fold.sized_broadcast):
        monkeypatch.setattr(replay_fold, "sized_broadcast", few)
        errors, late = replay_fold.fold(log, kept)
        assert errors.count() == 0 and rows(late, "sequence", "event_hash", "state") == whole
        assert "event_hash" not in plan_of(made[-1]).split("RepartitionByExpression")[0] and "RepartitionByExpression" in plan_of(made[-1])


def test_blocks_of_long_lists_lose_no_pair(spark, monkeypatch):
    """Sets over whole tables, equal ones told as pairs, in blocks of a few members; no pair is
    made of a posting list by a join."""
    import random

    from quillstone.operators import promotion

    rng = random.Random(3)
    base = [[f"w{i}-{j}" for j in range(n)] for i, n in enumerate((7, 14, 30, 700))]
    data = [(k % 2, k, [w for w in rng.choice(base) if rng.random() < 0.95]) for k in range(90)] + [(0, 100 + k, list(base[1])) for k in range(6)]
    want = [(g, a, b, len({*s} & {*t}), len({*s} | {*t})) for g, a, s in data for h, b, t in data if g == h and a < b and 4 * len({*s} & {*t}) > 3 * len({*s} | {*t})]
    monkeypatch.setattr(promotion, "LIST_MEMBERS", 4)
    got = promotion.too_similar(spark.createDataFrame(data, "lang int, doc_id long, tokens array<string>"), "lang", "doc_id", "tokens")
    assert rows(got, "lang", "left_id", "right_id", "shared", "total") == sorted(want) and len(want) > 100


def test_job_tasks_are_bounded_by_rows(spark, monkeypatch):
    """More jobs and commands are dealt into more parts than the session's own."""
    from quillstone.operators import job_commands

    made = []
    monkeypatch.setattr(job_commands, "durable", lambda df, label: made.append(df) or df)
    monkeypatch.setattr(job_commands, "ROWS", 10)
    schema = "id string, investigation_id string, stage string, work_key string, status string, attempt_count int, model_request_count int, worker_id string, claimed_at timestamp, lease_expires_at timestamp, failure_code string, created_at timestamp, completed_at timestamp"
    jobs = spark.createDataFrame([(f"j{i}", str(i), "s", "0", "PENDING", 0, 0, *[None] * 6) for i in range(60)], schema)
    commands = spark.createDataFrame([(i, str(i), None, "CLAIM", "w", None, None, None) for i in range(60)], "command_no long, investigation_id string, at timestamp, kind string, worker_id string, job_id string, attempt int, failure_code string")
    job_commands.run_commands(jobs.select("investigation_id", "status", F.col("stage").alias("current_stage")), jobs, commands)
    assert ", 12" in next(line for line in plan_of(made[0]).splitlines() if "RepartitionByExpression" in line)


def test_postings_are_handed_on_in_parts(spark, monkeypatch):
    from quillstone.operators import search_index

    docs = spark.createDataFrame([(i, [f"w{x % (i + 1)}" for x in range(9)] if i else []) for i in range(20)], "id long, words array<string>")
    whole = rows(search_index._places(docs, "bigint", "simple"))
    monkeypatch.setattr(search_index, "POSTINGS", 3)
    assert whole and rows(search_index._places(docs, "bigint", "simple")) == whole


def test_drafts_are_joined_with_candidates_once(spark, monkeypatch):
    from quillstone.operators import promotion

    made = []
    monkeypatch.setattr(promotion, "durable", lambda df, label: made.append(df) or df)
    c = spark.createDataFrame([(1, "s", "a  B", [1], [2]), (2, "s", "A b", [3], None), (3, "t", "c", [], [9])], "candidate_id long, status string, text string, supporting_evidence_ids array<long>, contradicting_evidence_ids array<long>")
    d = spark.createDataFrame([("good", "s", "a b", [3, 1], [2], [1, 2]), ("bad", "s", "x", [1], [9], [1, 3])], "draft_id string, status string, text string, supporting_evidence_ids array<long>, contradicting_evidence_ids array<long>, source_candidate_ids array<long>")
    got = rows(promotion.claim_errors(c, d, spark.createDataFrame([(1,), (2,), (3,)], "evidence_id long")))
    assert got == [("bad", f"CHANGED_{x}") for x in ("CONTRADICTING_EVIDENCE_IDS", "STATUS", "TEXT")] + [("bad", "INACTIVE_EVIDENCE")]
    assert len(made) == 1 and plan_of(made[0]).count("Join") == 1


def test_identities_of_a_draft_in_one_pass(spark):
    """Equal to the components of all names; no table is written."""
    import random

    from quillstone.operators import promotion

    rng = random.Random(5)
    c = [(i, "T", [f"N{i // 8 * 8 + rng.randrange(9)}" for _ in range(rng.randrange(4))]) for i in range(160)]
    names = spark.createDataFrame([(i // 8, i, n) for i, _, ns in c for n in ns], "draft_id long, candidate_id long, name string")
    drafts = spark.createDataFrame([(g, "U" if g == 3 else "T", "x", [], list(range(g * 8, g * 8 + 8))) for g in range(20)], "draft_id long, type string, canonical_name string, aliases array<string>, source_candidate_ids array<long>")
    found = promotion.entity_errors(spark.createDataFrame(c, "candidate_id long, type string, names array<string>"), drafts)
    want = [r[0] for r in promotion.entity_components(names).groupBy("draft_id").agg(F.count_distinct("component").alias("n")).where("n > 1").collect()]
    assert sorted(r.draft_id for r in found.where("error = 'DISTINCT_IDENTITIES'").collect()) == sorted(want) and 0 < len(want) < 20
    assert rows(found.where("error = 'CHANGED_TYPE'")) == [("3", "CHANGED_TYPE")] and plan_of(found).count("Join") == 2


def test_a_grown_heap_is_collected(spark, monkeypatch):
    """What a durable write leaves behind goes at once where the heap is over its share."""
    from quillstone.functions import storage

    jvm = spark.sparkContext._jvm
    left = [jvm.java.lang.ref.WeakReference(jvm.java.lang.Object()) for _ in range(2)]
    monkeypatch.setattr(storage, "HEAP_SHARE", 0.0, raising=False)
    storage.durable(spark.range(3), "three")
    jvm.java.lang.Thread.sleep(200)  # references through the bridge end in the background
    storage.durable(spark.range(3), "three")
    assert any(r.get() is None for r in left)


def test_lines_of_executed_tests_are_dealt_once(spark, monkeypatch):
    """What is planned after a case's lines were gathered reads no line again."""
    from quillstone.operators import falsification
    from quillstone.plans import logs

    given = []
    monkeypatch.setattr(falsification, "execute", lambda *frames: given.extend(frames) or frames[0].selectExpr("test_id", "'' outcome", "'' error"))
    logs.executed_tests(spark, "/root/testdata/sf0.001")
    assert len(given) == 4 and not any("lineitem" in f for frame in given for f in frame.inputFiles())


def test_a_small_sheet_is_parsed_once(monkeypatch):
    """A sheet is read again only where its rows are more than are held."""
    import io
    import zipfile

    from quillstone.plans import stored
    from quillstone.sources import tables

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in stored._PARTS.items():
            z.writestr(name, text)
        cells = "".join(f"<row>{'<c><v>1</v></c>' * n}</row>" for n in (1, 3, 2))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{stored._MAIN}"><sheetData>{cells}</sheetData></worksheet>')
    want = [("Orders", ["1", "", ""], [["1", "1", "1"], ["1", "1", ""]])]
    for held, parsed in ((3, 3), (2, 6), (1, 6), (0, 6)):
        seen = []
        monkeypatch.setattr(tables, "BATCH_OF_ROWS", held)
        monkeypatch.setattr(tables, "_row_values", lambda *x, f=tables._row_values: seen.append(x) or f(*x))
        assert tables.read_sheets(out.getvalue()) == want and len(seen) == parsed
        monkeypatch.undo()
