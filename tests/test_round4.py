from __future__ import annotations

from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_tokens_do_not_go_with_each_pair(spark, monkeypatch):
    """Of 80 sets that are all alike, each goes to the groups of blocks that it has pairs in, and
    none of their tokens is shuffled before pairs are known."""
    from quillstone.operators import promotion

    base = [f"w{i}" for i in range(100)]
    data = [(1, k, [*base, f"own{k}"]) for k in range(80)]
    df = spark.createDataFrame(data, "g int, id long, tokens array<string>")
    grouped, sent = promotion._grouped, []
    monkeypatch.setattr(promotion, "_grouped", lambda *a: sent.append(grouped(*a)) or sent[-1])
    monkeypatch.setattr(promotion, "BLOCK_SETS", 30)
    found = promotion.too_similar(df, "g", "id", "tokens")
    assert rows(found, "left_id", "right_id", "shared", "total") == sorted(((a, b, 100, 102) for a in range(80) for b in range(a + 1, 80)), key=str)
    n, pairs = sent[0].agg(F.count("tokens"), F.count("b")).first()
    assert pairs == 80 * 79 // 2 and n <= 80 * promotion.SPREAD
    assert sent[0].where("tokens is not null").groupBy("low", "high").count().where("count > 60").isEmpty()


def test_lists_run_over_batches():
    """Runs of equal keys are whole, however their rows are batched; runs of one row are left out."""
    import pyarrow as pa

    from quillstone.operators import promotion

    keys = [1] * 5 + [2] + [3] * 4 + [4, 5, 5]
    table = pa.table({"list": keys, "low": [0] * len(keys), "high": [0] * len(keys), "at": range(len(keys))})
    for size in (1, 2, 3, 5, 20):
        found = [t["at"].to_pylist() for t in promotion._lists(iter(table.to_batches(size)))]
        assert found == [[0, 1, 2, 3, 4], [6, 7, 8, 9], [11, 12]]


def test_no_terms_of_candidates_are_broadcast(spark, monkeypatch):
    """What a search sends to all tasks has a row for each candidate at most, not one for each of
    its terms."""
    from quillstone.operators import retrieval, search_index

    docs = [(i, " ".join(f"w{j}" for j in range(30) if (i + j) % 7)) for i in range(300)]
    index = search_index.temporary(spark, "bigint", "simple")
    search_index.append(index, spark.createDataFrame(docs, "id bigint, text string"), "id", "text")
    asked = [(q, " ".join(f"w{j}" for j in range(30) if (q + j) % 7 > 1)) for q in range(7)]
    sent, offer = [], search_index.sized_broadcast
    monkeypatch.setattr(search_index, "sized_broadcast", lambda df: sent.append(df) or offer(df))
    terms = retrieval.query_terms(spark.createDataFrame(asked, "query_id int, query_text string"), config="simple")
    found = search_index.matches(index, terms, "id")
    want = sorted((q, i) for q, text in asked for i, words in docs if {*text.split()} <= {*words.split()})
    assert rows(found, "query_id", "id") == sorted(want, key=str) and len(want) > 200
    assert sent and not any({"id", "term"} <= {*df.columns} for df in sent) and max(df.count() for df in sent) <= 300


def test_a_resumed_replay_parses_newer_events_only(spark, monkeypatch):
    """Events up to an investigation's snapshot are left out before payloads are read."""
    from quillstone.operators import replay_fold

    start = '{"kind": "INVESTIGATION_STARTED", "current_stage": "INGEST"}'
    data = [(inv, i, "INVESTIGATION_STARTED", start, f"{inv}{i - 1}", f"{inv}{i}") for inv in "ab" for i in range(1, 7)]
    log = spark.createDataFrame(data, "investigation_id string, sequence long, event_type string, payload string, previous_event_hash string, event_hash string")
    early, kept = replay_fold.fold(log.where("sequence <= 4"))
    read, prepared = [], replay_fold._prepared
    monkeypatch.setattr(replay_fold, "_prepared", lambda events, by: read.append(events) or prepared(events, by))
    late, _ = replay_fold.fold(log, kept)
    assert rows(read[0], "investigation_id", "sequence") == [(inv, i) for inv in "ab" for i in (5, 6)]
    found = rows(early.unionByName(late), "investigation_id", "sequence", "error")
    assert [r for r in found if r[2] == "STARTED_AFTER_START"] == [(inv, i, "STARTED_AFTER_START") for inv in "ab" for i in range(2, 7)]
