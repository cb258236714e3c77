"""The pipeline on the smallest tables, stage by stage."""

from __future__ import annotations

import collections
import os

import pytest
from pyspark.sql import functions as F

from quillstone.llm import word_ids
from tests.llm.test_llm import brute_near, brute_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(after) and set(after) <= set(before)
        if name == "quality":
            clean = [i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
            assert sum(i in after for i in clean) >= 0.97 * len(clean)
            junk = [i for i in before if i in labels and labels[i].quality == 0]
            assert sum(i in after for i in junk) <= 0.1 * len(junk)
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i], i)
            assert after == {i: t for t, i in first.items()}
        if name == "near_dedup":  # exact Jaccard of all pairs
            ids = sorted(before)
            assert set(after) == {ids[i] for i in brute_near([before[i] for i in ids])} and all(before[i] == t for i, t in after.items())
        if name == "pii":
            for i, t in after.items():  # every base span is gone, and what is not masked is as before
                spans = brute_spans(before[i] or "")
                assert all((before[i] or "")[a:b] not in t for a, _, b in spans)
                if not spans and "[" not in t:
                    assert t == before[i]
            assert set(after) == set(before) and not any("@mail" in t for t in after.values())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokens, windows = collections.Counter(), collections.Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
        windows[r.sequence_id] += r.length
    tokenizer = word_ids.WordBpe.of(None).tokenizer
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
    assert set(tokens) == set(before) and all(tokens[r.doc_id] == r.doc_tokens for r in pieces) and max(windows.values()) <= 4096


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_odd_documents(spark):
    """Null, empty, very long and repeated texts, null and repeated ids, extra columns
    with the names that stages use inside, and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(None, "no id", "en"), (900, None, None), (901, "", "xx"), (902, " \n", "en"), (903, "long words " * 60_000, "en"), (904, "twice the same text", "en"), (904, "twice the same text", "en"), (905, "twice the same text", "en"), (906, "x" * 200_000, None), (907, "write to bob@mail.org " * 500, "en")]
    rows = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in odd], docs.schema)
    names = ["gone_id", "id", "lang_", "symbols", "cost", "span_found", "span_chosen", "group_bytes", "in_group", "excess", "threshold", "fp", "node", "size", "piece_no", "lane", "length"]
    docs = docs.unionAll(rows).withColumns({n: F.lit(f"x-{n}") for n in names})
    empty = docs.where("false")
    once = [r.doc_id for r in corpus_pipeline.exact_stage(spark, docs, SF).collect() if r.doc_id is None or r.doc_id >= 900]
    assert sorted(once, key=str) == [900, 902, 903, 904, 906, 907, None]
    near = [r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect() if r.doc_id is None or r.doc_id >= 900]
    assert sorted(near, key=str) == [900, 903, 904, 904, 906, 907, None]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.durable(stage(spark, docs, SF), name)
        assert kept.schema.names == docs.schema.names and kept.count() <= docs.count()
        assert kept.where(F.concat_ws(",", *names) != F.lit(",".join(f"x-{n}" for n in names))).count() == 0
        assert stage(spark, empty, SF).count() == 0
        docs = kept
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left.get(907) is None or left[907] == "write to [EMAIL] " * 500
    last = corpus_pipeline.STAGES[-1][1]
    pieces = last(spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()
    assert len(pieces) == len(left) and all(r.n == r.tokens for r in pieces) and last(spark, empty, SF).count() == 0
