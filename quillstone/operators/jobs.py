"""Read-only views of the job queue, spans and model requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V
from quillstone.functions.json_fields import fields, has_keys, kind_of, other_keys
from quillstone.operators.relational import row_batches

LEASE_MINUTES, MAX_ATTEMPTS = 30, 3


def work_list(stage: str, units: DataFrame, existing: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Jobs of a stage that are not queued: batches of three candidates, or one per
    hypothesis, test or investigation. ``units`` has investigation_id, unit_id,
    input_hash; ``existing`` has investigation_id, stage, work_key, input_hash."""
    if stage in ("PROMOTE_TIMELINE", "RESOLVE_ENTITIES", "PROMOTE_CLAIMS"):
        batched = row_batches(units, ["investigation_id"], order or [F.col("unit_id")])
        keyed = batched.select("investigation_id", F.col("batch_no").cast("string").alias("work_key"), "input_hash").distinct()
    elif stage in ("REVISE_CONFIDENCE", "VERIFY_REPLAY", "COMPLETE", "GENERATE_HYPOTHESES"):
        keyed = units.select("investigation_id", F.lit("case").alias("work_key"), "input_hash").distinct()
    else:
        keyed = units.select("investigation_id", F.col("unit_id").cast("string").alias("work_key"), "input_hash").distinct()
    jobs = keyed.withColumn("stage", F.lit(stage))
    return jobs.join(existing, ["investigation_id", "stage", "work_key", "input_hash"], "left_anti")


def expired(attempts: DataFrame, now: Column) -> DataFrame:
    return attempts.where((F.col("status") == "RUNNING") & (F.col("leased_at") + F.expr(f"interval {LEASE_MINUTES} minutes") <= now))


def claimable(jobs: DataFrame) -> DataFrame:
    """The next pending job of each investigation that has none running."""
    busy = jobs.where("status = 'RUNNING'").select("investigation_id")
    open_ = jobs.where((F.col("status") == "PENDING") & (F.col("attempts") < MAX_ATTEMPTS)).join(busy, "investigation_id", "left_anti")
    w = W.partitionBy("investigation_id").orderBy("created_at", "work_key", "id")
    return open_.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def stage_complete(jobs: DataFrame) -> DataFrame:
    """investigation_id, stage, next_stage of the stages whose jobs all succeeded."""
    done = jobs.groupBy("investigation_id", "stage").agg(F.bool_and(F.col("status") == "SUCCEEDED").alias("done")).where("done")
    return done.select("investigation_id", "stage", next_stage(F.col("stage")).alias("next_stage"))


def next_stage(stage: Column) -> Column:
    stages = F.array(*map(F.lit, V.STAGES))
    at = F.array_position(stages, stage)
    return F.when(at > 0, F.get(stages, at.cast("int")))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times, zero at least."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000))


def span_errors(spans: DataFrame) -> DataFrame:
    """id, error of spans (id, investigation_id, job_id, parent_span_id, status,
    completed_at) whose parent is not of their job, or whose end does not fit."""
    parents = spans.select(F.col("id").alias("parent_span_id"), "investigation_id", "job_id").distinct()
    lost = spans.where("parent_span_id is not null").join(parents, ["parent_span_id", "investigation_id", "job_id"], "left_anti").select("id", F.lit("PARENT_CONTEXT").alias("error"))
    running = F.col("status") == "RUNNING"
    ended = F.col("status").isin("SUCCEEDED", "FAILED") & F.col("completed_at").isNotNull()
    return lost.unionByName(spans.where(~F.coalesce((running & F.col("completed_at").isNull()) | ended, F.lit(False))).select("id", F.lit("TRANSITION").alias("error")))


def close_expired(spans: DataFrame, attempts: DataFrame) -> DataFrame:
    """``spans`` (id, job_id, status, started_at, completed_at and duration_ms among
    them) in which those still running are FAILED where an attempt of their job, begun
    before them, lost its lease: they end when the first such attempt did."""
    lost = attempts.where("outcome = 'LEASE_EXPIRED'").select(F.col("job_id").alias("lost_job"), F.col("started_at").alias("lost_start"), F.col("completed_at").alias("lost_end"))
    open_ = spans.where("status = 'RUNNING'").select("id", "job_id", "started_at")
    ends = open_.join(lost, (F.col("job_id") == F.col("lost_job")) & (F.col("started_at") >= F.col("lost_start"))).groupBy("id").agg(F.min("lost_end").alias("closed_at"))
    both = spans.join(ends, "id", "left")
    closed = F.col("closed_at").isNotNull()
    changed = {"status": F.when(closed, "FAILED").otherwise(F.col("status")), "duration_ms": F.when(closed, duration_ms(F.col("started_at"), F.col("closed_at"))).otherwise(F.col("duration_ms")), "completed_at": F.coalesce("closed_at", "completed_at")}
    return both.withColumns(changed).select(*spans.columns)


def request_errors(requests: DataFrame) -> DataFrame:
    """id, error of finished requests (id, status, validation_issues as JSON): issues are
    an array of objects of a path and a code only, and only failed schemas have any."""
    issues = F.from_json("validation_issues", "array<string>")
    wrong = F.exists(issues, lambda i: (kind_of(i) != "object") | ~has_keys(i, ("path", "code")) | (F.size(other_keys(i, ("path", "code"))) > 0) | (kind_of(fields(i)["path"]) != "array") | (kind_of(fields(i)["code"]) != "string"))
    rules = {
        "ISSUES": ~kind_of(F.col("validation_issues")).eqNullSafe("array"), "ISSUE_FORM": wrong, "STATUS": ~F.coalesce(F.col("status").isin("SUCCEEDED", "SCHEMA_FAILED", "PROVIDER_FAILED"), F.lit(False)),
        "UNEXPECTED_ISSUES": (F.col("status") != "SCHEMA_FAILED") & (F.size(issues) > 0),
    }
    return requests.select("id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), n) for n, r in rules.items())))).alias("error"))


def request_accounts(requests: DataFrame) -> DataFrame:
    """job_id, requests, retries, schema_failures, succeeded."""
    return requests.groupBy("job_id").agg(
        F.count("*").alias("requests"), F.greatest(F.count("*") - 1, F.lit(0)).alias("retries"),
        F.count_if(F.col("status") == "SCHEMA_FAILED").alias("schema_failures"), F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"),
    )


def latency_summary(calls: DataFrame) -> DataFrame:
    """calls, valid, mean_s by model and shape."""
    return calls.groupBy("model", "shape").agg(F.count("*").alias("calls"), F.count_if(F.col("valid")).alias("valid"), F.round(F.avg("seconds"), 3).alias("mean_s"))
