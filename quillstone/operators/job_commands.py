"""The job queue as a fenced state machine: commands in, the next tables out.

Commands of an investigation are taken in the order of their time; a command that names
a job must hold its lease: the job runs, for that worker, in that attempt, and the lease
has not expired. A claim first gives back expired leases, then takes the next pending job
of the investigation's current stage. Rows are dealt by investigation and streamed; a task
holds one investigation's jobs, never its commands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V
from quillstone.functions.storage import durable, partitions, ship
from quillstone.operators.jobs import LEASE_MINUTES, MAX_ATTEMPTS

MAX_REQUESTS = 3
#: How a worker may say that its job failed.
FAILURES = ("PROVIDER_EXHAUSTED", "SCHEMA_INVALID", "REFERENCE_INVALID", "DIVERSITY_INVALID", "LEASE_EXPIRED", "REPLAY_MISMATCH", "PERSISTENCE_FAILED")
#: Jobs and commands of one task.
ROWS = 200_000
_LEASE = LEASE_MINUTES * 60_000_000

_JOB = ("id", "stage", "work_key", "status", "attempt_count", "model_request_count", "worker_id", "claimed_at", "lease_expires_at", "failure_code", "created_at", "completed_at")
_FREE = {"worker_id": None, "claimed_at": None, "lease_expires_at": None}
_ROW = "what string, inv string, id string, stage string, work_key string, status string, attempt_count int, model_request_count int, worker_id string, claimed_at long, lease_expires_at long, failure_code string, created_at long, completed_at long, no long, error string, ordinal int"


class Queue:
    """One investigation and its jobs."""

    def __init__(self) -> None:
        self.status, self.stage, self.failure, self.jobs = None, None, None, {}

    def _set(self, job: dict, **values: object) -> None:
        job.update(values)

    def _expire(self, now: int) -> None:
        for job in self.jobs.values():
            if job["status"] == "RUNNING" and job["lease_expires_at"] <= now:
                spent = job["attempt_count"] >= MAX_ATTEMPTS or job["model_request_count"] >= MAX_REQUESTS
                self._set(job, status="FAILED" if spent else "PENDING", failure_code="LEASE_EXPIRED", completed_at=now if spent else None, **_FREE)

    def claim(self, now: int, worker: str | None) -> tuple[dict | None, str | None]:
        if not worker or len(worker) > 128:
            return None, "WORKER_REQUIRED"
        if self.status not in ("PENDING", "RUNNING"):
            return None, None
        self._expire(now)
        if any(j["status"] == "FAILED" for j in self.jobs.values()):
            self.status, self.failure = "FAILED", "LEASE_EXPIRED"
            return None, None
        open_ = [j for j in self.jobs.values() if j["stage"] == self.stage and j["status"] == "PENDING" and j["attempt_count"] < MAX_ATTEMPTS]
        if not open_:
            return None, None
        job = min(open_, key=lambda j: (j["created_at"], j["work_key"], j["id"]))
        self._set(job, status="RUNNING", attempt_count=job["attempt_count"] + 1, worker_id=worker, claimed_at=now, lease_expires_at=now + _LEASE, failure_code=None, completed_at=None)
        self.status = "RUNNING"
        return job, None

    def leased(self, c: dict) -> dict | None:
        job = self.jobs.get(c["id"])
        held = job and job["status"] == "RUNNING" and job["worker_id"] == c["worker_id"] and job["attempt_count"] == c["attempt_count"] and job["lease_expires_at"] > c["claimed_at"]
        return job if held else None

    def take(self, c: dict) -> tuple[dict | None, str | None, int | None]:
        """The job, refusal and request number of a command."""
        now = c["claimed_at"]
        if c["status"] == "CLAIM":
            return *self.claim(now, c["worker_id"]), None
        if (job := self.leased(c)) is None:
            return None, "LEASE_LOST", None
        if c["status"] == "RESERVE":
            if job["model_request_count"] >= MAX_REQUESTS:
                return job, "REQUESTS_EXHAUSTED", None
            job["model_request_count"] += 1
            return job, None, job["model_request_count"]
        if c["status"] == "COMPLETE":
            if self.stage != job["stage"] or self.status != "RUNNING":
                return job, "STAGE_NOT_RUNNING", None
            self._set(job, status="SUCCEEDED", completed_at=now, **_FREE)
            if all(j["status"] == "SUCCEEDED" for j in self.jobs.values() if j["stage"] == self.stage):
                place = V.STAGES.index(self.stage) + 1
                if place == len(V.STAGES):
                    self.status = "SUCCEEDED"
                else:
                    self.stage = V.STAGES[place]
            return job, None, None
        if c["status"] == "FAIL":
            if c["failure_code"] not in FAILURES:
                return job, "UNKNOWN_FAILURE", None
            self._set(job, status="FAILED", failure_code=c["failure_code"], completed_at=now, **_FREE)
            self.status, self.failure = "FAILED", c["failure_code"]
            return job, None, None
        return job, "UNKNOWN_COMMAND", None


def run_commands(investigations: DataFrame, jobs: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next investigations and jobs, and what became of each command: command_no,
    investigation_id, job_id, attempt, request (its ordinal), error.

    ``investigations`` has investigation_id, status, current_stage; ``jobs`` id,
    investigation_id, stage, work_key, status, attempt_count, model_request_count, worker_id,
    claimed_at, lease_expires_at, failure_code, created_at, completed_at; ``commands``
    command_no, investigation_id, at, kind (CLAIM, RESERVE, COMPLETE, FAIL), worker_id, job_id,
    attempt, failure_code. Ids are texts. A command that is refused changes nothing; one of
    an unknown investigation is refused. Jobs of unknown investigations stay as they are."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    inv = F.col("investigation_id").cast("string").alias("inv")
    owners = investigations.select(inv, F.lit("0").alias("what"), F.col("status"), F.col("current_stage").alias("stage"))
    times = ("claimed_at", "lease_expires_at", "created_at", "completed_at")
    held = jobs.select(inv, F.lit("1").alias("what"), *(micros(c).alias(c) if c in times else F.col(c) for c in _JOB))
    asked = commands.select(inv, F.lit("2").alias("what"), F.col("kind").alias("status"), "worker_id", F.col("job_id").alias("id"), F.col("attempt").cast("int").alias("attempt_count"), "failure_code", micros("at").alias("claimed_at"), F.col("command_no").cast("long").alias("no"))
    rows = owners.unionByName(held, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    names = [f.split()[0] for f in _ROW.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _ROW.split(", ")])
    whole = rows.withColumns({c: F.lit(None).cast("string") for c in ("error",)} | {"ordinal": F.lit(None).cast("int")}).select(names)
    order = F.when(F.col("what") == "2", F.col("claimed_at"))
    # Rows are of many columns that compress well, so parts are of rows, not of shuffled bytes.
    dealt = whole.repartition(partitions(jobs.select("id").unionByName(commands.select(F.col("job_id").alias("id"))), ROWS), "inv").sortWithinPartitions("inv", "what", order, "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queue, out = None, Queue(), []

        def row(**values: object) -> dict:
            return dict.fromkeys(names) | {"inv": own} | values

        def close() -> None:
            if own is not None:
                if queue.status is not None:
                    out.append(row(what="investigation", status=queue.status, stage=queue.stage, failure_code=queue.failure))
                out.extend(row(what="job", **job) for job in queue.jobs.values())

        def batch_of() -> pa.RecordBatch:
            found = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return found

        for batch in batches:
            for r in batch.to_pylist():
                if r["inv"] != own:
                    close()
                    own, queue = r["inv"], Queue()
                if r["what"] == "0":
                    queue.status, queue.stage = r["status"], r["stage"]
                elif r["what"] == "1":
                    queue.jobs[r["id"]] = {k: r[k] for k in _JOB}
                else:
                    job, error, ordinal = (None, "UNKNOWN_INVESTIGATION", None) if queue.status is None else queue.take(r)
                    out.append(row(what="command", no=r["no"], error=error, ordinal=ordinal, id=job["id"] if job else r["id"], attempt_count=job["attempt_count"] if job else r["attempt_count"]))
            if len(out) > 5000:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    ship(jobs.sparkSession)
    found = durable(dealt.mapInArrow(run, _ROW), "job-commands")
    named = lambda what: found.where(F.col("what") == what)
    kind = jobs.schema["investigation_id"].dataType
    owner = F.col("inv").cast(kind).alias("investigation_id")
    stamp = lambda c: F.timestamp_micros(F.col(c)).alias(c)
    next_jobs = named("job").select(owner, *(stamp(c) if c in times else F.col(c) for c in _JOB))
    results = named("command").select(F.col("no").alias("command_no"), owner, F.col("id").alias("job_id"), F.col("attempt_count").alias("attempt"), F.col("ordinal").alias("request"), "error")
    return named("investigation").select(owner, "status", F.col("stage").alias("current_stage"), "failure_code"), next_jobs, results
