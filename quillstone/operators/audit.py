"""Access audit: leakage incidents and the validity of audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V


def leakage_codes(allowed_hosts: list[str]) -> Column:
    """The incident codes of an event joined with its case's context and, by its
    target, with source_visibility, source_published_at, source_eligible (all null
    without a source)."""
    blind = F.col("stage") == "BLIND"
    reads = blind & F.col("capability").isin("EVIDENCE_READ", "RETRIEVAL")
    lost = F.col("target_document_id").isNull() | F.col("source_visibility").isNull()
    late = F.col("source_published_at").isNull() | (F.col("source_published_at") > F.col("evidence_cutoff"))
    evidence = F.col("source_visibility") == "INVESTIGATION_EVIDENCE"
    host = F.coalesce(F.col("network_host").isin(*allowed_hosts), F.lit(False)) if allowed_hosts else F.lit(False)
    rules = {
        "BLIND_BLOCKED_VISIBILITY_READ": reads & ~lost & ~evidence,
        "BLIND_POST_CUTOFF_READ": reads & ~lost & late,
        "CLASSIFICATION_MISMATCH": reads & ~lost & ~F.col("source_eligible").eqNullSafe(evidence & ~late),
        "EVALUATION_BEFORE_LOCK": (F.col("stage") == "EVALUATION") & (F.col("locked_at").isNull() | (F.col("occurred_at") < F.col("locked_at"))),
        "FORBIDDEN_BLIND_CAPABILITY": blind & F.col("capability").isin(*V.FORBIDDEN_BLIND_CAPABILITIES),
        "FORBIDDEN_BLIND_HOST": blind & (F.col("operation") == "NETWORK") & ~host,
        "MALFORMED_AUDIT_EVENT": ~F.col("case_id").eqNullSafe(F.col("context_case_id")) | (reads & lost),
        "POST_LOCK_MUTATION": F.col("stage").isin("PROCESSING", "BLIND") & (F.col("operation") == "WRITE") & (F.col("occurred_at") > F.col("locked_at")),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules.items())))


def leakage_incidents(events: DataFrame, sources: DataFrame, context: DataFrame, allowed_hosts: list[str], audit_case: str = "audit_case_id") -> DataFrame:
    """One row per event and incident code. ``events`` name the audit they belong
    to in ``audit_case``; ``context`` has case_id, evidence_cutoff, locked_at;
    ``sources`` has document_id, visibility, published_at, metadata_eligible."""
    c = context.select(F.col("case_id").alias("context_case_id"), "evidence_cutoff", "locked_at")
    s = sources.select(F.col("document_id").alias("__doc"), F.col("visibility").alias("source_visibility"), F.col("published_at").alias("source_published_at"), F.col("metadata_eligible").alias("source_eligible"))
    joined = events.join(c, F.col(audit_case) == F.col("context_case_id")).join(s, F.col("target_document_id") == F.col("__doc"), "left")
    return joined.select(F.explode(leakage_codes(allowed_hosts)).alias("code"), F.col("id").alias("event_id"), "case_id", "target_document_id", "occurred_at")


def audit_violations() -> Column:
    """Names of the rules that an audit event breaks."""
    stage = F.lit(None).cast("string")
    for actor, expected in V.ACTOR_STAGES.items():
        stage = F.when(F.col("actor_role") == actor, expected).otherwise(stage)
    network, host = F.col("operation") == "NETWORK", F.col("network_host")
    rules = {
        "ACTOR_STAGE": ~stage.eqNullSafe(F.col("stage")),
        "ALLOWED_DENY": (F.col("operation") == "DENY") & F.col("allowed"),
        "BLOCKED_WITHOUT_DENY": ~F.col("allowed") & (F.col("operation") != "DENY"),
        "HOST_FORM": host.isNotNull() & ~host.rlike(V.HOST_NAME),
        "HOST_MISSING": network & host.isNull(),
        "HOST_UNEXPECTED": ~network & host.isNotNull(),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())))
