"""Who may see a source: visibility, eligibility, secured views and linking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V


def classify_visibility(document_type: Column, title: Column, published_at: Column, cutoff: Column, final: str = V.FINAL_TITLE, official: str = V.OFFICIAL_TITLE) -> Column:
    """The visibility class of a source; the cutoff is inclusive."""
    label = F.replace(F.concat(F.coalesce(document_type, F.lit("")), F.lit(" "), title), F.lit("_"), F.lit(" "))
    withheld = published_at.isNull() | (published_at > cutoff) | (F.coalesce(document_type, F.lit("")) == "")
    return F.when(label.rlike(final), "FINAL_FINDING").when(label.rlike(official) | withheld, "OFFICIAL_ANALYSIS").otherwise("INVESTIGATION_EVIDENCE")


def blind_eligible(title: Column, document_type: Column, visibility: Column, published_at: Column, cutoff: Column, disposition: Column, withheld: str = V.WITHHELD_TITLE) -> Column:
    """Three-valued: a null type or title gives null, which no filter lets through."""
    return (
        (visibility == "INVESTIGATION_EVIDENCE") & published_at.isNotNull() & cutoff.isNotNull() & (published_at <= cutoff)
        & (disposition == "AI_ALLOWED") & (document_type != "FINAL_REPORT") & ~title.rlike(withheld)
    )


def eligible_sources(sources: DataFrame, dockets: DataFrame, cases: DataFrame, states: Sequence[str]) -> DataFrame:
    """``id`` of the sources whose case is in one of ``states`` and that are eligible."""
    s, d, c = sources.alias("s"), dockets.alias("d"), cases.alias("c")
    joined = s.join(d, (F.col("s.docket_item_id") == F.col("d.id")) & (F.col("s.case_id") == F.col("d.case_id"))).join(c, F.col("s.case_id") == F.col("c.id"))
    ok = blind_eligible(*(F.col(x) for x in ("s.title", "s.document_type", "s.visibility", "s.published_at", "c.evidence_cutoff", "d.processing_disposition")))
    return joined.where(F.col("c.state").isin(*states) & ok).select(F.col("s.id").alias("id"))


def secured_sources(role: str, sources: DataFrame, dockets: DataFrame, cases: DataFrame, locks: DataFrame) -> DataFrame:
    """Rows of ``sources`` that a role may read. Spark has no row policies: pass
    only such views on."""
    if role == "acquisition":
        return sources
    if role == "evaluation":
        return sources.join(locks.select("case_id"), "case_id", "left_semi")
    states = {"blind": ("BLIND", "LOCKED"), "processor": ("BLIND",)}[role]
    return sources.join(eligible_sources(sources, dockets, cases, states), "id", "left_semi")


def secured_by_source(role: str, rows: DataFrame, source_col: str, sources: DataFrame, dockets: DataFrame, cases: DataFrame, locks: DataFrame) -> DataFrame:
    """Rows of a table that hangs on sources, by what the role may read of these."""
    visible = secured_sources(role, sources, dockets, cases, locks).select(F.col("id").alias(source_col))
    return rows.join(visible, source_col, "left_semi")


#: States of a case in which a role may read its investigation's tables, and write them.
CASE_READS = {"blind": ("BLIND", "LOCKED"), "evaluation": ("LOCKED", "REVEALED")}
CASE_WRITES = {"blind": ("BLIND",)}


def secured_case_rows(role: str, rows: DataFrame, cases: DataFrame, locks: DataFrame, write: bool = False) -> DataFrame:
    """Rows (with case_id) of investigation, event and job tables that a role may read,
    or write; evaluation needs the case's lock too. Other roles see none."""
    states = (CASE_WRITES if write else CASE_READS).get(role, ())
    allowed = cases.where(F.col("state").isin(*states)) if states else cases.where("false")
    visible = rows.join(allowed.select(F.col("id").alias("case_id")).distinct(), "case_id", "left_semi")
    return visible.join(locks.select("case_id").distinct(), "case_id", "left_semi") if role == "evaluation" else visible


def secured_candidates(role: str, candidates: DataFrame, evidence: DataFrame, cases: DataFrame, locks: DataFrame) -> DataFrame:
    """Candidates (id, case_id, evidence_ids) of readable cases whose evidence the role
    can see, all of it; ``evidence`` has the visible ids."""
    rows = secured_case_rows(role, candidates, cases, locks)
    hidden = rows.select("id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select(F.col("id").alias("evidence_id")).distinct(), "evidence_id", "left_anti")
    return rows.join(hidden.select("id").distinct(), "id", "left_anti")


def read_with_audit(rows: DataFrame, visible: DataFrame, id_col: str, case_id: Column, occurred_at: Column) -> tuple[DataFrame, DataFrame]:
    """What a blind reader gets of ``rows``, and one audit row per requested row:
    a read that was allowed, or a denial."""
    asked = rows.join(visible.select(id_col).distinct().withColumn("__ok", F.lit(True)), id_col, "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    audit = asked.select(
        case_id.alias("case_id"), F.lit("BLIND").alias("stage"), F.lit("BLIND").alias("actor_role"), F.lit("EVIDENCE_READ").alias("capability"),
        F.when(F.col("__ok"), "READ").otherwise("DENY").alias("operation"), F.col(id_col).alias("target_document_id"), F.lit(None).cast("string").alias("network_host"),
        F.col("__ok").alias("allowed"), F.when(F.col("__ok"), "ALLOWED_EVIDENCE_READ").otherwise("BLOCKED_DOCUMENT").alias("reason_code"), occurred_at.alias("occurred_at"),
    )
    return asked.where("__ok").drop("__ok"), audit


def link_decision(state: Column, cutoff: Column, disposition: Column, checksum: Column, expected_checksum: Column, eligible: Column) -> Column:
    """Why a source can't be linked for processing, or null if it can."""
    return (
        F.when(~state.isin("ACQUIRING", "BLIND") | state.isNull(), "CASE_NOT_OPEN").when(cutoff.isNull(), "CUTOFF_MISSING")
        .when(~disposition.eqNullSafe("AI_ALLOWED"), "DISPOSITION").when(checksum.isNull(), "CHECKSUM_MISSING")
        .when(expected_checksum.isNotNull() & ~expected_checksum.eqNullSafe(checksum), "CHECKSUM_MISMATCH").when(~F.coalesce(eligible, F.lit(False)), "NOT_ELIGIBLE")
    )


def source_route(disposition: Column, visibility: Column, checksum: Column) -> Column:
    """What processing does with a source."""
    return (
        F.when(disposition != "AI_ALLOWED", "SKIPPED_RIGHTS").when(visibility != "INVESTIGATION_EVIDENCE", "SKIPPED_VISIBILITY")
        .when(checksum.isNull(), "ERROR_CHECKSUM").otherwise("PROCESS")
    )


def default_disposition(rights: Column, disposition: Column) -> Column:
    """Unclear rights default to LINK_ONLY, others to AI_ALLOWED."""
    return F.coalesce(disposition, F.when(rights.isin(*V.UNCLEAR_RIGHTS), "LINK_ONLY").otherwise("AI_ALLOWED"))


def rights_violation(rights: Column, disposition: Column) -> Column:
    return rights.isin(*V.UNCLEAR_RIGHTS) & disposition.isin("AI_ALLOWED", "LOCAL_ONLY")


def review_status(confidence: Column) -> Column:
    return F.when(confidence < 0.7, "PENDING").otherwise("NOT_REQUIRED")
