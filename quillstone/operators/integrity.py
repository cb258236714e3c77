"""Guards as violation queries: the rows that break a rule, none if all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V


def illegal_transitions(history: DataFrame, by: Sequence[str], order: Sequence[Column], state: str, allowed: Sequence[tuple[str, str]] = V.CASE_TRANSITIONS) -> DataFrame:
    """Rows of ``history`` whose state changed from ``previous`` in a way that is
    not allowed."""
    moved = history.withColumn("previous", F.lag(state).over(W.partitionBy(*by).orderBy(*order)))
    legal = F.lit(False)
    for old, new in allowed:
        legal = legal | ((F.col("previous") == old) & (F.col(state) == new))
    return moved.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)) & ~legal)


def moved_cutoffs(history: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows that change evidence_cutoff when it is no longer open to change."""
    w = W.partitionBy(*by).orderBy(*order)
    seen = history.withColumns({"old_state": F.lag("state").over(w), "old_cutoff": F.lag("evidence_cutoff").over(w), "__n": F.row_number().over(w)})
    free = (F.col("old_state") == "ACQUIRING") | ((F.col("old_state") == "BLIND") & F.col("old_cutoff").isNull())
    return seen.where((F.col("__n") > 1) & ~F.col("old_cutoff").eqNullSafe(F.col("evidence_cutoff")) & ~free).drop("__n")


def locked_without_lock(cases: DataFrame, locks: DataFrame) -> DataFrame:
    return cases.where(F.col("state").isin("LOCKED", "REVEALED")).join(locks.select(F.col("case_id").alias("id")), "id", "left_anti")


def written_when_closed(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows of a case that is past ACQUIRING and BLIND, or missing."""
    return rows.join(cases.where(F.col("state").isin("ACQUIRING", "BLIND")).select(F.col("id").alias("case_id")), "case_id", "left_anti")


def critique_references(critiques: DataFrame, pinned: DataFrame, claims: DataFrame) -> DataFrame:
    """Critiques whose strongest contradiction is neither pinned evidence nor a claim
    of their investigation and case. ``pinned`` and ``claims`` have investigation_id,
    case_id, id."""
    context = ["investigation_id", "case_id"]
    known = pinned.select(*context, "id").unionByName(claims.select(*context, "id")).distinct().withColumnRenamed("id", "strongest_contradiction_id")
    return critiques.where("strongest_contradiction_id is not null").join(known, [*context, "strongest_contradiction_id"], "left_anti")


def changed_history(before: DataFrame, after: DataFrame, keys: Sequence[str], open_: Column | None = None) -> DataFrame:
    """keys, problem: rows of ``before`` that are DELETED or CHANGED in ``after``.
    Rows for which ``open_`` (of the earlier row) holds may change, but not go;
    without it nothing may."""
    values = [c for c in before.columns if c not in keys]
    old = before.select(*keys, F.struct(*values).alias("old"), (F.lit(False) if open_ is None else F.coalesce(open_, F.lit(False))).alias("is_open"))
    both = old.join(after.select(*keys, F.struct(*values).alias("new")), list(keys), "left")
    problem = F.when(F.col("new").isNull(), "DELETED").when(~F.col("is_open") & ~F.col("old").eqNullSafe(F.col("new")), "CHANGED")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def reclassified(before: DataFrame, after: DataFrame, key: str = "id", fields: Sequence[str] = V.DOCKET_CLASSIFICATION) -> DataFrame:
    """key, field of reviewed classification fields that a processor changed."""
    both = before.alias("b").join(after.alias("a"), key)
    changed = F.array_compact(F.array(*(F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), c) for c in fields)))
    return both.select(key, F.explode(changed).alias("field"))


def orphans(child: DataFrame, parent: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Child rows without a parent; rows with a null key are exempt."""
    whole = child
    for c in keys:
        whole = whole.where(F.col(c).isNotNull())
    return whole.join(parent.select(*(F.col(p).alias(c) for c, p in keys.items())).distinct(), list(keys), "left_anti")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def outside_vocabulary(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def host_of(url: Column) -> Column:
    """Lower-case host, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def host_allowed(url: Column, domain: str) -> Column:
    """The host is ``domain`` or below it."""
    host = host_of(url)
    return F.coalesce((host == domain) | host.endswith(f".{domain}"), F.lit(False))


def manifest_errors(items: DataFrame, cases: DataFrame, domain: str, label: str) -> DataFrame:
    """case_id, position, error. ``items`` has case_id, index (from 1), source_url,
    processing_disposition, expected_checksum; ``cases`` has expected_item_count."""
    again = F.row_number().over(W.partitionBy("case_id", "source_url").orderBy("index")) > 1
    process = F.col("processing_disposition") == "AI_ALLOWED"
    at = F.col("index").cast("string")
    checks = F.array_compact(
        F.array(
            F.when(~host_allowed(F.col("source_url"), domain), F.concat(F.lit("item "), at, F.lit(f" sourceUrl must use {label} host"))),
            F.when(F.col("__again"), F.concat(F.lit("duplicate sourceUrl at item "), at)),
            F.when(process & F.col("expected_checksum").isNull(), F.concat(F.lit("processable item "), at, F.lit(" is missing expectedChecksum"))),
            F.when(~process & F.col("expected_checksum").isNotNull(), F.concat(F.lit("non-processable item "), at, F.lit(" must not pin downloaded bytes"))),
        )
    )
    found = items.withColumn("__again", again).select("case_id", F.col("index").cast("long").alias("index"), F.posexplode(checks).alias("check_no", "error"))
    counted = cases.join(items.groupBy("case_id").agg(F.count("*").alias("n")), "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    count = counted.where("n != expected_item_count").select("case_id", F.lit(0).cast("long").alias("index"), F.lit(0).alias("check_no"), F.concat(F.lit("expected "), F.col("expected_item_count").cast("string"), F.lit(" docket items, found "), F.col("n").cast("string")).alias("error"))
    return count.unionByName(found)


def catalog_differences(present: DataFrame, expected: DataFrame) -> DataFrame:
    """kind, name, problem: what is MISSING, UNEXPECTED, or has another FLAG."""
    p, e = present.select("kind", "name", F.struct("flag").alias("p")), expected.select("kind", "name", F.struct("flag").alias("e"))
    problem = F.when(F.col("p").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").when(~F.col("p").eqNullSafe(F.col("e")), "FLAG")
    return p.join(e, ["kind", "name"], "full").select("kind", "name", problem.alias("problem")).where("problem is not null")
