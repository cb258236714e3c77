"""Which proposed candidates say something: two filters that differ on spacing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, whole. A dot crosses lines; an edge is no letter, digit or _.
SQL_IMMATERIAL = (
    r"(?is)(?:^|[^\p{L}\p{N}_])row\s+[0-9]+(?:[^\p{L}\p{N}_]|$).*(?:^|[^\p{L}\p{N}_])column\s+[0-9]+(?:[^\p{L}\p{N}_]|$)",
    r"(?is)^(?:numerical\s+)?observation(?:[^\p{L}\p{N}_]|$).*(?:recorded|documented|row|column|cell)",
    r"(?is)^(?:data|value|observation)(?:[^\p{L}\p{N}_]|$).*(?:^|[^\p{L}\p{N}_])row\s+[0-9]+(?:[^\p{L}\p{N}_]|$)",
    r"(?is)^\s*[+-]?[0-9]+(?:[.][0-9]+)?\s*(?:[A-Za-z%]+)?\s*$",
)
TEXT_IMMATERIAL = (
    r"(?iU)\brow\s+\d+\b.*\bcolumn\s+\d+\b",
    r"(?iU)^(?:numerical\s+)?observation\b.*(?:recorded|documented|row|column|cell)",
    r"(?iU)^(?:data|value|observation)\b.*\brow\s+\d+\b",
    r"(?U)^[-+]?\d+(?:\.\d+)?(?:\s*[A-Za-z%]+)?$",
)
TEXT_FIELDS = {"claim": "text", "entity": "proposed_canonical_name", "timeline": "description"}


def candidate_text(kind: Column, candidate: Column) -> Column:
    """The field of a candidate's JSON that its kind is judged by."""
    out = F.lit(None).cast("string")
    for name, field in TEXT_FIELDS.items():
        out = F.when(kind == name, F.get_json_object(candidate, f"$.{field}")).otherwise(out)
    return out


def is_material(text: Column) -> Column:
    """False for null and blank texts and for those that restate a place or value."""
    keep = text.isNotNull() & (F.trim(text) != "")
    for pattern in SQL_IMMATERIAL:
        keep = keep & ~text.rlike(pattern)
    return F.coalesce(keep, F.lit(False))


def is_material_text(text: Column) -> Column:
    """The same on text whose (Unicode) white space has been collapsed."""
    flat = F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    keep = flat != ""
    for pattern in TEXT_IMMATERIAL:
        keep = keep & ~flat.rlike(pattern)
    return F.coalesce(keep, F.lit(False))
