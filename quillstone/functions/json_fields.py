"""Fields of open JSON: kinds, key sets, and objects without some keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(text: Column) -> Column:
    """object, array, string, number, boolean or null (as JSON text says); null for a
    null and for what is no JSON."""
    shape = F.upper(F.schema_of_variant(F.try_parse_json(text)))
    return (
        F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null").when(shape.isNotNull(), "number")
    )


def has_keys(text: Column, keys: Sequence[str]) -> Column:
    """Whether an object has all of the keys; other JSON has none."""
    own = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*map(F.lit, keys)), own)) == 0


def other_keys(text: Column, keys: Sequence[str]) -> Column:
    """Keys of an object beyond ``keys``, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, keys))))


def fields(text: Column) -> Column:
    """An object as a map from key to the JSON text of its value."""
    return F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, v: F.to_json(v))


def without_keys(text: Column, keys: Sequence[str]) -> Column:
    """An object without some keys, the others in their order."""
    return F.to_json(F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: ~k.isin(*keys)))
