"""JSON request bodies and list responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_body(raw: Column, schema: str, fields: tuple[str, ...]) -> Column:
    """struct of schema, or null where raw is no JSON object or has a field beyond fields (those are refused, not dropped)."""
    keys = F.json_object_keys(raw)
    known = F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) == 0
    return F.when(keys.isNotNull() & known, F.from_json(raw, schema, {"mode": "PERMISSIVE"}))


def patch_body(raw: Column) -> Column:
    """struct(name, has_note, note) of a partner patch: an absent note keeps the old one, a null note clears it. Null for a bad body."""
    body = parse_body(raw, "name string, note string", ("name", "note"))
    has_note = F.array_contains(F.json_object_keys(raw), "note")
    return F.when(body.isNotNull(), F.struct(body["name"].alias("name"), has_note.alias("has_note"), body["note"].alias("note")))


def list_response(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and body, {"items": [...]}: the rows of each key as JSON, in the order of their other columns."""
    rest = [c for c in df.columns if c not in keys]
    items = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("items"))
    return items.select(*keys, F.to_json(F.struct("items"), {"ignoreNullFields": "false"}).alias("body"))
