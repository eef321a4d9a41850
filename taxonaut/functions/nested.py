"""Fields of nested documents (VARIANT), where absent, null and present are three different things."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PRESENT, NULL, MISSING = "present", "null", "missing"


def _path(key: str) -> str:
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def get(document: Column, key: str) -> Column:
    """struct(state, value) of the field at a dotted key: present with its text, null, or missing.

    A step into something that is no object, or into an object without that field, is missing, as is everything of a null document.
    """
    if not key or "'" in key:
        raise ValueError(f"no key of a field: {key!r}")
    found = F.try_variant_get(document, _path(key), "variant")
    state = F.when(found.isNull(), MISSING).when(F.is_variant_null(found), NULL).otherwise(PRESENT)
    return F.struct(state.alias("state"), F.try_variant_get(document, _path(key), "string").alias("value"))


def label(document: Column, key: str) -> Column:
    """The text of a field, '' where it is null or missing."""
    return F.coalesce(get(document, key)["value"], F.lit(""))


def kind(value: Column) -> Column:
    """object, array, string, boolean, integer, number, null, or the name of a rarer type; null for no value."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z_]+", 0)
    known = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "VOID": "null"}
    out = F.lower(name)
    for raw, said in known.items():
        out = F.when(name == raw, said).otherwise(out)
    return F.when(value.isNotNull(), out)
