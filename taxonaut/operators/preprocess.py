"""Raw column metadata to processed records: bind, normalise, check, deduplicate, nest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from taxonaut.functions import ids, text

STANDARD_COLUMNS = (
    "database_name", "database_description", "table_name", "table_description", "field_name", "field_description",
    "field_type", "level_1", "level_2", "level_3", "level_4", "data_level",
)
IDENTITY = ("database_name", "table_name", "field_name")
LABELS = ("level_1", "level_2", "level_3", "level_4", "data_level")


def convert_schema(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """The standard columns as text, renamed by {source: target}; missing ones are ''. Raises on a mapping that does not fit.

    `keep` names columns that pass unchanged, such as a row number.
    """
    if unknown := sorted(set(mapping.values()) - set(STANDARD_COLUMNS)):
        raise ValueError(f"unknown target columns: {unknown}")
    if len(set(mapping.values())) != len(mapping):
        raise ValueError("two sources map to one target")
    if absent := sorted(set(mapping) - set(df.columns)):
        raise ValueError(f"source columns are not there: {absent}")
    source = {target: name for name, target in mapping.items()}
    return df.select(*keep, *[(F.coalesce(F.col(source[c]).cast("string"), F.lit("")) if c in source else F.lit("")).alias(c) for c in STANDARD_COLUMNS])


def normalize(df: DataFrame) -> DataFrame:
    """Every standard column in its normal form."""
    forms = {c: text.clean for c in STANDARD_COLUMNS}
    forms |= {c: text.strip_code for c in LABELS[:4]}
    forms |= {"field_type": text.normalize_type, "data_level": text.normalize_level}
    return df.withColumns({c: form(F.col(c)) for c, form in forms.items() if c in df.columns})


def conflicts(df: DataFrame, identity: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Identities with more than one label: identity, n_labels, n_rows."""
    return df.groupBy(*identity).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in labels])).alias("n_labels"), F.count("*").alias("n_rows")).where("n_labels > 1")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key, that with the smallest `order`; partial aggregation, so a frequent key sends one row a task."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def nest(df: DataFrame, file: str) -> DataFrame:
    """Processed records: id, key, label_status, metadata, classification, data_level."""
    levels = LABELS[:4]
    key = F.concat_ws(".", *[F.col(c) for c in IDENTITY])
    labelled = F.exists(F.array(*levels), lambda x: x != "")
    metadata = [c for c in STANDARD_COLUMNS if c not in LABELS]
    return df.select(
        ids.record_id(F.lit(file), *[F.col(c) for c in IDENTITY]).alias("id"),
        key.alias("key"),
        F.when(labelled, "labeled").otherwise("unlabeled").alias("label_status"),
        F.struct(*metadata, F.lit("").alias("value")).alias("metadata"),
        F.struct(*levels).alias("classification"),
        "data_level",
    )


def preprocess(df: DataFrame, mapping: Mapping[str, str], file: str, order: str, missing_field: str = "drop") -> DataFrame:
    """Bind, normalise, drop (or refuse) rows without field_name, refuse conflicts, keep first rows, nest."""
    rows = normalize(convert_schema(df, mapping, keep=[order]))
    if missing_field not in ("drop", "error"):
        raise ValueError("missing_field is 'drop' or 'error'")
    if missing_field == "error" and not rows.where("field_name = ''").isEmpty():
        raise ValueError("rows without field_name")
    rows = rows.where("field_name <> ''")
    if bad := conflicts(rows, IDENTITY, LABELS).limit(10).collect():
        raise ValueError(f"conflicting labels: {[tuple(r)[:3] for r in bad]}")
    return nest(keep_first(rows, IDENTITY, order).drop(order), file)
