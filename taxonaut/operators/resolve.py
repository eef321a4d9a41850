"""Resolution of records to canonical categories under registry constraints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.functions.arrays import filled
from taxonaut.functions.ids import qualified_id
from taxonaut.functions.text import strip

# Outcomes of a resolution.
STATUSES = ("resolved", "missing_leaf", "path_mismatch", "placeholder", "unlabeled", "code_unresolved", "invalid_record")


@dataclass(frozen=True)
class DatasetConfig:
    """How a dataset names its categories; generates column expressions."""

    dataset: str
    path_fields: Sequence[str] = ("level_1", "level_2", "level_3", "level_4")
    leaf_level: str = "level_4"
    id_strategy: str = "path"
    identity_fields: Sequence[str] = field(default=())
    placeholders: Sequence[str] = field(default=())

    def __post_init__(self):
        if self.id_strategy not in ("path", "code"):
            raise ValueError("id_strategy is 'path' or 'code'")
        if self.leaf_level not in self.path_fields:
            raise ValueError("leaf_level must be one of path_fields")
        if set(self.identity_fields) - set(self.path_fields):
            raise ValueError("identity_fields must be among path_fields")

    def level(self, name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit("")))

    def category_id(self) -> Column:
        return qualified_id(self.dataset, [self.level(f) for f in (self.identity_fields or self.path_fields)])


def resolve(records: DataFrame, config: DatasetConfig, code_map: DataFrame | None = None) -> DataFrame:
    """Adds leaf, category_id, category_path and resolution_status (before the registry is asked).

    Order: unlabelled, empty leaf, placeholder, code or path. `code_map` (name, code) serves the
    code strategy and must have one code a name.
    """
    leaf = config.level(config.leaf_level)
    out = records.withColumn("leaf", leaf)
    if config.id_strategy == "code":
        if code_map is None:
            raise ValueError("the code strategy needs a code map")
        out = out.join(code_map.select(F.col("name").alias("_name"), F.col("code").alias("category_id")), F.col("leaf") == F.col("_name"), "left").drop("_name")
    else:
        out = out.withColumn("category_id", config.category_id())
    status = (
        F.when(F.lower(strip(F.coalesce("label_status", F.lit("")))) == "unlabeled", "unlabeled")
        .when(F.col("leaf") == "", "invalid_record")
        .when(F.col("leaf").isin(*config.placeholders) if config.placeholders else F.lit(False), "placeholder")
        .when(F.col("category_id").isNull(), "code_unresolved")
        .otherwise("resolved")
    )
    return out.withColumns({"resolution_status": status, "category_path": filled([config.level(f) for f in config.path_fields])})


def constrain(resolved: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolved rows whose id is not in the registry (category_id, name) become path_mismatch, or missing_leaf if the name is unknown, too."""
    ids = registry.select(F.col("category_id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    names = registry.select(F.col("name").alias("_name")).distinct().withColumn("_named", F.lit(True))
    joined = resolved.join(ids, F.col("category_id") == F.col("_id"), "left").join(names, F.col("leaf") == F.col("_name"), "left")
    status = F.when((F.col("resolution_status") == "resolved") & F.col("_known").isNull(), F.when(F.col("_named"), "path_mismatch").otherwise("missing_leaf")).otherwise(F.col("resolution_status"))
    return joined.withColumn("resolution_status", status).drop("_id", "_known", "_name", "_named")


def with_target(resolved: DataFrame, config: DatasetConfig) -> DataFrame:
    """Adds the target struct, null unless resolved."""
    target = F.struct(F.lit(config.leaf_level).alias("leaf_level"), F.col("leaf").alias("leaf_name"), "category_id", "category_path")
    return resolved.withColumn("target", F.when(F.col("resolution_status") == "resolved", target))


def canonical(records: DataFrame, config: DatasetConfig, registry: DataFrame, code_map: DataFrame | None = None) -> DataFrame:
    return with_target(constrain(resolve(records, config, code_map), registry), config)


def status_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("resolution_status").agg(F.count("*").alias("n"))


def canonical_report(resolved: DataFrame) -> DataFrame:
    """(section, name, n): rows of each status in the section "status", and for missing_leaf, path_mismatch and code_unresolved the rows of each leaf, id and leaf.

    One scan and one aggregation give all counters.
    """
    status = F.col("resolution_status")
    name = F.when(status.isin("missing_leaf", "code_unresolved"), F.col("leaf")).when(status == "path_mismatch", F.col("category_id"))
    section = lambda said, what: F.struct(said.alias("section"), what.alias("name"))
    counters = F.array(section(F.lit("status"), status), F.when(status.isin("missing_leaf", "path_mismatch", "code_unresolved"), section(status, F.coalesce(name, F.lit("")))))
    return resolved.select(F.explode(counters).alias("c")).where("c is not null").groupBy("c.section", "c.name").agg(F.count("*").alias("n"))


def coverage(resolved: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of `by`: covered, uncovered, skipped, and the covered share of what has an id (0 where nothing has)."""
    status = F.col("resolution_status")
    covered, uncovered = F.count_if(status == "resolved"), F.count_if(status.isin("missing_leaf", "path_mismatch", "code_unresolved"))
    return resolved.groupBy(*by).agg(covered.alias("covered"), uncovered.alias("uncovered"), F.count_if(status.isin("unlabeled", "placeholder", "invalid_record")).alias("skipped")).withColumn(
        "rate", F.coalesce(F.try_divide(F.col("covered").cast("double"), (F.col("covered") + F.col("uncovered")).cast("double")), F.lit(0.0))
    )


def ambiguous_codes(code_map: DataFrame) -> DataFrame:
    """Names with more than one code; must be empty for a code map."""
    return code_map.groupBy("name").agg(F.count_distinct("code").alias("n_codes")).where("n_codes > 1")


def training_target(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds truth, the category of rows whose resolution_status is resolved, null for all others.

    A resolved row must have a target whose category_id the registry (category_id unique, name) has under the target's
    leaf_name; one that breaks this raises.
    """
    stripped = lambda c: strip(F.coalesce(c, F.lit("")))
    joined = rows.withColumn("_id", stripped(F.col("target.category_id"))).join(registry.select(F.col("category_id").alias("_known"), F.col("name").alias("_name")), F.col("_id") == F.col("_known"), "left")
    fault = (
        F.when(F.col("target").isNull(), "resolved without a target")
        .when(F.col("_id") == "", "empty target.category_id")
        .when(F.col("_known").isNull(), F.concat(F.lit("not in the leaf registry: "), F.col("_id")))
        .when(~stripped(F.col("target.leaf_name")).eqNullSafe(F.col("_name")), F.concat(F.lit("leaf_name is not the registry's name of "), F.col("_id")))
    )
    resolved = stripped(F.col("resolution_status")) == "resolved"
    return joined.withColumn("truth", F.when(resolved, F.when(fault.isNull(), F.col("_id")).otherwise(F.raise_error(fault)))).drop("_id", "_known", "_name")
