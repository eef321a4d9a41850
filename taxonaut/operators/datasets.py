"""Exports of whole datasets: split join, rows of both stages, counts and files.

Canonical rows and split members meet in one full outer join by id. Counts are metrics observed on its result while
it is written, without prompts; those are then made and written a split at a time. Nothing is shuffled behind the join, so they are counted in the stage that writes, where a task that is
run again counts once. Faults raise inside that job. Files are staged and take their place only when all went well.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from taxonaut.functions.text import strip
from taxonaut.operators import choices, export, resolve
from taxonaut.operators.splits import SPLITS
from taxonaut.sources import writers

REPORT = "_export_report.json"


@dataclass(frozen=True)
class Catalogue:
    """The categories of a task in registry order: ids, leaf names, display names, and the corpus (category_id, name, description) that describes them."""

    ids: Sequence[str]
    leaves: Sequence[str]
    displays: Sequence[str]
    corpus: DataFrame

    @classmethod
    def of(cls, registry: DataFrame, corpus: DataFrame, order: str) -> Catalogue:
        """From registry (category_id, name, path, `order`): at most MOST_CATEGORIES, ids unique, each with a display name of its own."""
        named = choices.display_names(registry).select("category_id", "name", "display_name", order).limit(choices.MOST_CATEGORIES + 1).collect()
        if len(named) > choices.MOST_CATEGORIES:
            raise ValueError(f"over {choices.MOST_CATEGORIES} categories")
        named = sorted(named, key=lambda r: r[order])
        ids, displays = [r["category_id"] for r in named], [r["display_name"] for r in named]
        if len(set(ids)) < len(ids):
            raise ValueError("the registry repeats a category_id")
        if None in displays or len(set(displays)) < len(displays):
            raise ValueError("categories that no display name tells apart")
        return cls(ids, [r["name"] for r in named], displays, corpus)

    def registry(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.ids, self.leaves)), "category_id string, name string")


def _text(column: str) -> Column:
    return strip(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _refuse(bad: Column, said: str, what: Column, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{said}: "), what))).otherwise(value)


def joined(canonical: DataFrame, members: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Canonical rows (id, resolution_status, target, ...) with the split of their members (id, split), and what becomes of them.

    Adds source_id, truth, split, fate and counted. fate is exported (resolved, in a split), skipped (in a split, not resolved), outside (resolved, in no
    split), unresolved (neither) or nameless (not resolved and without an id). counted is true once for each canonical row: a member of two
    splits gives two rows. Raises inside the job that reads it: a resolved row that breaks resolve.training_target()
    or has no id, a repeated canonical id, a member without id or canonical row, a split of another name.
    """
    targets = resolve.training_target(canonical, catalogue.registry(canonical.sparkSession)).withColumn("_key", _text("id"))
    # Rows without an id get keys of their own, so that they meet neither one another nor one task.
    keyed = targets.withColumn("_key", F.when(F.col("_key") != "", F.col("_key")).otherwise(F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))))
    rows = keyed.withColumn("_copies", F.count("*").over(Window.partitionBy("_key")))
    named = members.select(_text("id").alias("_member"), F.col("split").alias("_split"))
    known = F.col("_split").isin(*SPLITS)
    named = named.select(
        _refuse(F.col("_member") == "", "split rows without an id", F.coalesce("_split", F.lit("")), F.col("_member")).alias("_member"),
        _refuse(~F.coalesce(known, F.lit(False)), "unknown split", F.coalesce("_split", F.lit("")), F.col("_split")).alias("_split"),
    )
    counted = named.withColumn("_again", F.row_number().over(Window.partitionBy("_member").orderBy("_split")))
    both = rows.join(counted, F.col("_key") == F.col("_member"), "full_outer")
    nameless = F.startswith("_key", F.lit("\x00"))
    resolved = F.col("truth").isNotNull()
    fate = (
        F.when(F.col("_key").isNull(), F.raise_error(F.concat(F.lit("split row without a canonical row: "), "_member")))
        .when(F.col("_copies") > 1, F.raise_error(F.concat(F.lit("canonical rows repeat an id: "), "_key")))
        .when(nameless & resolved, F.raise_error(F.concat(F.lit("resolved canonical row without an id, of category "), "truth")))
        .when(nameless, "nameless")
        .when(F.col("_member").isNull(), F.when(resolved, "outside").otherwise("unresolved"))
        .otherwise(F.when(resolved, "exported").otherwise("skipped"))
    )
    out = both.withColumns({"fate": fate, "source_id": F.col("_key"), "split": F.col("_split"), "counted": F.coalesce(F.col("_again"), F.lit(1)) == 1})
    return out.drop("_key", "_copies", "_member", "_split", "_again")


def outside_splits(canonical: DataFrame, members: DataFrame, catalogue: Catalogue) -> DataFrame:
    """(source_id, truth) of resolved rows in no split."""
    return joined(canonical, members, catalogue).where("fate = 'outside'").select("source_id", "truth")


def export_dataset(canonical: DataFrame, members: DataFrame, catalogue: Catalogue, metadata: dict[str, Column], path: str, make_rows: Callable[[DataFrame], DataFrame], overwrite: bool = False) -> dict:
    """Write the rows of both stages as Parquet by split under `path`, with their report, and return the report.

    `make_rows` turns stage_rows() with a column split into the rows to write: sft() or rl(). Faults as in joined(), a corpus that
    lacks a category of the registry and a split without a resolved row raise, and leave what stood at `path`.
    """
    spark = canonical.sparkSession
    writers.recover(spark, path)
    if not overwrite:
        writers.refuse_existing(spark, path)
    choices.corpus_map(catalogue.corpus, catalogue.ids)
    counts = Observation("export")
    fate, split, once = F.col("fate"), F.col("split"), F.col("counted")
    metrics = [F.count_if((fate == f) & (split == s)).alias(f"{f}_{s}") for f in ("exported", "skipped") for s in SPLITS]
    metrics += [F.count_if(once & (fate == f)).alias(f) for f in ("exported", "outside", "nameless")]
    seen = joined(canonical, members, catalogue).observe(counts, *metrics)
    exported = seen.where(fate == "exported").select("source_id", "truth", "split", *[c.cast("string").alias(f"_m{i}") for i, c in enumerate(metadata.values())])
    staging, narrow = (f"{at}-{uuid.uuid4().hex}" for at in (f"{path}.staging", f"{writers.scratch_folder(spark)}/exported"))
    try:
        exported.write.parquet(narrow)
        n = counts.get
        if empty := [s for s in SPLITS if not n[f"exported_{s}"]]:
            raise ValueError(f"no resolved rows in {', '.join(empty)}")
        report = {
            "metadata_fields": list(metadata),
            "registry_size": len(catalogue.ids),
            "canonical_resolved": n["exported"] + n["outside"],
            "idless_non_resolved_records": n["nameless"],
            "splits": {s: {"split_records": n[f"exported_{s}"] + n[f"skipped_{s}"], "exported_rows": 2 * n[f"exported_{s}"], "skipped_not_resolved": n[f"skipped_{s}"]} for s in SPLITS},
            "trainable_resolved": n["exported"],
            "resolved_outside_splits": n["outside"],
        }
        # Prompts are made a split at a time as they are written: sorted by split, they would fill a task's memory.
        for s in SPLITS:
            here = spark.read.schema(exported.schema).parquet(narrow).where(split == s)
            staged = export.stage_rows(here, list(catalogue.ids), list(catalogue.displays), catalogue.corpus, {name: F.col(f"_m{i}") for i, name in enumerate(metadata)}, ["split"])
            make_rows(staged).drop("split").write.parquet(f"{staging}/split={s}")
        writers.write_text(spark, f"{staging}/{REPORT}", json.dumps(report, ensure_ascii=False, indent=2))
    except BaseException:
        writers.delete(spark, staging)
        raise
    finally:
        writers.delete(spark, narrow)
    writers.publish_staged(spark, {path: staging}, overwrite)
    return report


def sft(stages: DataFrame) -> DataFrame:
    """Rows of a fine-tuning export."""
    return export.sft_rows(stages, "split")


def rl(dataset: str) -> Callable[[DataFrame], DataFrame]:
    """Rows of a reinforcement export of a dataset."""

    def rows(stages: DataFrame) -> DataFrame:
        made = export.rl_rows(stages, export.dataset_source(dataset), "split")
        return made.withColumn("extra_info", F.col("extra_info").withField("dataset", F.lit(dataset)))

    return rows


def report_rows(spark: SparkSession, report: dict) -> DataFrame:
    """A report as (split, metric, n), split null for what holds for all."""
    rows = [(None, name, value) for name, value in report.items() if isinstance(value, int)]
    rows += [(split, name, value) for split, found in report["splits"].items() for name, value in found.items()]
    return spark.createDataFrame(rows, "split string, metric string, n long")
