"""Prompt choices, candidate bundles, prompts and answers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from taxonaut.functions.arrays import path_with_leaf, suffix
from taxonaut.functions.ids import permuted

BUNDLE = 5
#: Rows of a registry that one task may rank.
MOST_RANKED = 1_000_000
# The prompts that training data is exchanged with.
STAGE1_SYSTEM = (
    'You are a leaf-category candidate retriever. Return exactly one JSON object with key "candidates". '
    "The value must contain exactly five unique choice ids from the catalog. "
    "Do not output Markdown, commentary, canonical category ids, or any other keys."
)
STAGE2_SYSTEM = (
    'You are a leaf-category reranker. Return exactly one JSON object with key "answer". '
    'Its value must be one of the five candidate ids "1" through "5". Do not output Markdown, commentary, or any other keys.'
)
STAGE1_HEAD = "Retrieve five candidate leaf categories from this catalog:\n"
STAGE2_HEAD = "Candidate bundle:\n"
METADATA_HEAD = "\nField metadata:\n"


def display_names(registry: DataFrame) -> DataFrame:
    """registry (category_id, name, path) with display_name: the name where unique, else the shortest path suffix that no other category shares.

    display_name is null where no suffix tells a category apart.
    """
    parts = registry.select("category_id", "name", path_with_leaf(F.col("path"), F.col("name")).alias("parts"))
    depth = parts.agg(F.max(F.size("parts"))).first()[0] or 1
    tried = parts.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn("suffix", suffix(F.col("parts"), F.col("depth")))
    sharing = tried.groupBy("depth", "suffix").agg(F.count("*").alias("n"), F.min("category_id").alias("category_id")).where("n = 1")
    own = sharing.join(parts.select("category_id", F.size("parts").alias("length")), "category_id").where("depth <= length")
    best = own.groupBy("category_id").agg(F.min_by("suffix", "depth").alias("shortest"))
    same_name = registry.groupBy("name").agg((F.count("*") == 1).alias("_alone"))
    return registry.join(same_name, "name", "left").join(best, "category_id", "left").withColumn("display_name", F.when(F.col("_alone"), F.col("name")).otherwise(F.col("shortest"))).drop("_alone", "shortest")


def choice_ids(registry: DataFrame, order: str = "ord") -> DataFrame:
    """registry with choice_id "1".."N" in its order. One partition ranks it, so more than MOST_RANKED rows raise."""
    ranked = registry.limit(MOST_RANKED + 1).withColumn("_n", F.row_number().over(Window.orderBy(order)))
    checked = F.when(F.col("_n") > MOST_RANKED, F.raise_error(F.lit(f"over {MOST_RANKED} choices"))).otherwise(F.col("_n"))
    return ranked.withColumn("choice_id", checked.cast("string")).drop("_n")


def candidate_bundle(truth: Column, ids: list[str], source_id: Column) -> Column:
    """Truth and the first four other registry ids, permuted by the digest of source_id."""
    registry = F.array(*[F.lit(x) for x in ids[: BUNDLE + 1]])
    others = F.slice(F.filter(registry, lambda x: x != truth), 1, BUNDLE - 1)
    return permuted(F.concat(F.array(truth), others), source_id, BUNDLE)


def stage1_catalogue(choices: list[tuple[str, str]]) -> str:
    """The catalogue as JSON, built once on the driver and used as a literal."""
    return json.dumps([list(c) for c in choices], ensure_ascii=False)


def metadata_json(metadata: dict[str, Column]) -> Column:
    """Compact JSON of the fields in order, nulls as ''."""
    return F.to_json(F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(name) for name, c in metadata.items()]))


def stage1_prompt(catalogue: str, metadata: Column) -> Column:
    return F.concat(F.lit(STAGE1_HEAD + catalogue + METADATA_HEAD), metadata)


def stage2_prompt(bundle: Column, metadata: Column) -> Column:
    return F.concat(F.lit(STAGE2_HEAD), bundle, F.lit(METADATA_HEAD), metadata)


def bundle_rows(rows: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """(key, bundle): the candidates of each row joined to corpus (category_id, name, description), in order, as JSON.

    A candidate that the corpus lacks raises.
    """
    each = rows.select(key, F.posexplode("candidates").alias("pos", "category_id"))
    joined = each.join(corpus.select("category_id", "name", "description"), "category_id", "left").withColumn("name", F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("candidate is not in the corpus: "), "category_id"))).otherwise(F.col("name")))
    item = F.struct("pos", F.struct((F.col("pos") + 1).cast("string").alias("id"), "name", F.coalesce("description", F.lit("")).alias("description")).alias("item"))
    return joined.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])).alias("bundle"))


#: Categories that a registry, or the corpus that describes it, may have where it becomes a literal.
MOST_CATEGORIES = 10_000


def corpus_map(corpus: DataFrame, ids: Sequence[str] | None = None) -> Column:
    """corpus (category_id, name, description) as a literal map for bundle(): at most MOST_CATEGORIES, without repeats, and with every one of `ids`."""
    found = corpus.select("category_id", "name", F.coalesce("description", F.lit("")).alias("description")).limit(MOST_CATEGORIES + 1).collect()
    described = {r["category_id"]: {"name": r["name"], "description": r["description"]} for r in found}
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"over {MOST_CATEGORIES} categories")
    if len(described) < len(found):
        raise ValueError("the corpus repeats a category_id")
    if lacking := sorted(set(ids or ()) - set(described))[:5]:
        raise ValueError(f"the corpus lacks categories of the registry: {lacking}")
    return F.from_json(F.lit(json.dumps(described)), "map<string,struct<name:string,description:string>>")


def bundle(candidates: Column, described: Column) -> Column:
    """The candidates in order as JSON, from corpus_map(), without a join. A candidate that the corpus lacks raises."""
    known = lambda c: F.when(described[c].isNull(), F.raise_error(F.concat(F.lit("candidate is not in the corpus: "), c))).otherwise(described[c])
    return F.to_json(F.transform(candidates, lambda c, i: F.struct((i + 1).cast("string").alias("id"), known(c)["name"].alias("name"), known(c)["description"].alias("description"))))


def stage1_answer(choice: Column) -> Column:
    return F.to_json(F.struct(choice.alias("candidates")))


def stage2_answer(truth: Column, candidates: Column) -> Column:
    at = F.array_position(candidates, truth)
    return F.when(at > 0, F.to_json(F.struct(at.cast("string").alias("answer")))).otherwise(F.raise_error(F.lit("stage2 answer must be one of the candidates")))
