"""Which keys nested documents have, of which types, how often; and how deep codes go."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.functions import nested

#: Levels of nesting that a census goes down.
MOST_LEVELS = 32
_NODE = "struct<path:string,value:variant,done:boolean>"


def depth(documents: DataFrame, document: str) -> int:
    """Levels of objects and arrays in the documents: one aggregation that merges their types."""
    merged = documents.agg(F.schema_of_variant_agg(document)).first()[0] or ""
    level = deepest = 0
    # Names of fields may hold angle brackets, but then stand between backquotes.
    for token in re.findall(r"`(?:[^`]|``)*`|(?:OBJECT|ARRAY)<|>", merged):
        level += -1 if token == ">" else 1 if token.endswith("<") and not token.startswith("`") else 0
        deepest = max(deepest, level)
    return deepest


def _children(node: Column) -> Column:
    value = node["value"]
    what = nested.kind(value)
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    of_object = F.transform(fields, lambda e: F.struct(F.concat(node["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("value"), F.lit(False).alias("done")))
    of_array = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.struct(F.concat(node["path"], F.lit("[]")).alias("path"), x.alias("value"), F.lit(False).alias("done")))
    empty = F.array().cast(f"array<{_NODE}>")
    return F.when(what == "object", of_object).when(what == "array", of_array).otherwise(empty)


def _walked(documents: DataFrame, document: str, levels: int) -> DataFrame:
    """The nodes of all documents down to a level; those that are not done may have more below."""
    root = F.struct(F.lit("$").alias("path"), F.col(document).alias("value"), F.lit(False).alias("done"))
    nodes = documents.where(F.col(document).isNotNull()).select(root.alias("node"))
    for _ in range(levels):
        node = F.col("node")
        kept = F.array(F.struct(node["path"].alias("path"), node["value"].alias("value"), F.lit(True).alias("done")))
        nodes = nodes.select(F.explode(F.when(node["done"], kept).otherwise(F.concat(kept, _children(node)))).alias("node"))
    return nodes.select("node.path", nested.kind(F.col("node.value")).alias("kind"), "node.done")


def census(documents: DataFrame, document: str) -> DataFrame:
    """(path, kinds, n, nulls): every path of the documents ($ for the whole, .key, [] for all items), its types sorted, how often it is there, and how often null.

    One scan walks down level by level, and counts combine on the map side. How many levels there are is found first: those
    of the merged type, which leaves off where types differ, and further ones while there is more below. Null documents are
    left out; documents of more than MOST_LEVELS levels raise.
    """
    levels = depth(documents, document)
    while levels <= MOST_LEVELS and not _walked(documents, document, levels).where("not done and kind in ('object', 'array')").isEmpty():
        levels += 1
    if levels > MOST_LEVELS:
        raise ValueError(f"documents of over {MOST_LEVELS} levels")
    counted = _walked(documents, document, levels).groupBy("path", "kind").agg(F.count("*").alias("n"))
    return counted.groupBy("path").agg(F.array_sort(F.collect_list("kind")).alias("kinds"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("n"))), F.lit(0)).alias("nulls"))


def code_depths(entries: DataFrame, code: str) -> DataFrame:
    """(depth, n, first): codes by the number of their parts between dashes, with the smallest of them. Null and empty codes do not count."""
    parts = F.size(F.split(F.col(code), "-"))
    return entries.where(F.col(code) != "").groupBy(parts.alias("depth")).agg(F.count("*").alias("n"), F.min(code).alias("first"))
