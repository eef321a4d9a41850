"""Guide documents and category corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.functions import ids, text
from taxonaut.operators.ordered import CHUNK, chunked
from taxonaut.sources.writers import stored

# Category texts that name nothing.
MALFORMED = ("nan", "")


def documents(guide: DataFrame, dataset: str, order: str, label: str, content: str) -> DataFrame:
    """Rows of a guide with label, document_id and first_row, the first row with the same label and content.

    Rows without label or content are skipped (see skipped()); a row is a duplicate if first_row differs from its own.
    Contents are cleaned and hashed once; the ids are stored, first rows found among them by aggregation with map-side
    combination, and joined back on the id.
    """
    kept = guide.where(_usable(label, content)).select(order, text.strip_code(F.col(label)).alias("label"), text.clean(F.col(content)).alias("content"))
    keyed = stored(kept.withColumn("document_id", ids.document_id(F.lit(dataset), F.col("label"), F.col("content"))).drop("content"))
    first = keyed.groupBy("document_id").agg(F.min(order).alias("first_row"))
    return keyed.join(first, "document_id")


def skipped(guide: DataFrame, label: str, content: str) -> DataFrame:
    return guide.where(~_usable(label, content))


def _usable(label: str, content: str) -> Column:
    """A label is left without its code, and the content has more than white space (found at its first character, as a rule)."""
    return (text.strip_code(F.col(label)) != "") & F.coalesce(F.col(content).rlike(text.NOT_SPACE), F.lit(False))


def statistics(docs: DataFrame, label: str, content: str) -> DataFrame:
    """One row: documents, labels, labels with several documents, shortest, longest and mean content."""
    by_label = docs.groupBy(label).agg(F.count("*").alias("n"), F.min(F.length(content)).alias("lo"), F.max(F.length(content)).alias("hi"), F.sum(F.length(content).cast("long")).alias("chars"))
    return by_label.agg(F.sum("n").alias("documents"), F.count("*").alias("labels"), F.count_if(F.col("n") > 1).alias("multi_document_labels"), F.min("lo").alias("shortest"), F.max("hi").alias("longest"), (F.sum("chars").cast("double") / F.sum("n")).alias("mean_length"))


def label_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, on the left only, on the right only."""
    sides = left.select(key, F.lit(1).alias("s")).union(right.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.bit_or("s").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 3).alias("in_both"), F.count_if(F.col("s") == 1).alias("left_only"), F.count_if(F.col("s") == 2).alias("right_only"))


def aggregate_categories(entries: DataFrame, keys: list[str], order: str, description: str, chunk: int = CHUNK) -> DataFrame:
    """Per category the first row's description, the later non-blank ones in order, and how many rows came after the first.

    A category of more than `chunk` rows has several rows, numbered by the column chunk: chunk 0 holds what comes of its first
    `chunk` rows, and so on; description is null behind chunk 0. Rows of equal order are taken by their description.
    """
    item = entries.select(*keys, F.col(order).alias("_order"), text.clean(F.col(description)).alias("_d"))
    out = chunked(item, keys, ["_order", "_d"], "_d", (F.col("position") > 0) & (F.col("_d") != ""), {"description": F.col("_d")}, chunk)
    return out.select(*keys, "chunk", "description", F.col("items").alias("descriptions"), (F.col("total") - 1).alias("extra"))


def code_dictionary(entries: DataFrame, dataset: str, order: str, key: str, category: str) -> DataFrame:
    """Entries of a dictionary whose category texts end in a code, described by their key.

    Returns order, category_id (the code, or dataset:name without one), name, description, path (empty), code and issue:
    null, malformed_skipped (then category_id is null) or no_code.
    """
    raw, code = text.clean(F.col(category)), text.extract_code(F.col(category))
    name = text.strip_code(F.col(category))
    bad = F.lower(raw).isin(*MALFORMED)
    return entries.select(
        F.col(order).alias("order"), F.when(~bad, F.coalesce(code, ids.qualified_id(dataset, [name]))).alias("category_id"), name.alias("name"), text.clean(F.col(key)).alias("description"),
        F.array().cast("array<string>").alias("path"), code.alias("code"), F.when(bad, "malformed_skipped").when(code.isNull(), "no_code").alias("issue"),
    )


def path_dictionary(entries: DataFrame, dataset: str, order: str, key: str, category: str) -> DataFrame:
    """Entries of a dictionary whose category texts are paths joined by dashes; columns as of code_dictionary().

    Two or more parts, none blank, are a path; any other text is kept as a single leaf with the issue unexpected_format.
    """
    raw = text.clean(F.col(category))
    parts = F.transform(F.split(raw, "-", -1), text.strip)
    good = (F.size(parts) >= 2) & F.forall(parts, lambda p: p != "")
    slots = F.when(good, parts).otherwise(F.array(raw))
    category_id = F.concat(F.lit(f"{dataset}:"), F.array_join(F.transform(slots, text.compact), "."))
    return entries.select(
        F.col(order).alias("order"), F.when(raw != "", category_id).alias("category_id"), F.element_at(slots, -1).alias("name"), text.clean(F.col(key)).alias("description"),
        F.when(good, parts).otherwise(F.array().cast("array<string>")).alias("path"), F.lit(None).cast("string").alias("code"), F.when(raw == "", "malformed_skipped").when(~good, "unexpected_format").alias("issue"),
    )


def universe(records: DataFrame, dataset: str, leaf: str) -> DataFrame:
    """The different non-blank leaves of a whole dataset as categories without description; columns as of code_dictionary(), the order is the name."""
    name = text.clean(F.col(leaf))
    found = records.select(name.alias("name")).where("name <> ''").distinct()
    return found.select(
        F.col("name").alias("order"), ids.qualified_id(dataset, [F.col("name")]).alias("category_id"), "name", F.lit("").alias("description"), F.array("name").alias("path"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("issue")
    )


def build_corpus(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Categories of parsed entries: the first entry of an id gives name, description, path and code, later non-blank descriptions follow in order.

    extra counts the entries merged away. Entries without an id are left out (see build_report()). A category of more than `chunk`
    entries has several rows, numbered by chunk, as in aggregate_categories(); behind chunk 0 only the id, extra and descriptions stand.
    """
    known = entries.where(F.col("category_id").isNotNull())
    heads = {name: F.col(name) for name in ("name", "description", "path", "code")}
    rows = known.select("category_id", "order", *heads)
    out = chunked(rows, ["category_id"], ["order", "description", "name"], "description", (F.col("position") > 0) & (F.col("description") != ""), heads, chunk)
    return out.select("category_id", "chunk", *heads, F.col("items").alias("descriptions"), (F.col("total") - 1).alias("extra"))


def build_report(entries: DataFrame) -> DataFrame:
    """One row: entries read, categories, merged kinds and instances, and how many entries have each issue."""
    issues = ("malformed_skipped", "no_code", "unexpected_format")
    by_id = entries.groupBy("category_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("issue") == i).alias(i) for i in issues])
    known = F.col("category_id").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return by_id.agg(zero(F.sum("n")).alias("entries"), F.count_if(known).alias("categories"), F.count_if(known & (F.col("n") > 1)).alias("kinds"), zero(F.sum(F.when(known, F.col("n") - 1))).alias("instances"), *[zero(F.sum(i)).alias(i) for i in issues])
