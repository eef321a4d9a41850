"""Standards: grids with merged cells, annotations, entries, alignment of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from taxonaut.functions import text
from taxonaut.functions.arrays import dedupe_path
from taxonaut.functions.ids import qualified_id
from taxonaut.operators.ordered import CHUNK, chunked, same
from taxonaut.operators.ranges import within

# Names that stand for no category.
PLACEHOLDERS = ("——", "nan", "none", "-", "")


def merged_cells(cells: DataFrame, ranges: DataFrame, key: Sequence[str], row: str) -> DataFrame:
    """Cells with anchor, the start of the merged range (key, first, last) that holds their row, else the row itself.

    Of overlapping ranges the first wins. Ranges of any length are joined without expanding them.
    """
    held = within(cells.select(*key, row), ranges.select(*key, F.col("first").alias("_first"), F.col("last").alias("_last")), [(row, "_first", "_last")], key)
    rows = held.groupBy(*key, row).agg(F.min("_first").alias("_anchor"))
    return cells.join(rows, [*key, row], "left").withColumn("inherited", F.col("_anchor").isNotNull() & (F.col("_anchor") != F.col(row))).withColumn("anchor", F.coalesce("_anchor", row)).drop("_anchor")


def merged_grid(cells: DataFrame, ranges: DataFrame, key: Sequence[str] = ("sheet",), points: DataFrame | None = None) -> DataFrame:
    """What the merged ranges (key, r1, c1, r2, c2) show at the places of cells (key, row, col, value), or at `points` (key, row, col) instead.

    Returns key, row, col, value (the first cell's inside a range), anchor_row, anchor_col, start_row, end_row and end_col of the range (null outside
    of ranges), and inherited. Of overlapping ranges the one that starts first wins; of repeated cells the smallest value.
    """
    asked = (cells if points is None else points).select(*key, "row", "col").distinct()
    held = within(asked, ranges.select(*key, "r1", "c1", "r2", "c2"), [("row", "r1", "r2"), ("col", "c1", "c2")], key)
    merged = held.groupBy(*key, "row", "col").agg(F.min(F.struct("r1", "c1", "r2", "c2")).alias("m"))
    placed = asked.join(merged, [*key, "row", "col"], "left").select(*key, "row", "col", "m", F.coalesce("m.r1", "row").alias("anchor_row"), F.coalesce("m.c1", "col").alias("anchor_col"))
    values = cells.groupBy(*key, F.col("row").alias("anchor_row"), F.col("col").alias("anchor_col")).agg(F.min("value").alias("value"))
    inherited = F.col("m").isNotNull() & ((F.col("row") != F.col("anchor_row")) | (F.col("col") != F.col("anchor_col")))
    return placed.join(values, [*key, "anchor_row", "anchor_col"], "left").select(
        *key, "row", "col", "value", "anchor_row", "anchor_col", F.col("m.r1").alias("start_row"), F.col("m.r2").alias("end_row"), F.col("m.c2").alias("end_col"), inherited.alias("inherited")
    )


def annotations(rows: DataFrame, key: Sequence[str], row: str, member: str, chunk: int = CHUNK) -> DataFrame:
    """Rows with one text and range as one annotation: first and last row, the first row's member, sorted different members.

    More than `chunk` members go on in further rows, numbered by the column chunk; an annotation without a member has an empty list.
    """
    spans = rows.groupBy(*key).agg(F.min(row).alias("start_row"), F.max(row).alias("end_row"), F.min_by(member, F.struct(row, member)).alias("first_member"))
    members = chunked(rows.select(*key, F.col(member).alias("_member")).where("_member is not null").distinct(), key, ["_member"], "_member", chunk=chunk)
    named = members.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("chunk").alias("_chunk"), "items")
    met = spans.join(named, same(spans, named, [(k, f"_k{i}") for i, k in enumerate(key)]), "left")
    none = F.array().cast(dict(members.dtypes)["items"])
    return met.select(*key, F.coalesce("_chunk", F.lit(0)).alias("chunk"), "start_row", "end_row", "first_member", F.coalesce("items", none).alias("members"))


def scoped_annotations(rows: DataFrame, domain: str, kinds: Sequence[str], entry: str = "standard_entry_id", chunk: int = CHUNK) -> DataFrame:
    """Notes that hold for a scope of rows: rows (`entry`, row, a text for each of `kinds`, provenance as sources.workbooks gives it) as one annotation for each kind, text and scope.

    The scope is the merged range, or the cell itself. Returns annotation_id (domain-kind-first row-last row), kind, text, source_cell, merged_range (null for a
    cell), start_row, end_row, chunk and entry_ids, the sorted ids of the entries it holds for, at most `chunk` a row. Blank texts are no annotation.
    """
    each = [F.struct(F.lit(k).alias("kind"), text.clean(F.col(k)).alias("text"), F.col(f"provenance.{k}").alias("from")) for k in kinds]
    said = rows.select(F.col(entry).alias("entry"), "row", F.explode(F.array(*each)).alias("n")).select("entry", "row", "n.*").where("text <> ''")
    said = said.select("entry", "row", "kind", "text", "from.source_cell", "from.merged_range", F.coalesce("from.start_row", "row").alias("first"), F.coalesce("from.end_row", "row").alias("last")).withColumn("scope", F.coalesce("merged_range", "source_cell"))
    key = ["kind", "text", "scope"]
    spans = said.groupBy(*key).agg(F.min("first").alias("start_row"), F.max("last").alias("end_row"), F.min_by("source_cell", F.struct("first", "row")).alias("source_cell"), F.max("merged_range").alias("merged_range"))
    members = chunked(said.select(*key, "entry"), key, ["entry"], "entry", chunk=chunk).select(*key, "chunk", F.col("items").alias("entry_ids"))
    annotation_id = F.concat_ws("-", F.lit(domain), "kind", F.col("start_row").cast("string"), F.col("end_row").cast("string"))
    return spans.join(members, key).select(annotation_id.alias("annotation_id"), "kind", "text", "source_cell", "merged_range", "start_row", "end_row", "chunk", "entry_ids")


def path_standard(rows: DataFrame, domain: str, kinds: Sequence[str] = ("remark", "department_opinion")) -> tuple[DataFrame, DataFrame]:
    """Entries and scoped annotations of a standard of three levels and a leaf (level_1 to level_3, leaf, row, raw_level, texts of `kinds`, provenance).

    An entry's own id is made of all four, its category_id, by which training data names it, leaves level_3 out: entries that
    differ in level_3 alone share it. Rows without a leaf are left out; a repeated entry id, or annotation id, raises.
    """
    named = rows.where(text.clean(F.col("leaf")) != "")
    entries = build_entries(named, domain, ["level_1", "level_2", "level_3", "leaf"], ["level_1", "level_2", "leaf"], "row", "raw_level")
    if again := duplicated(entries).limit(5).collect():
        raise ValueError(f"entry ids are repeated: {[r['standard_entry_id'] for r in again]}")
    own = named.join(entries.select(F.col("row").alias("_row"), "standard_entry_id"), F.col("row") == F.col("_row")).drop("_row")
    notes = scoped_annotations(own, domain, kinds)
    if again := notes.where("chunk = 0").groupBy("annotation_id").count().where("count > 1").limit(5).collect():
        raise ValueError(f"annotation ids are repeated: {[r['annotation_id'] for r in again]}")
    return entries, notes


def build_entries(rows: DataFrame, domain: str, levels: Sequence[str], identity: Sequence[str], order: str, level: str | None = None) -> DataFrame:
    """Lossless standard entries: standard_entry_id over all levels, category_id over `identity`, path, level, raw_level, issue.

    issue is null for good rows, else placeholder, empty_leaf or unknown_level; every row is kept.
    """
    leaf = text.clean(F.col(levels[-1]))
    found = text.standard_level(F.col(level)) if level else F.struct(F.lit(None).cast("string").alias("level"), F.lit("").alias("raw"))
    issue = F.when(leaf == "", "empty_leaf").when(F.lower(leaf).isin(*PLACEHOLDERS), "placeholder").when((found["raw"] != "") & found["level"].isNull(), "unknown_level")
    return rows.select(
        order,
        qualified_id(domain, [F.col(c) for c in levels]).alias("standard_entry_id"),
        qualified_id(domain, [F.col(c) for c in identity]).alias("category_id"),
        dedupe_path(F.array(*[text.clean(F.col(c)) for c in levels])).alias("path"),
        leaf.alias("name"),
        found["level"].alias("level"),
        found["raw"].alias("raw_level"),
        issue.alias("issue"),
    )


def build_catalog(rows: DataFrame, domain: str, leaf: str, fallback: str, order: str) -> DataFrame:
    """Entries of a code catalogue: the leaf, or the level above where it is blank; the code is the id, rows without one are issues."""
    raw = F.coalesce(F.nullif(text.clean(F.col(leaf)), F.lit("")), text.clean(F.col(fallback)))
    code = text.extract_code(raw)
    return rows.select(
        order, code.alias("category_id"), F.concat(F.lit(f"{domain}:"), code).alias("standard_entry_id"), text.strip_code(raw).alias("name"), F.when(text.strip_code(raw) == "", "empty_leaf").when(code.isNull(), "no_code").alias("issue")
    )


def duplicated(entries: DataFrame, key: str = "standard_entry_id") -> DataFrame:
    """Ids that occur more than once; must be empty for a standard."""
    return entries.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def projection(entries: DataFrame) -> DataFrame:
    """Per category its entry ids, sorted, and levels."""
    return entries.groupBy("category_id").agg(F.array_sort(F.collect_set("standard_entry_id")).alias("entry_ids"), F.array_sort(F.collect_set("level")).alias("levels"), F.min("name").alias("name"))


def align(records: DataFrame, categories: DataFrame) -> DataFrame:
    """Samples (category_id, data_level) against categories (category_id, levels): adds bucket.

    unresolved without an id, missing if the standard lacks it, unavailable if none of its entries has a level, matched if
    any entry has the sample's level, else mismatched.
    """
    joined = records.join(categories.select("category_id", "levels"), "category_id", "left")
    bucket = F.when(F.col("category_id").isNull(), "unresolved").when(F.col("levels").isNull(), "missing").when(F.size("levels") == 0, "unavailable").when(F.array_contains("levels", F.col("data_level")), "matched").otherwise("mismatched")
    return joined.withColumn("bucket", bucket).drop("levels")


def unobserved(categories: DataFrame, records: DataFrame) -> DataFrame:
    return categories.select("category_id").distinct().join(records.select("category_id"), "category_id", "left_anti")


def near_by_name(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(category_id, name) of rows with the sorted ids of categories of that name but another id."""
    other = categories.select("name", F.col("category_id").alias("_other")).distinct()
    wanted = rows.select("category_id", "name").distinct()
    return wanted.join(other, "name").where(~F.col("_other").eqNullSafe(F.col("category_id"))).groupBy("category_id", "name").agg(F.array_sort(F.collect_set("_other")).alias("candidates"))


def registry_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, category_id) of ids on one side only."""
    a, b = (x.select("category_id").distinct().withColumn(s, F.lit(True)) for x, s in ((left, "_l"), (right, "_r")))
    return a.join(b, "category_id", "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull()).select(F.when(F.col("_l"), "left").otherwise("right").alias("side"), "category_id")


def information_loss(categories: DataFrame, registry: DataFrame, depth: int) -> DataFrame:
    """One row: what a registry (category_id) that kept `depth` parts of paths lost of a standard's categories (category_id unique, path, level).

    standard and registry ids, those on one side only, categories with longer and shorter paths, with any path, and with a level.
    """
    ids = registry.select(F.col("category_id").alias("_id")).where("_id is not null").distinct()
    met = categories.where(F.col("category_id").isNotNull()).join(ids, F.col("category_id") == F.col("_id"), "full_outer")
    own, size = F.col("category_id").isNotNull(), F.coalesce(F.size("path"), F.lit(0))
    return met.agg(
        F.count_if(own).alias("standard_categories"), F.count("_id").alias("registry_ids"), F.count_if(F.col("_id").isNull()).alias("standard_only"), F.count_if(~own).alias("registry_only"),
        F.count_if(own & (size > depth)).alias("deeper"), F.count_if(own & (size <= depth)).alias("at_depth"), F.count_if(own & (size > 0)).alias("with_path"), F.count_if(own & (F.coalesce("level", F.lit("")) != "")).alias("with_level"),
    )


def level_distribution(entries: DataFrame) -> DataFrame:
    """Per level ('' for none): entries and different categories."""
    return entries.groupBy(F.coalesce("level", F.lit("")).alias("level")).agg(F.count("*").alias("n"), F.count_distinct("category_id").alias("categories"))


def alignment_report(aligned: DataFrame) -> DataFrame:
    """One row: samples, how many are in each bucket of align(), and the matched share of those with an id (0 without any).

    The share is rounded half to even at four places, as reports state it.
    """
    n = {b: F.count_if(F.col("bucket") == b) for b in ("matched", "mismatched", "missing", "unavailable", "unresolved")}
    resolved = (F.count("*") - n["unresolved"]).cast("double")
    return aligned.agg(F.count("*").alias("samples"), *[c.alias(b) for b, c in n.items()], F.bround(F.coalesce(F.try_divide(n["matched"].cast("double"), resolved), F.lit(0.0)), 4).alias("match_rate"))


def unresolved_evidence(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Unresolved records (resolution_status, leaf) counted by status and leaf, each with the sorted category ids of entries of that name, repeats kept.

    Records without a leaf have no candidates.
    """
    counted = records.groupBy("resolution_status", F.coalesce("leaf", F.lit("")).alias("leaf")).agg(F.count("*").alias("n"))
    by_name = entries.groupBy(F.col("name").alias("_name")).agg(F.array_sort(F.collect_list("category_id")).alias("candidates"))
    met = counted.join(by_name, (F.col("leaf") == F.col("_name")) & (F.col("leaf") != ""), "left").drop("_name")
    return met.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
