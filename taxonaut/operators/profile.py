"""Label quality and dictionary coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.functions import text
from taxonaut.functions.arrays import deepest_level


def _filled(level: str) -> Column:
    return text.clean(F.col(level)) != ""


def levels(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per level: rows that fill it, their share, and how many different labels; one pass."""
    stacked = records.select(F.explode(F.array(*[F.struct(F.lit(f).alias("level"), text.clean(F.col(f)).alias("label")) for f in fields])).alias("x")).select("x.*")
    return stacked.groupBy("level").agg(F.count_if(F.col("label") != "").alias("filled"), (F.count_if(F.col("label") != "").cast("double") / F.count("*")).alias("rate"), F.count_distinct(F.when(F.col("label") != "", F.col("label"))).alias("labels"))


def patterns(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Which levels rows fill, as a string of 1 and 0, with the deepest filled level's index."""
    pattern = F.concat(*[F.when(_filled(f), "1").otherwise("0") for f in fields])
    return records.select(pattern.alias("pattern"), deepest_level([F.col(f) for f in fields]).alias("deepest")).groupBy("pattern", "deepest").agg(F.count("*").alias("n"))


def collisions(records: DataFrame, label: str, parents: Sequence[str]) -> DataFrame:
    """Labels found under more than one parent path."""
    rows = records.where(_filled(label)).select(F.col(label).alias("label"), F.concat_ws(">", *[F.coalesce(F.col(p), F.lit("")) for p in parents]).alias("parent")).distinct()
    return rows.groupBy("label").agg(F.count("*").alias("n_parents"), F.min("parent").alias("first_parent")).where("n_parents > 1")


def top_paths(records: DataFrame, fields: Sequence[str], order: str, k: int = 10) -> DataFrame:
    """The k most frequent full paths, ties to the one seen first."""
    path = F.concat_ws(">", *[F.col(f) for f in fields])
    full = records.where(F.forall(F.array(*fields), lambda x: x != ""))
    return full.groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def whitespace_variants(labels: DataFrame, label: str) -> DataFrame:
    """Compacted labels with more than one written form."""
    forms = labels.select(F.col(label).alias("form")).distinct()
    return forms.groupBy(text.compact(F.col("form")).alias("compacted")).agg(F.count("*").alias("n_forms")).where("n_forms > 1 and compacted <> ''")


def match_corpora(records: DataFrame, corpora: DataFrame, leaf: str, path: Sequence[str]) -> DataFrame:
    """Samples against every corpus (corpus, pos, leaf, ancestors string, null if it has no path), joined once on the compacted leaf.

    Per corpus: samples with a leaf, matched, ambiguous (several entries), path_agrees (the first entry by pos that has no
    path or the sample's ancestors), and different leaves and matched ones. Corpora number a few; records are reduced to
    counts of different paths before they meet the entries.
    """
    ancestors = F.concat_ws(">", *[text.compact(F.col(p)) for p in path])
    counted = records.where(_filled(leaf)).groupBy(text.compact(F.col(leaf)).alias("key"), ancestors.alias("ancestors")).agg(F.count("*").alias("n"))
    entries = corpora.select("corpus", "pos", text.compact(F.col("leaf")).alias("key"), F.col("ancestors").alias("entry_path"))
    size = entries.groupBy("corpus", "key").agg(F.count("*").alias("n_entries"))
    agree = counted.select("key", "ancestors").distinct().join(entries, "key").where(F.col("entry_path").isNull() | (F.col("entry_path") == F.col("ancestors"))).groupBy("corpus", "key", "ancestors").agg(F.min("pos").alias("first_hit"))
    n = F.col("n")
    found = counted.join(size, "key").join(agree, ["corpus", "key", "ancestors"], "left")
    matches = found.groupBy("corpus").agg(F.sum("n").alias("matched"), F.sum(F.when(F.col("n_entries") > 1, n).otherwise(0)).alias("ambiguous"), F.sum(F.when(F.col("first_hit").isNotNull(), n).otherwise(0)).alias("path_agrees"), F.count_distinct("key").alias("matched_leaves"))
    totals = counted.agg(F.sum("n").alias("samples"), F.count_distinct("key").alias("leaves"))  # one row
    out = entries.select("corpus").distinct().join(matches, "corpus", "left").crossJoin(totals).fillna(0)
    return out.select("corpus", "samples", "matched", "ambiguous", "path_agrees", "leaves", "matched_leaves", F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("samples")), F.lit(0.0)).alias("rate"))


def best_corpus(matches: DataFrame) -> DataFrame:
    """The corpus with most matches, then the best rate, then the first name."""
    return matches.orderBy(F.desc("matched"), F.desc("rate"), "corpus").limit(1)


def dictionary(entries: DataFrame, raw: str) -> DataFrame:
    """One row about raw category texts: totals, different names, repeated kinds and instances, coded, multi-part, long."""
    parsed = entries.select(text.parse_category(F.col(raw)).alias("p")).select("p.*")
    names = parsed.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("code") != "").alias("coded"), F.count_if("multi_part").alias("multi"), F.count_if("is_long").alias("long"), F.count_if("malformed").alias("bad"), F.count_distinct("code").alias("codes"))
    return names.agg(
        F.sum("n").alias("total"), F.count("*").alias("names"), F.count_if(F.col("n") > 1).alias("repeated_kinds"), F.sum(F.col("n") - 1).alias("extra_instances"), F.sum("coded").alias("coded"),
        F.sum("multi").alias("multi_part"), F.sum("long").alias("long"), F.sum("bad").alias("malformed"), F.count_if(F.col("codes") > 1).alias("ambiguous"),
    )


def vocabulary(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(level, label): the different compacted non-blank labels of each level, levels counted from 0."""
    stacked = records.select(F.posexplode(F.array(*[text.compact(F.col(f)) for f in fields])).alias("level", "label"))
    return stacked.where("label <> ''").distinct()


def entry_paths(entries: DataFrame, key: str, raw: str, words: DataFrame) -> DataFrame:
    """Per entry (key, unique): path and leaf of its category text against the vocabulary() of a dataset.

    A text of several parts is a path if all parts but the last are labels of their levels, or the first one is a label
    of level 0; otherwise path is null and the whole name is the leaf.
    """
    parsed = entries.select(key, text.parse_category(F.col(raw)).alias("p"))
    upper = parsed.where("p.multi_part").select(key, F.posexplode(F.slice("p.parts", 1, F.size("p.parts") - 1)).alias("level", "label")).withColumn("label", text.compact(F.col("label")))
    met = upper.join(words.select("level", "label", F.lit(True).alias("_met")), ["level", "label"], "left").withColumn("_met", F.coalesce("_met", F.lit(False)))
    is_path = met.groupBy(key).agg((F.every("_met") | F.bool_or((F.col("level") == 0) & F.col("_met"))).alias("_path"))
    path = F.when(F.coalesce("_path", F.lit(False)), F.col("p.parts"))
    return parsed.join(is_path, key, "left").select(key, path.alias("path"), F.coalesce(F.element_at(path, -1), F.col("p.name")).alias("leaf"))
