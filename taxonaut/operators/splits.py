"""Dataset splits: exact sizes by stratum, whole groups, overlap.

Random splits are systematic: rows are lined up by stratum and seeded hash, and each split takes evenly spaced
places of the line, so its share of every stratum is exact but for one row. Only counts reach the driver.
Large groups are dealt on the driver, of which there are few by their size, each to the split that lacks most of what it
holds; small ones are lined up and cut in Spark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from taxonaut.functions.text import strip
from taxonaut.operators.ordered import running
from taxonaut.sources import writers
from taxonaut.sources.writers import stored

SPLITS = ("train", "val", "test")
#: Strata that a random split may have, and labels that the large groups of a split by groups may hold.
MOST_GROUPS = 1_000_000
#: Groups of more than this part of all rows are dealt one by one.
LARGE = 10_000


def allocate(total: int, ratios: Sequence[float]) -> list[int]:
    """Sizes that sum to `total`, by largest remainder: of equal remainders the larger ratio's comes first.

    If train would stay empty although its ratio is positive, the largest other split gives it a row.
    """
    shares = [Fraction(str(r)) * total for r in ratios]
    sizes = np.array([s.numerator // s.denominator for s in shares])
    order = sorted(range(len(sizes)), key=lambda i: (int(sizes[i]) - shares[i], -ratios[i]))
    sizes[order[: total - int(sizes.sum())]] += 1
    if ratios[0] > 0 and sizes[0] == 0 and sizes.any():
        sizes[[0, int(sizes.argmax())]] += (1, -1)
    return sizes.tolist()


def check_ratios(ratios: Sequence[float]) -> None:
    if len(ratios) != 3 or any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("three ratios that sum to one are needed")


def _wide(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(18,0)")


def before(place: Column, size: int, total: int) -> Column:
    """How many of `size` evenly spaced places of 0 to total - 1 come before one; in 38 digits, so it is exact for any table."""
    product = _wide(place) * _wide(size)
    return ((product - product % _wide(max(1, total))) / _wide(max(1, total))).cast("long")


def spaced(place: Column, size: int, total: int) -> Column:
    """True at the evenly spaced places."""
    return before(place + 1, size, total) > before(place, size, total)


def split_random(rows: DataFrame, order: str, strata: Sequence[str], ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """rows with split: exact sizes overall, and in each stratum but for one row. Every row stays once, with a null or repeated `order` too.

    The driver sees one count for each stratum and salt, of which there are at most MOST_GROUPS; rows are numbered
    within (stratum, salt). Ties are ordered by the other columns, so only equal rows are interchangeable.
    """
    check_ratios(ratios)
    label = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])
    others = [f.name for f in rows.schema if f.name != order and "map<" not in f.dataType.simpleString()]
    # Salts are the highest bits of the hash, so the line is in the order of stratum and hash however many there are.
    bits = max(6, (int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    keyed = rows.withColumns({"_s": label, "_h": F.xxhash64(F.lit(seed), order, *others)}).withColumn("_salt", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    counts = keyed.groupBy("_s", "_salt").count().orderBy("_s", "_salt").limit(MOST_GROUPS + 1).collect()
    if len(counts) > MOST_GROUPS:
        raise ValueError("too many strata for a stratified split")
    ends = np.cumsum([r["count"] for r in counts], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    _, val, test = allocate(total, ratios)
    starts = [(r["_s"], r["_salt"], int(end) - r["count"]) for r, end in zip(counts, ends)]
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, "_s string, _salt int, _start long"))
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_salt").orderBy("_h", *[F.col(c) for c in (order, *others)])) - 1)
    place = F.col("_start") + F.col("_n")
    in_val = spaced(place, val, total)
    # Places among what validation leaves.
    rest = place - before(place, val, total)
    split = F.when(in_val, SPLITS[1]).when(spaced(rest, test, total - val), SPLITS[2]).otherwise(SPLITS[0])
    return numbered.join(table, ["_s", "_salt"]).select(order, *[c for c in rows.columns if c != order], split.alias("split"))


def deal_groups(counts: np.ndarray, ratios: Sequence[float]) -> np.ndarray:
    """Split of each group, given rows of what it holds (its size and label counts), in order of choice.

    A group goes to the split that lacks the largest share of it; the last groups go to splits that have none yet.
    """
    active = np.array([i for i, r in enumerate(ratios) if r > 0])
    due = counts.sum(axis=0)[None] * np.array(ratios)[active][:, None]
    lack = due.astype(float)
    chosen = np.zeros(len(counts), np.int64)
    empty = np.ones(len(active), bool)
    for g, held in enumerate(counts):
        open_ = empty if len(counts) - g <= empty.sum() else np.ones(len(active), bool)
        need = (lack / np.maximum(due, 1e-12)) @ held / max(1, held.sum())
        best = int(np.where(open_, need, -np.inf).argmax())
        lack[best] -= held
        empty[best] = False
        chosen[g] = active[best]
    return chosen


def split_groups(rows: DataFrame, key: str, labels: Sequence[str], ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, missing: str = "error") -> DataFrame:
    """rows with split: whole groups, sizes and label shares close to the ratios.

    Groups of more than 1 / LARGE of all rows (fewer than LARGE, then) are dealt on the driver, largest first, each to the split
    that lacks most of it, ties of size in the order of a seeded hash. All others line up in Spark by what they mostly hold (the most frequent
    label of each field) and seeded hash, and each such line is cut where its rows reach the shares that the splits still lack; so
    a line's rows in a split are off its share by two groups of the line at most. Rows without a key are refused or, with missing="drop", left out.
    """
    check_ratios(ratios)
    blank = F.col(key).isNull() | (strip(F.col(key)) == "")
    if missing == "error" and not rows.where(blank).isEmpty():
        raise ValueError(f"rows without {key}")
    rows = rows.where(~blank)
    fields = len(labels)
    if fields:
        held = rows.select(key, _labelled(labels)).groupBy(key, "p").agg(F.count("*").alias("n"))
    else:
        held = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("p", F.lit(None).cast("struct<field:string,label:string>"))
    most = [F.max_by(F.col("p.label"), F.when(F.col("p.field") == c, F.struct("n", "p.label"))).alias(f"_l{i}") for i, c in enumerate(labels)]
    groups = stored(held.groupBy(key).agg((F.sum("n") / max(1, fields)).cast("long").alias("_size"), *most).withColumn("_h", F.xxhash64(F.lit(seed), key)))
    sums = groups.agg(F.count("*").alias("n"), F.sum("_size").alias("rows")).first()
    active = [i for i, r in enumerate(ratios) if r > 0]
    if sums["n"] < len(active):
        raise ValueError(f"{sums['n']} groups cannot fill {len(active)} splits")
    large = F.col("_size") * LARGE > sums["rows"]
    found = held.join(groups.where(large).select(key, "_size", "_h"), key).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError("large groups with too many labels for a split by groups")
    kind = rows.schema[key].dataType.simpleString()
    dealt, given = _dealt(found, key, ratios)
    lack = [max(0.0, r * sums["rows"] - n) for r, n in zip(ratios, given)]
    share = np.cumsum(lack) / max(sum(lack), 1e-12)
    line = running(groups.where(~large), [f"_l{i}" for i in range(fields)], ["_h", key], "_size")
    middle = (F.col("before") + F.col("_size") / 2) / F.col("total")
    cut = F.when(middle < share[0], SPLITS[0]).when(middle < share[1], SPLITS[1]).otherwise(SPLITS[max(i for i in range(3) if lack[i] > 0)] if sum(lack) else SPLITS[active[0]])
    chosen = rows.sparkSession.createDataFrame(dealt, f"`{key}` {kind}, split string").union(line.select(key, cut.alias("split")))
    return rows.join(chosen, key)


def _dealt(found: list, key: str, ratios: Sequence[float]) -> tuple[list[tuple], list[int]]:
    """(group, split) of the large groups, given their rows (key, p, n, _size, _h), and the rows of each split."""
    order = {g: i for i, (_, _, g) in enumerate(sorted(((-r["_size"], r["_h"], r[key]) for r in {r[key]: r for r in found}.values())))}
    kinds = {p: i for i, p in enumerate(dict.fromkeys(r["p"] for r in found))}
    counts = np.zeros((len(order), 1 + len(kinds)), np.int64)
    for r in found:
        counts[order[r[key]], 0] = r["_size"]
        counts[order[r[key]], 1 + kinds[r["p"]]] = r["n"]
    chosen = deal_groups(counts, ratios) if len(counts) else np.zeros(0, np.int64)
    return [(g, SPLITS[chosen[i]]) for g, i in order.items()], [int(counts[chosen == s, 0].sum()) for s in range(len(ratios))]


def _labelled(labels: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("label")) for c in labels])).alias("p")


def label_report(rows: DataFrame, split: str, labels: Sequence[str]) -> DataFrame:
    """(field, split, label, n)."""
    return rows.select(split, _labelled(labels)).groupBy("p.field", split, "p.label").agg(F.count("*").alias("n"))


def overlap(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(split_a, split_b, n): keys that two splits share; must be empty between train, val and test."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("n"))


def join_canonical(members: DataFrame, canonical: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined, orphans of the split, canonical rows outside all splits)."""
    return members.join(canonical, key), members.join(canonical, key, "left_anti"), canonical.join(members, key, "left_anti")


def missing_labels(rows: DataFrame, split: str, labels: Sequence[str], train: str = SPLITS[0]) -> DataFrame:
    """(field, split, label, n) of labels that a split other than training has and training lacks."""
    found = label_report(rows, split, labels)
    return found.where(F.col(split) != train).join(found.where(F.col(split) == train).select("field", "label"), ["field", "label"], "left_anti").select("field", split, "label", "n")


def joined_canonical(members: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """Members with their canonical rows. Blank keys, repeated canonical keys and members without a canonical row raise."""
    for side, rows in (("split", members), ("canonical", canonical)):
        if not rows.where(F.col(key).isNull() | (strip(F.col(key)) == "")).isEmpty():
            raise ValueError(f"{side} rows without {key}")
    if again := canonical.groupBy(key).count().where("count > 1").limit(5).collect():
        raise ValueError(f"canonical rows repeat {[r[key] for r in again]}")
    joined, orphans, _ = join_canonical(members, canonical, key)
    if lost := orphans.select(key).limit(5).collect():
        raise ValueError(f"no canonical row for {[r[key] for r in lost]}")
    return joined


REPORT = "_split_report.json"
#: Labels that a report may list.
MOST_LABELS = 100_000


def split_report(parts: DataFrame, labels: Sequence[str]) -> dict:
    """Sizes, label distributions by field and split ("<EMPTY>" for none), and warnings of labels that one side has and the other lacks."""
    sizes = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.count("*").alias("n")).collect()}
    found = label_report(parts, "split", labels).limit(MOST_LABELS + 1).collect() if labels else []
    if len(found) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels for a report")
    report = {"sizes": {s: sizes.get(s, 0) for s in SPLITS}, "distributions": {}, "warnings": []}
    for field in labels:
        own = {s: dict(sorted((r["label"] or "<EMPTY>", r["n"]) for r in found if r["field"] == field and r["split"] == s)) for s in SPLITS}
        report["distributions"][field] = own
        train, val, test = (set(own[s]) - {"<EMPTY>"} for s in SPLITS)
        for kind, lost in (("labels_missing_from_train", (val | test) - train), ("train_labels_missing_from_val", train - val), ("train_labels_missing_from_test", train - test)):
            if lost:
                report["warnings"].append({"type": kind, "field": field, "labels": sorted(lost)})
    return report


def split_dataset(rows: DataFrame, path: str, labels: Sequence[str], ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, order: str | None = None, group: str | None = None, missing: str = "error", overwrite: bool = False) -> dict:
    """Split rows at random by strata of `labels` (give `order`) or by whole groups (give `group`), publish Parquet by split under `path` with the report, and return it.

    Rows without a group are refused, or with missing="skip" counted as skipped. All or nothing takes the place of what stood at `path`.
    """
    check_ratios(ratios)
    if ratios[0] <= 0:
        raise ValueError("the share of train must be above zero")
    if missing not in ("error", "skip"):
        raise ValueError("missing is 'error' or 'skip'")
    if (order is None) == (group is None):
        raise ValueError("a split is by order or by group")
    spark = rows.sparkSession
    writers.recover(spark, path)
    if not overwrite:
        writers.refuse_existing(spark, path)
    parts = split_random(rows, order, labels, ratios, seed) if group is None else split_groups(rows, group, labels, ratios, seed, "drop" if missing == "skip" else "error")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        parts.write.partitionBy("split").parquet(staging)
        report = split_report(spark.read.schema(parts.schema).parquet(staging), labels)
        included = sum(report["sizes"].values())
        if not included:
            raise ValueError("no rows remain to split")
        skipped = rows.where(F.col(group).isNull() | (strip(F.col(group)) == "")).count() if group else 0
        report |= {"input_size": included + skipped, "included_size": included, "skipped_records": {"count": skipped, "reasons": [{"reason": f"missing_group_key:{group}", "count": skipped}] if skipped else []}}
        writers.write_text(spark, f"{staging}/{REPORT}", json.dumps(report, ensure_ascii=False, indent=2))
    except BaseException:
        writers.delete(spark, staging)
        raise
    writers.publish_staged(spark, {path: staging}, overwrite)
    return report
