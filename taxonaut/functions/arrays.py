"""Paths and other arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from taxonaut.functions.text import strip


def filled(parts: Sequence[Column]) -> Column:
    """Array of the parts that are not empty."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))


def dedupe_path(path: Column) -> Column:
    """Trimmed parts without blanks and without a part that repeats the one before it."""
    kept = F.filter(F.transform(path, strip), lambda x: x.isNotNull() & (x != ""))
    return F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1)))


def deepest_level(levels: Sequence[Column]) -> Column:
    """Index of the last part that is not blank, -1 if all are."""
    found = F.lit(-1)
    for i, level in enumerate(levels):
        found = F.when(F.coalesce(strip(level), F.lit("")) != "", F.lit(i)).otherwise(found)
    return found


def path_with_leaf(path: Column, leaf: Column) -> Column:
    """The path, with the leaf appended unless it ends with it."""
    return F.when((F.size(path) > 0) & (F.try_element_at(path, F.lit(-1)) == leaf), path).otherwise(F.concat(F.coalesce(path, F.array().cast("array<string>")), F.array(leaf)))


def suffix(path: Column, depth: Column, separator: str = " / ") -> Column:
    """The last `depth` parts joined; all of a shorter path."""
    d = F.least(depth, F.size(path))
    return F.array_join(F.slice(path, -d, d), separator)
