"""Joins of points with the ranges or boxes that hold them, without expanding ranges.

Each side of a box is filed in buckets of the power of two next above its length, so it touches two of them at most, however
long it is. Points are filed once for each combination of bucket sizes that occurs. Points and boxes then meet by
equality of bucket sizes and bucket numbers, a join that Spark plans and balances like any other, and a pair is
kept if the point is inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A point, and the low and high end that hold it, by the names of their columns.
Side = tuple[str, str, str]


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _size(low: Column, high: Column) -> Column:
    """Bits of a bucket longer than the range; 63 where the length does not fit 64 bits."""
    span = F.try_subtract(high, low)
    return F.when(span.isNull(), 63).when(span == 0, 0).otherwise(F.length(F.bin(span))).cast("int")


def within(points: DataFrame, boxes: DataFrame, sides: Sequence[Side], keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point and a box of the same keys that holds it, ends included: all columns of both.

    Sides are whole numbers; points or boxes with a null side or key, and boxes that end before they start, have no pair.
    Repeated points and boxes pair each time. The number of copies of a point is that of different bucket sizes
    (at most 64 for each side, and few as a rule); a box has two for each side at most.
    """
    if clash := (set(points.columns) & set(boxes.columns)) - set(keys):
        raise ValueError(f"points and boxes share columns: {sorted(clash)}")
    long = lambda c: F.col(c).cast("long")
    good = boxes
    for _, low, high in sides:
        good = good.where(F.col(low) <= F.col(high))
    sized = good.withColumns({f"_size{i}": _size(long(low), long(high)) for i, (_, low, high) in enumerate(sides)})
    sizes = [tuple(r) for r in sized.select([f"_size{i}" for i in range(len(sides))]).distinct().collect()]  # at most 64 ** len(sides)
    filed = sized
    for i, (_, low, high) in enumerate(sides):
        size = F.col(f"_size{i}")
        filed = filed.withColumn(f"_bucket{i}", F.explode(F.sequence(_shifted(long(low), size), _shifted(long(high), size))))
    place = lambda combination: F.struct(*[x for i, bits in enumerate(combination) for x in (F.lit(bits).alias(f"_size{i}"), F.shiftright(long(sides[i][0]), bits).alias(f"_bucket{i}"))])
    if not sizes:
        sizes = [(0,) * len(sides)]
    asked = points.withColumn("_p", F.explode(F.array(*[place(s) for s in sorted(sizes)]))).select(*points.columns, "_p.*")
    on = [*keys, *[f"{kind}{i}" for i in range(len(sides)) for kind in ("_size", "_bucket")]]
    met = asked.join(filed, on)
    for point, low, high in sides:
        met = met.where(F.col(point).between(F.col(low), F.col(high)))
    return met.select(*points.columns, *[c for c in boxes.columns if c not in keys])
