"""Places of rows within their key, and lists in order, for keys of any size.

Rows are range-partitioned by (key, order), so a frequent key spreads over as many tasks as it needs. Within a sorted partition rows get
consecutive numbers; a key's place in a partition starts where the partitions before it end, by a running sum over
one row for each key and partition. Lists are put together in chunks of bounded length by place, so no row grows with a
key, and chunks are the same for any partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from taxonaut.sources.writers import stored

#: Items of a list in one row.
CHUNK = 10_000


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of columns, nulls equal to nulls."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def _lined(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows sorted by (key, order), stored once, with _part, their partition, and _at, numbered without gaps within it."""
    sort = [F.col(c) for c in (*keys, *order)]
    lined = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    return stored(lined).withColumn("_part", F.shiftright("_at", 33))


def _based(lined: DataFrame, keys: Sequence[str], amount: Column, *more: Column) -> tuple[DataFrame, Column]:
    """One row for each key and partition: _base, the amounts of the partitions before it, total, and `more`; and how lined rows meet it."""
    runs = lined.groupBy(*keys, "_part").agg(amount.cast("long").alias("_n"), *more)
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    kept = [c for c in runs.columns if c not in (*keys, "_part", "_n")]
    based = runs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_run"), F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*keys)).alias("total"), *kept
    )
    return based, same(lined, based, [*[(k, f"_k{i}") for i, k in enumerate(keys)], ("_part", "_run")])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with position, from 0 by `order` within the key, and total, the rows of the key.

    Rows that agree in key and order have neighbouring places in no stated sequence; null keys are a key, and null orders come
    first. The sorted rows are stored once in the scratch folder, so places stay what they are if a task runs again.
    """
    lined = _lined(rows, keys, order)
    based, met = _based(lined, keys, F.count("*"), F.min("_at").alias("_start"))
    return lined.join(based, met).select(*rows.columns, (F.col("_at") - F.col("_start") + F.col("_base")).alias("position"), "total")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str) -> DataFrame:
    """rows with before, the sum of `amount` (whole numbers, not null) over the key's rows that come earlier by `order`, and total, that over all of them.

    Stored and spread as in numbered(), so one key may hold all rows.
    """
    lined = _lined(rows, keys, order)
    based, met = _based(lined, keys, F.sum(amount))
    here = F.sum(amount).over(Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return lined.withColumn("_here", F.coalesce(here, F.lit(0))).join(based, met).select(*rows.columns, (F.col("_here") + F.col("_base")).alias("before"), "total")


def chunked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], item: str, keep: Column | None = None, heads: dict[str, Column] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(keys, chunk, items, total, heads): each key's items in order, places 0 to chunk - 1 in its chunk 0, and so on.

    `keep` tells which rows give an item (it may ask for position); the others only hold their place. `heads` are values
    of the key's first row, null in later chunks.
    """
    if chunk < 1:
        raise ValueError("a chunk holds at least one item")
    placed = numbered(rows, keys, order)
    number = F.floor(F.col("position") / chunk).cast("int")
    kept = F.lit(True) if keep is None else keep
    first = F.col("position") == 0
    heads = heads or {}
    # In a struct a null item keeps its place.
    grouped = placed.withColumn("chunk", number).groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct("position", F.col(item).alias("item"))))).alias("_items"), F.min("total").alias("total"),
        *[F.max(F.when(first, F.struct(value.alias("v")))).alias(name) for name, value in heads.items()],
    )
    return grouped.select(*keys, "chunk", F.transform("_items", lambda x: x["item"]).alias("items"), "total", *[F.col(name)["v"].alias(name) for name in heads])


def digested(chunks: DataFrame, keys: Sequence[str], kept: Sequence[str], separator: str = ",", items: str = "items") -> DataFrame:
    """(keys, kept, digest): one row for each key of chunked(), the columns `kept` of its chunk 0 and the SHA-256 of all its items (texts; nulls are passed over) joined.

    Chunks pass in order and only the running digest is held, so the list of a key is never put together.
    """
    joined = F.array_join(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.concat(F.lit(separator), x)), "")
    lined = chunks.select(*keys, *kept, "chunk", joined.alias("_joined")).repartition(*keys).sortWithinPartitions(*keys, "chunk")
    heads = [f for f in lined.schema.fields if f.name not in ("chunk", "_joined")]
    skip = len(separator)

    def run(batches):
        import pyarrow as pa

        head = digest = None
        fresh = True
        for batch in batches:
            done, digests = [], []
            for i, (number, said) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("_joined"))):
                if number == 0:
                    if head is not None:
                        done.append(head)
                        digests.append(digest.hexdigest())
                    head, digest, fresh = batch.select([f.name for f in heads]).slice(i, 1), hashlib.sha256(), True
                if text := said.as_py():
                    digest.update((text[skip:] if fresh else text).encode())
                    fresh = False
            if done:
                rows = pa.Table.from_batches(done).combine_chunks()
                yield from rows.append_column("digest", pa.array(digests, pa.string())).to_batches()
        if head is not None:
            yield from pa.Table.from_batches([head]).append_column("digest", pa.array([digest.hexdigest()], pa.string())).to_batches()

    return lined.mapInArrow(run, StructType([*heads, StructField("digest", StringType())]))
