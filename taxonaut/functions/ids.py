"""Identifiers, digests and deterministic permutations as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, functions as F

from taxonaut.functions.text import compact

# The URL namespace of RFC 4122, and the separator inside keys.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
UNIT = "\x1f"


def qualified_id(domain: str, parts: Sequence[Column]) -> Column:
    """domain:part.part... of compacted parts; an empty or null part keeps its slot."""
    return F.concat(F.lit(f"{domain}:"), F.concat_ws(".", *[compact(p) for p in parts]))


def uuid5(*parts: Column) -> Column:
    """Version-5 UUID in the URL namespace of the parts joined by the unit separator."""
    name = F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        F.lower(F.hex(variant)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def record_id(file: Column, database: Column, table: Column, field: Column) -> Column:
    return uuid5(F.lower(file), database, table, field)


def document_id(dataset: Column, label: Column, content: Column) -> Column:
    """dataset-<24 hex digits of the SHA-256 of dataset, label and content>."""
    key = F.concat_ws(UNIT, *[F.coalesce(x, F.lit("")) for x in (dataset, label, content)])
    return F.concat(dataset, F.lit("-"), F.substring(F.sha2(key, 256), 1, 24))


@lru_cache(maxsize=8)
def _orders(size: int) -> tuple[tuple[int, ...], ...]:
    """Item numbers after the exchanges (i, j) for i from size - 1 down to 1, for every choice of the js in mixed radix."""
    out = []
    for picks in product(*[range(i + 1) for i in range(size - 1, 0, -1)]):
        items = list(range(size))
        for i, j in zip(range(size - 1, 0, -1), picks):
            items[i], items[j] = items[j], items[i]
        out.append(tuple(items))
    return tuple(out)


def permuted(items: Column, source_id: Column, size: int) -> Column:
    """Fisher-Yates over an array of `size` items; swap i takes byte i of the SHA-256 of source_id, modulo i + 1.

    The bytes give a number in mixed radix, which picks an order from a literal table of size! orders.
    """
    if not 1 < size < 7:
        raise ValueError("sizes from 2 to 6 are tabulated")
    digest = F.sha2(source_id.cast("string"), 256)
    # Bytes 1 to size - 1 as one number; the digest, then order and items, are worked out once a row.
    number = F.conv(F.substring(digest, 3, 2 * (size - 1)), 16, 10).cast("long")
    table = F.array(*[F.array(*[F.lit(k) for k in order]) for order in _orders(size)])

    def order(n: Column) -> Column:
        pick = F.lit(0).cast("long")
        for i in range(size - 1, 0, -1):
            pick = pick * (i + 1) + F.shiftright(n, 8 * (size - 1 - i)).bitwiseAND(F.lit(255).cast("long")) % (i + 1)
        return F.get(table, pick.cast("int"))

    placed = lambda x: F.when(x["order"].isNotNull(), F.array(*[F.get(x["items"], F.get(x["order"], F.lit(i))) for i in range(size)]))
    return _bound(F.struct(_bound(number, order).alias("order"), items.alias("items")), placed)


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Rows that one fingerprint may cover: they meet in one row.
MOST_ROWS = 100_000


def fingerprint(df, order: Sequence[str], without: Sequence[str] = ("source",)):
    """SHA-256 over all rows as JSON, in `order`, but for the columns `without`: one row (fingerprint). For registries; more than MOST_ROWS rows raise."""
    columns = sorted(c for c in df.columns if c not in without)
    rows = df.limit(MOST_ROWS + 1).select(F.struct(*order).alias("k"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j"))
    found = rows.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda x: x["j"]), ","), 256).alias("fingerprint"))
    return found.select(F.when(F.col("n") > MOST_ROWS, F.raise_error(F.lit(f"over {MOST_ROWS} rows for a fingerprint"))).otherwise(F.col("fingerprint")).alias("fingerprint"))
