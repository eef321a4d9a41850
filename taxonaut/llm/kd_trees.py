"""Exact top-k search by inner product with a KD-tree a shard.

Rows are dealt to shards of bounded size by a hash of their row number, so no value makes a shard hot. Each shard is split at medians of
the widest side of its box, boxes fitted tightly to what they hold. A query first searches the
shard that it lives in, best-first: nodes in the order of the largest inner product that their box allows. The score
and id of the kth row found there go with the query to all other shards, where a search ends as soon as the
best box left cannot hold a better row. Query blocks meet shards in tasks of bounded size, and each returns k rows a
query at most.

Scores are exact: whole numbers below 2**53 in double precision, larger ones in 64-bit or Python integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from taxonaut.llm.common import cut

#: Rows of a shard and queries of a block at most, and the rows that a shard has at least where there are cores for more shards.
SHARD = 65536
BLOCK = 65536
LEAST_SHARD = 4096
LEAF = 128
#: Queries whose bounds are worked out together.
TILE = 256

FOUND = "row long, query_id long, vec_id long, score long"


def whole_numbers(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of a list of whole numbers, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max()) if len(sizes) else 0)), np.int64)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def exact_type(x: np.ndarray, q: np.ndarray):
    """The fastest type in which sums of products of the rows of x and q are exact."""
    largest = lambda a: max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0
    most = largest(x) * largest(q) * max(1, x.shape[1])
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


class Tree:
    """Median splits of rows (x, ids, row numbers) with tight boxes; of a leaf of equal rows only the k + 1 smallest ids are kept."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, leaf: int = LEAF):
        order = np.lexsort([rows, ids])
        self.x, self.ids, self.rows = x[order], ids[order], rows[order]
        self.low, self.high, self.least, self.children, self.members = [], [], [], [], []
        waiting = [(np.arange(len(ids)), -1)] if len(ids) else []
        while waiting:
            some, parent = waiting.pop()
            low, high = self.x[some].min(axis=0), self.x[some].max(axis=0)
            node = len(self.least)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(self.ids[some[0]]))  # `some` is in the order of ids
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            spread = high.astype(float) - low
            if not spread.size or not spread.max() > 0:
                self.members.append(some[: k + 1])
            elif len(some) <= leaf:
                self.members.append(some)
            else:
                self.members.append(None)
                turned = some[np.argsort(self.x[some, int(spread.argmax())], kind="stable")]
                half = len(turned) // 2
                waiting += [(np.sort(turned[:half]), node), (np.sort(turned[half:]), node)]

    def search(self, q: np.ndarray, rows: np.ndarray, k: int, least: list[tuple[int, int] | None]) -> list[list[tuple[int, int]]]:
        """For each query the k best (score, id), none with its own row number, and only those better than `least` of it."""
        if not self.children or not len(q):
            return [[] for _ in range(len(q))]
        kind = exact_type(self.x, q)
        x, low, high = (np.asarray(a).astype(kind) for a in (self.x, np.stack(self.low), np.stack(self.high)))
        found = []
        for m in range(0, len(q), TILE):
            tile = q[m : m + TILE].astype(kind)
            bounds = np.maximum(tile, 0) @ high.T + np.minimum(tile, 0) @ low.T
            found += [self._best_first(x, y, int(row), k, b, worst) for y, row, b, worst in zip(tile, rows[m : m + TILE], bounds, least[m : m + TILE])]
        return found

    def _best_first(self, x, q, row, k, bounds, worst) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        border = None if worst is None else (worst[0], -worst[1])
        waiting = [(-int(bounds[0]), self.least[0], 0)]
        while waiting:
            bound, least, node = heapq.heappop(waiting)
            # A box may hold a row as good as the kth, and still a smaller id.
            if border is not None and (-bound, -least) <= border:
                if -bound < border[0]:
                    break
                continue
            some = self.members[node]
            if some is None:
                for child in self.children[node]:
                    heapq.heappush(waiting, (-int(bounds[child]), self.least[child], child))
                continue
            scores = x[some] @ q
            there = np.nonzero(scores >= border[0])[0] if border is not None else np.arange(len(some))
            for i in there:
                one = (int(scores[i]), -int(self.ids[some[i]]))
                if self.rows[some[i]] == row or (border is not None and one <= border):
                    continue
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, one)
                if len(best) == k and (border is None or best[0] > border):
                    border = best[0]
        return [(score, -minus) for score, minus in sorted(best, reverse=True)]


def _table(rows: np.ndarray, queries: np.ndarray, found: list[list[tuple[int, int]]]) -> pa.Table:
    take = np.repeat(np.arange(len(found)), np.array([len(f) for f in found], np.int64))
    score, ids = ([pair[i] for f in found for pair in f] for i in range(2))
    return pa.table({"row": rows[take], "query_id": queries[take], "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})


def _arrays(table: pa.Table) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in ("row", "id")]


def _at_home(k: int):
    """A shard's own queries against its rows."""

    def run(table: pa.Table) -> pa.Table:
        rows, ids = _arrays(table)
        x = whole_numbers(table.column("v"))
        asks = np.nonzero(table.column("query").to_numpy(zero_copy_only=False).astype(bool))[0]
        found = Tree(x, ids, rows, k).search(x[asks], rows[asks], k, [None] * len(asks)) if len(asks) else []
        return _table(rows[asks], ids[asks], found)

    return run


def _abroad(k: int):
    """A block of queries against a shard where they do not live."""

    def run(shard: pa.Table, asking: pa.Table) -> pa.Table:
        rows, ids = _arrays(shard)
        asked, queries = _arrays(asking)
        x = whole_numbers(shard.column("v"))
        q = whole_numbers(asking.column("v"), x.shape[1])
        if q.shape[1] > x.shape[1]:
            x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
        least = [None if s is None else (s, i) for s, i in zip(asking.column("kth_score").to_pylist(), asking.column("kth_id").to_pylist())]
        return _table(asked, queries, Tree(x, ids, rows, k).search(q, asked, k, least) if len(rows) else [])

    return run


def search(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK, least_shard: int = LEAST_SHARD) -> DataFrame:
    """The k rows of largest inner product for each query row: (query_id, rank, vec_id, score), ties to the smaller id.

    `vector` holds whole numbers (array<bigint>). Candidates are all rows but the query's own; with fewer than k of
    them, all are returned. Rows whose vector is null or holds a null, and rows with a null id, take no
    part; vectors of different widths compare as if padded with zeros, and an empty one scores 0. Rows that repeat, or
    share an id, are candidates one by one, and each query row has its own answer. Scores beyond
    64 bits raise. Tables without rows or without queries give no rows.
    """
    spark = rows.sparkSession
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()) & F.col(key).isNotNull()
    used = cut(rows.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")))
    counted = used.agg(F.count("*").alias("n"), F.count_if("query").alias("asked")).first()
    if not counted["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = min(shard, max(least_shard, -(-counted["n"] // spark.sparkContext.defaultParallelism)))
    shards, blocks = -(-counted["n"] // size), -(-counted["asked"] // block)
    dealt = used.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    home = cut(dealt.groupBy("shard").applyInArrow(_at_home(k), FOUND))
    if shards > 1:
        best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
        kth = home.withColumn("at", best).where(F.col("at") == k).select("row", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
        asking = dealt.where("query").join(kth, "row", "left").withColumn("block", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int"))
        sent = asking.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))))
        # Names of their own: both sides of the cogroup descend from the same rows.
        sent = sent.select(F.col("other").alias("shard"), *[F.col(c).alias(c) for c in ("block", "row", "id", "v", "kth_score", "kth_id")])
        there = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "row", "id", "v")
        home = home.union(there.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(_abroad(k), FOUND))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return home.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
