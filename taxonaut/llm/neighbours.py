"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors on a few random orthonormal directions of its own,
makes the coordinates uniform with quantiles of a bounded sample, shifts them, and
numbers the grid cells along a Hilbert curve. The keys are range-partitioned at quantiles of the
same sample; a query looks through the windows of neighbouring ranges on every curve,
block against block, and what it finds is merged and ranked by the exact measure.

All rows are indexed. A window holds WINDOW * n ** POWER rows, so its share of the table, and with it the
share of all pairs that is compared, falls as the table grows; ranges are as many as that takes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from taxonaut.llm.common import cut
from taxonaut.llm.vectors import cosines, fitted, matrix, unit, usable

CURVES = 32
DIMENSIONS = 12
BITS = 3
#: Rows of a query's window on one curve: its own range of keys and REACH on either side.
#: On vectors without structure this finds 0.94 of the true neighbours in 51,282 rows and 0.92 in a million, at 46 and 29 hundredths of the table.
WINDOW, POWER = 0.175, 0.8
REACH = 1
#: Documented bound of the sample that quantiles and range bounds are fitted on.
SAMPLE = 16384
BLOCK = 8192
QUERY_BLOCK = 4096


def hilbert(q: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of grid points (rows of unsigned coordinates below 2**bits)."""
    x = q.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    level = top
    while level > 1:  # undo the rotations of the finer levels
        low = level - 1
        for i in range(n):
            flip = (x[i] & level) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    level = top
    while level > 1:
        t ^= np.where(x[n - 1] & level, level - 1, 0)
        level >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Fitted index: projections, quantiles of their coordinates, shifts, and range bounds of each curve."""

    width: int
    directions: list[np.ndarray]
    quantiles: list[np.ndarray]
    shifts: np.ndarray
    bounds: list[np.ndarray]
    bits: int

    def key(self, c: int, x: np.ndarray) -> np.ndarray:
        y = unit(fitted(x, self.width)) @ self.directions[c]
        u = np.stack([np.searchsorted(self.quantiles[c][:, d], y[:, d]) / len(self.quantiles[c]) for d in range(y.shape[1])], axis=1)
        grid = np.minimum(((u + self.shifts[c]) / 2 * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
        return hilbert(grid, self.bits)

    def range_of(self, c: int, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds[c], self.key(c, x), side="right")


def window_rows(n: int) -> float:
    """Rows that a query looks at on one curve of a table of n."""
    return min(float(n), WINDOW * n**POWER)


def fit(sample: np.ndarray, ranges: int, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = 17) -> Curves:
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    directions, quantiles, shifts = [], [], rng.random((curves, min(dimensions, width)))
    for _ in range(curves):
        directions.append(np.linalg.qr(rng.standard_normal((width, min(dimensions, width))))[0])
        y = unit(sample) @ directions[-1]
        quantiles.append(np.quantile(y, np.linspace(0, 1, 257)[1:-1], axis=0))
    index = Curves(width, directions, quantiles, shifts, [], bits)
    for c in range(curves):
        keys = np.sort(index.key(c, sample))
        index.bounds.append(np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges]))
    return index


def search(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", reach: int = REACH, **shape: int) -> DataFrame:
    """The k nearest rows found of each query row: (query_id, rank, vec_id, score), by largest cosine, ties to the smaller id.

    A query's own id is no candidate; with fewer than k other rows all are returned that the windows hold.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with
    a null id, take no part; vectors of different widths are no candidates of one another. Repeated
    rows count once. Empty tables, or tables without queries, give no rows.
    """
    spark = rows.sparkSession
    used = cut(rows.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")))
    n = used.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = used.select("v", "id").orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(SAMPLE).toArrow()
    ranges = min(SAMPLE // 2, max(1, int((2 * reach + 1) * n / window_rows(n))))
    index = fit(matrix(drawn.column("v"))[0], ranges, **shape)
    first = spark.sparkContext.broadcast(index)

    def count(batches):
        for batch in batches:
            x, _ = matrix(batch.column(0))
            asks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            out = []
            for c in range(len(index.bounds)) if len(x) else ():
                at = first.value.range_of(c, x)
                n, q = np.bincount(at, minlength=len(index.bounds[c]) + 1), np.bincount(at[asks], minlength=len(index.bounds[c]) + 1)
                out += [(c, int(r), int(n[r]), int(q[r])) for r in np.nonzero(n)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["curve", "range", "n", "q"])

    blocks = [np.ones(len(b) + 1, np.int64) for b in index.bounds]
    asked = [np.zeros(len(b) + 1, np.int64) for b in index.bounds]
    for r in used.select("v", "query").mapInArrow(count, "curve long, range long, n long, q long").groupBy("curve", "range").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).collect():  # curves * ranges rows
        blocks[r["curve"]][r["range"]] = -(-r["n"] // BLOCK)
        asked[r["curve"]][r["range"]] = r["q"]
    # Query blocks of a range: by the queries of its window.
    query_blocks = [np.array([max(1, -(-int(a[max(0, r - reach) : r + reach + 1].sum()) // QUERY_BLOCK)) for r in range(len(a))], np.int64) for a in asked]
    shared = spark.sparkContext.broadcast((index, blocks, query_blocks))

    def deal(batches):
        """Rows of a range in one block for each query block, queries in every range of their windows for each block."""
        index, blocks, query_blocks = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                x, _ = matrix(batch.column(1))
                ids = batch.column(0).to_numpy()
                asks = np.nonzero(batch.column(2).to_numpy(zero_copy_only=False).astype(bool))[0]
                salt = ((ids * 2654435761) & 0x7FFFFFFF).astype(np.int64)
                given = []
                for c in range(len(index.bounds)):
                    at = index.range_of(c, x)
                    for q in range(int(query_blocks[c][at].max())):
                        r = np.nonzero(q < query_blocks[c][at])[0]
                        given.append((r, np.full(len(r), c), at[r], salt[r] % blocks[c][at[r]], np.full(len(r), q), 0))
                    for step in range(-reach, reach + 1):
                        to = at[asks] + step
                        ok = (to >= 0) & (to < len(blocks[c]))
                        r, to = asks[ok], to[ok]
                        for b in range(int(blocks[c][to].max()) if len(r) else 0):
                            there = b < blocks[c][to]
                            given.append((r[there], np.full(int(there.sum()), c), to[there], np.full(int(there.sum()), b), salt[r[there]] % query_blocks[c][to[there]], 1))
                columns = [np.concatenate([g[i] for g in given]).astype(np.int64) for i in range(5)]
                side = np.concatenate([np.full(len(g[0]), g[5], np.int8) for g in given])
                row = pa.array(columns[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[1:]), pa.array(side), batch.column(0).take(row), batch.column(1).take(row)], names=["curve", "range", "block", "asked", "side", "id", "v"])

    dealt = used.mapInArrow(deal, f"curve long, range long, block long, asked long, side byte, id long, v {dict(used.dtypes)['v']}")
    near = dealt.groupBy("curve", "range", "block", "asked").applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    merged = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(k: int):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = table.column("id").to_numpy()
        x, widths = matrix(table.column("v"))
        rows, asks = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        found = []
        if len(rows) and len(asks):
            # Of equal vectors only the k + 1 with the smallest ids can be among a query's k.
            rows = rows[np.argsort(ids[rows], kind="stable")]
            same = np.unique(np.ascontiguousarray(np.column_stack([x[rows], widths[rows]])).view(np.dtype((np.void, 8 * (x.shape[1] + 1)))).ravel(), return_inverse=True)[1].ravel()
            order = np.argsort(same, kind="stable")
            start = np.concatenate([[0], np.nonzero(np.diff(same[order]))[0] + 1])
            within = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate([start, [len(order)]])))
            rows = rows[np.sort(order[within <= k])]
            u = unit(x)
            targets = np.ascontiguousarray(u[rows].T)
            for m in range(0, len(asks), 256):
                some = asks[m : m + 256]
                score = u[some] @ targets
                score[(widths[some][:, None] != widths[rows][None]) | (ids[some][:, None] == ids[rows][None])] = -np.inf
                least = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(some), -2.0)
                i, j = np.nonzero((score >= least[:, None] - 1e-9) & np.isfinite(score))
                exact = cosines(x[some[i]], x[rows[j]])
                order = np.lexsort([ids[rows[j]], -exact, i])
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, np.arange(len(some)))
                keep = np.arange(len(i)) - first[i] < k
                found.append((ids[some[i[keep]]], ids[rows[j[keep]]], exact[keep]))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run
