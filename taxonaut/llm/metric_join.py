"""Embedding near-duplicates by an exact metric range join.

On the unit sphere cosine >= c is distance <= r = sqrt(2 - 2 c). Pivots drawn from the vectors
give every vector a home cell, that of its nearest pivot. By the triangle inequality a vector has
a partner at home in another cell only if it is no farther from that cell's pivot than
the cell's radius plus r, and within r of the plane midway between the two pivots. Every vector
is replicated to the later cells in such reach, so each pair across cells meets in exactly one.
Cells join independently, home blocks against home and replica blocks of bounded size; a block
pair gives counts and a spanning forest of its links, never all its pairs. Inside, an upper
bound of the cosine from the first coordinates and the norms of the rest (Cauchy-Schwarz) leaves few
pairs to measure in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxonaut.llm.common import components, cut
from taxonaut.llm.vectors import cosines, doubles, equal_vectors, fitted, matrix, unit, usable

COSINE = 0.95
#: Rows of a block; a pivot is drawn for about so many vectors, and at most MOST_PIVOTS.
BLOCK = 8192
MOST_PIVOTS = 1024
TILE = 512
HEAD = 16


class Cells:
    """Pivots with the margins that decide where a vector is at home and where it is in reach."""

    def __init__(self, pivots: np.ndarray, cosine: float):
        self.pivots, self.r = pivots, math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        self.between = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
        self.radius = np.zeros(len(pivots))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(x)
        own = d.argmin(axis=1)
        return own, d[np.arange(len(x)), own]

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of replicas: later cells than home that may hold a partner at home."""
        d = self._distances(x)
        own = d.argmin(axis=1)
        line = np.arange(len(x))
        margin = (d * d - (d[line, own] ** 2)[:, None]) / np.maximum(2 * self.between[own], 1e-12)
        return np.nonzero((np.arange(len(self.pivots))[None] > own[:, None]) & (d <= self.radius[None] + self.r) & (margin <= self.r))

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * unit(fitted(x, max(x.shape[1], self.pivots.shape[1]))) @ fitted(self.pivots, max(x.shape[1], self.pivots.shape[1])).T))


def _block_of(rep: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (((rep * 2654435761) & 0x7FFFFFFF) % blocks).astype(np.int64)


def links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Of (rep, copies, v): rows (src, found) that sum to the number of vectors linked to src, and (src, dst) edges.

    Edges, with found null, leave every linked pair connected. Vectors of different widths never link.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    drawn = vectors.select("rep", "v").orderBy(F.xxhash64("rep", F.lit("pivot")), "rep").limit(int(min(MOST_PIVOTS, max(1, n // block)))).collect()
    if not drawn:
        return spark.createDataFrame([], "src long, dst long, found long")
    width = max(len(r["v"]) for r in drawn)
    cells = Cells(unit(np.stack([np.pad(np.array(r["v"], float), (0, width - len(r["v"]))) for r in drawn])), cosine)
    first = spark.sparkContext.broadcast(cells)

    def measure(batches):
        for batch in batches:
            x, _ = matrix(batch.column(0))
            own, d = first.value.home(x) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(d, pa.float64())], names=["cell", "d"])

    homes, replicas = np.ones(len(cells.pivots), np.int64), np.zeros(len(cells.pivots), np.int64)
    for r in vectors.select("v").mapInArrow(measure, "cell long, d double").groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect():  # one row a pivot
        cells.radius[r["cell"]], homes[r["cell"]] = r["d"], -(-r["n"] // block)
    second = spark.sparkContext.broadcast(cells)

    def count(batches):
        for batch in batches:
            x, _ = matrix(batch.column(0))
            found = np.bincount(second.value.reach(x)[1], minlength=len(second.value.pivots)) if len(x) else np.zeros(0, np.int64)
            there = np.nonzero(found)[0]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(found[there], pa.int64())], names=["cell", "n"])

    for r in vectors.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row a pivot
        replicas[r["cell"]] = -(-r["n"] // block)
    shared = spark.sparkContext.broadcast((cells, homes, replicas))

    def deal(batches):
        """A row for each block pair (cell, left, right) of a vector: right >= 0 a home block, below 0 a replica block."""
        cells, homes, replicas = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                x, _ = matrix(batch.column(2))
                rep = batch.column(0).to_numpy()
                own, _ = cells.home(x)
                mine = _block_of(rep, homes[own])
                given = []
                for other in range(int(homes[own].max())):
                    a = np.nonzero((other < homes[own]) & (mine >= other))[0]
                    b = np.nonzero((other < homes[own]) & (mine < other))[0]
                    given += [(a, own[a], mine[a], np.full(len(a), other), 0), (b, own[b], np.full(len(b), other), mine[b], 1)]
                for other in range(int(replicas[own].max())):
                    a = np.nonzero(other < replicas[own])[0]
                    given.append((a, own[a], mine[a], np.full(len(a), -1 - other), 0))
                away, into = cells.reach(x)
                block_there = _block_of(rep[away], np.maximum(1, replicas[into]))
                for other in range(int(homes[into].max()) if len(into) else 0):
                    ok = other < homes[into]
                    given.append((away[ok], into[ok], np.full(int(ok.sum()), other), -1 - block_there[ok], 1))
                row, cell, left, right = (np.concatenate([g[c] for g in given]) for c in range(4))
                side = np.concatenate([np.full(len(g[0]), g[4], np.int8) for g in given])
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(left), pa.array(right), pa.array(side), *(batch.column(c).take(pa.array(row)) for c in range(3))], names=["cell", "left", "right", "side", "rep", "copies", "v"])

    dealt = vectors.select("rep", "copies", "v").mapInArrow(deal, "cell long, left long, right long, side byte, rep long, copies long, v array<double>")
    return dealt.groupBy("cell", "left", "right").applyInArrow(_join_blocks(cosine), "src long, dst long, found long")


def _join_blocks(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        rep, copies = (table.column(c).to_numpy() for c in ("rep", "copies"))
        side = table.column("side").to_numpy()
        x, widths = matrix(table.column("v"))
        inside = table.column("left")[0].as_py() == table.column("right")[0].as_py()
        a, b = np.nonzero(side == 0)[0], np.nonzero(side == (0 if inside else 1))[0]
        head = min(HEAD, x.shape[1])
        u = unit(x)
        bound = np.concatenate([u[:, :head], np.sqrt(np.maximum(0.0, (u[:, head:] ** 2).sum(axis=1, keepdims=True)))], axis=1).astype(np.float32)
        right = np.ascontiguousarray(bound[b].T)
        found = np.zeros(len(rep), np.int64)
        edges = []
        for k in range(0, len(a), TILE):
            left = a[k : k + TILE]
            i, j = np.nonzero(bound[left] @ right >= cosine - 1e-4)
            i, j = left[i], b[j]
            ok = (widths[i] == widths[j]) & ((rep[i] < rep[j]) | (not inside)) & (rep[i] != rep[j])
            i, j = i[ok], j[ok]
            linked = np.concatenate([cosines(x[i[m : m + 65536]], x[j[m : m + 65536]]) >= cosine for m in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
            i, j = i[linked], j[linked]
            found += np.bincount(i, weights=copies[j], minlength=len(rep)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(rep)).astype(np.int64)
            edges.append(_forest(i, j, len(rep)))
        src, dst = (np.concatenate([e[c] for e in edges]) for c in range(2)) if edges else (np.zeros(0, np.int64),) * 2
        counted = np.nonzero(found)[0]
        return pa.table({
            "src": np.concatenate([rep[counted], rep[src]]),
            "dst": pa.array(np.concatenate([np.zeros(len(counted), np.int64), rep[dst]]), mask=np.arange(len(counted) + len(src)) < len(counted)),
            "found": pa.array(np.concatenate([found[counted], np.zeros(len(src), np.int64)]), mask=np.arange(len(counted) + len(src)) >= len(counted)),
        })

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node) that connect what the pairs connect."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    node = np.nonzero(label != np.arange(n))[0]
    return node, label[node]


def near_duplicates(rows: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: every pair with cosine >= `cosine`, none below, is a link.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    no links, a component of their own, kept. Equal vectors are linked; repeated rows count as
    further vectors. A null id has no links and no component. Empty tables give no rows.
    """
    all_rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.when(usable(vector) & F.col(key).isNotNull(), doubles(vector)).alias("v"))
    used = all_rows.where("v is not null").select(F.col("vec_id").alias("id"), "v")
    kinds = cut(equal_vectors(used))
    found = cut(links(kinds, cosine))
    counts = found.where("found is not null").groupBy(F.col("src").alias("rep")).agg(F.sum("found").alias("found"))
    parts = components(found.where("found is null").select("src", "dst")).withColumnRenamed("id", "rep")
    named = kinds.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keyed = all_rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v"))}).drop("v")
    out = keyed.join(named, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
