"""Embedding whitening by mixed-precision refinement.

Rows of whole numbers (fixed point) give exact sums. Their covariance is summed in Spark from rows centred first, one
partial matrix a task. Its eigenvectors are worked out in float32 and corrected in extended precision
by the iteration of Ogita and Aishima (2018), which only multiplies matrices: with R = I - X'X and S = X'AX
eigenvalues are S_ii / (1 - R_ii) and the correction of X is X E, E_ij = (S_ij + l_j R_ij) / (l_j - l_i)
where the eigenvalues are told apart, R_ij / 2 where not. Clusters of eigenvalues, which float32 mixes up, are told apart by
sub-solves (2019): the matrix shifted by the cluster's mean and seen in the cluster's own basis is
small, so an ordinary solver resolves it, and the iteration goes on.

Only sums by dimension and by pair of dimensions reach the driver (width * (width + 1) / 2 numbers); rows never do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxonaut.llm.kd_trees import whole_numbers

WIDE = np.longdouble
#: Part of the largest eigenvalue up to which a component counts as one without variance.
NO_VARIANCE = 1e-12


def _orthogonal(x: np.ndarray) -> np.ndarray:
    """Nearly orthogonal columns made orthogonal to the last digit (a step of Newton and Schulz)."""
    return x @ (3 * np.eye(x.shape[1], dtype=WIDE) - x.T @ x) / 2


def _sub_solve(a: np.ndarray, x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The basis x of a cluster turned to the eigenvectors of a inside it."""
    inner = x.T @ (a @ x - x * values.mean())
    inner = (inner + inner.T) / 2
    most = np.abs(inner).max()
    return x if most == 0 else x @ _orthogonal(np.linalg.eigh((inner / most).astype(np.float64))[1].astype(WIDE))


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of two or more indices whose sorted values follow one another within `gap`."""
    order = np.argsort(values)
    return [g for g in np.split(order, np.nonzero(np.diff(values[order]) > gap)[0] + 1) if len(g) > 1]


def refined_eigh(matrix: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix to double precision."""
    scale = np.abs(matrix).max() if matrix.size else 0.0
    if scale == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = np.asarray(matrix, WIDE) / WIDE(scale)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    one = np.eye(len(a), dtype=WIDE)
    size = np.linalg.norm(a.astype(np.float64))
    least, best = np.inf, x
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        rest = s - np.diag(values)
        off = float(max(np.abs(r).max(), np.abs(rest).max()))
        if off < least:
            least, best = off, x
        if off < 2 * len(a) * np.finfo(WIDE).eps:
            break
        gap = 2 * (np.linalg.norm(rest.astype(np.float64)) + size * np.linalg.norm(r.astype(np.float64)))
        between = values[None] - values[:, None]
        apart = np.abs(between) > gap
        x = x + x @ np.where(apart, (s + values[None] * r) / np.where(apart, between, 1), r / 2)
        for group in _clusters(values, gap):
            x[:, group] = _sub_solve(a, x[:, group], values[group])
    best = _orthogonal(_orthogonal(best))
    values = np.diag(best.T @ a @ best)
    order = np.argsort(-values, kind="stable")
    return (values[order] * WIDE(scale)).astype(np.float64), best[:, order].astype(np.float64)


@dataclass(frozen=True)
class Fit:
    """n rows with exact sums by dimension; `centre` and `rest` add up to the mean; eigenvalues fall; components are columns; drift is the mean of centred rows."""

    n: int
    pad: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    drift: np.ndarray
    trace: float
    values: np.ndarray
    components: np.ndarray

    @property
    def rank(self) -> int:
        return int((self.values > NO_VARIANCE * self.values[0]).sum()) if len(self.values) else 0

    def centred(self, column: pa.Array) -> np.ndarray:
        return (_padded(column, len(self.sums), self.pad) - self.centre[None]).astype(np.float64) - self.rest[None]

    def project(self, column: pa.Array, most: int) -> np.ndarray:
        count = min(most, self.rank)
        return (self.centred(column) @ self.components[:, :count]) / np.sqrt(self.values[:count])


def _padded(column: pa.Array, width: int, pad: int) -> np.ndarray:
    x = whole_numbers(column, width)
    if pad:
        sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        x[np.arange(width)[None] >= sizes[:, None]] = pad
    return x


def _moments(rows: DataFrame, vector: str, transform, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of transform(rows), centred by the caller, and of their products: one partial a task, added up in Spark."""
    upper = np.triu_indices(width)

    def partial(batches):
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                z = transform(batch.column(0).slice(k, 8192))
                total += z.sum(axis=0)
                products += z.T @ z
        i = np.concatenate([np.full(width, -1), upper[0]])
        j = np.concatenate([np.arange(width), upper[1]])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(np.concatenate([total, products[upper]]))], names=["i", "j", "v"])

    sums, products = np.zeros(width), np.zeros((width, width))
    for r in rows.select(vector).mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a number a pair of dimensions
        if r["i"] < 0:
            sums[r["j"]] = r["v"]
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = r["v"]
    return sums, products


def fit(rows: DataFrame, vector: str, pad: int = 0) -> Fit:
    """The whitening of `vector` (array<bigint>, not null and without nulls): mean, covariance with divisor n, its eigenvectors.

    Shorter vectors, empty ones too, count as padded with `pad`; repeated rows count each time. Without rows the fit
    has no components. Widths up to a few thousand are meant, as the driver holds a matrix of width squared.
    """

    def dimensions(batches):
        n, counts, sums = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            x = whole_numbers(column, len(sums))
            grow = x.shape[1] - len(sums)
            counts, sums = np.pad(counts, (0, grow)), np.pad(sums, (0, grow))
            n, counts, sums = n + len(sizes), counts + (np.arange(x.shape[1])[None] < sizes[:, None]).sum(axis=0), sums + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums))), pa.array(np.concatenate([[n], counts])), pa.array(np.concatenate([[0], sums]))], names=["at", "n", "sum"])

    found = {r["at"]: (r["n"], int(r["sum"])) for r in rows.select(vector).mapInArrow(dimensions, "at long, n long, sum long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()}  # a row a dimension
    n = found.pop(-1)[0] if found else 0
    width = len(found)
    if not n:
        empty = np.zeros(0)
        return Fit(0, pad, [], empty.astype(np.int64), empty, empty, 0.0, empty, np.zeros((0, 0)))
    sums = [found[d][1] + pad * (n - found[d][0]) for d in range(width)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - n * c) / n for s, c in zip(sums, centre)])
    start = Fit(n, pad, sums, np.array(centre, np.int64), rest, np.zeros(width), 0.0, np.zeros(0), np.zeros((width, 0)))
    drift, products = _moments(rows, vector, start.centred, width)
    covariance = products / n
    return Fit(n, pad, sums, start.centre, rest, drift / n, float(np.trace(covariance)), *refined_eigh(covariance))


def identity_error(rows: DataFrame, fitted: Fit, vector: str, most: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; 0 without components."""
    count = min(most, fitted.rank)
    if not count:
        return 0.0
    drift = (fitted.drift @ fitted.components[:, :count]) / np.sqrt(fitted.values[:count])
    _, products = _moments(rows, vector, lambda column: fitted.project(column, most) - drift, count)
    return float(np.abs(products / fitted.n - np.eye(count)).max())


def whiten(rows: DataFrame, fitted: Fit, vector: str, key: str, most: int = 32) -> DataFrame:
    """A row for each of `rows` and component, at most `most`: key, component from 1 by falling eigenvalue, n, deviation, whitened, explained, identity_error.

    deviation is the exact sum over dimensions of (n * x - sum)^2, null where it does not fit 64 bits; explained is the component's
    share of the variance. Components without variance (vectors that span fewer dimensions, a single row) are left
    out; a table without rows or without variance gives none. A null key stays null; repeated rows stay.
    """
    count = min(most, fitted.rank)
    error = identity_error(rows, fitted, vector, most)
    explained = fitted.values[:count] / fitted.trace if count else np.zeros(0)
    totals = F.array(*[F.lit(s if abs(s) < 1 << 63 else None).cast("long") for s in fitted.sums]) if fitted.sums else F.array().cast("array<long>")
    filled = F.concat(F.col(vector), F.array_repeat(F.lit(fitted.pad).cast("long"), F.lit(len(fitted.sums)) - F.size(vector)))
    lack = F.zip_with(filled, totals, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(fitted.n).cast("long")), s))
    deviation = F.aggregate(F.transform(lack, lambda d: F.try_multiply(d, d)), F.lit(0).cast("long"), F.try_add)
    kind = dict(rows.dtypes)[key]

    def project(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                w = fitted.project(batch.column(1), most)
                row = pa.array(np.repeat(np.arange(len(w)), count))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(row), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(w))), batch.column(2).take(row), pa.array(w.ravel()), pa.array(np.tile(explained, len(w))),
                ], names=["key", "component", "deviation", "whitened", "explained"])

    found = rows.select(F.col(key).alias("key"), vector, deviation.alias("deviation")).mapInArrow(project, f"key {kind}, component int, deviation long, whitened double, explained double")
    return found.select(F.col("key").alias(key), "component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
