"""Embedding whitening: eigenvectors in extended precision, whole results against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxonaut.llm import queries, whitening

ROWS = "vec_id long, x array<bigint>, n int, key string"


def turned(values, seed=0):
    u = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (u * values) @ u.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 3, 40), np.concatenate([1 + 1e-9 * np.arange(8), 0.5 + 1e-11 * np.arange(8), [0.1, 0.2]]), np.ones(12), np.array([1.0, 0, 0, 0]), 10.0 ** -np.arange(12)])
def test_refinement_reaches_double_precision(values):
    a = turned(values) * 789.0
    found, x = whitening.refined_eigh(a)
    wide = x.astype(np.longdouble)
    assert np.abs(found / 789.0 - np.sort(values)[::-1]).max() < 1e-14
    assert np.abs(wide.T @ wide - np.eye(len(a))).max() < 1e-15
    assert np.abs(a.astype(np.longdouble) @ wide - wide * found).max() < 1e-15 * 789.0


def test_clusters_that_float32_mixes_are_told_apart():
    values = np.array([1 + 2e-7, 1 + 1e-7, 1.0, 0.5])
    a = turned(values)
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    off = lambda x: np.abs(x.T @ a @ x - np.diag(np.diag(x.T @ a @ x))).max()
    assert off(start) > 1e-8 and off(whitening.refined_eigh(a)[1]) < 1e-15
    assert [sorted(g.tolist()) for g in whitening._clusters(values, 1.5e-7)] == [[0, 1, 2]]


def rows_of(x):
    return [(i, [int(c) for c in v], 0, "k") for i, v in enumerate(x)]


def brute(x, most):
    n = len(x)
    s = x.sum(axis=0)
    z = x - s / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for v in x], (z @ vectors / np.sqrt(values))[:, :most], values[:most] / values.sum()


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = 1_000_000 + np.floor(rng.standard_normal((500, 7)) * np.array([30, 25, 20, 15, 10, 5, 4])).astype(np.int64)
    df = spark.createDataFrame(rows_of(x), ROWS).repartition(3)
    fitted = whitening.fit(df, "x")
    found = whitening.whiten(df, fitted, "x", "vec_id", most=5).collect()
    deviation, whitened, explained = brute(x, 5)
    assert len(found) == 500 * 5 and {r["n"] for r in found} == {500}
    got = np.zeros((500, 5))
    for r in found:
        assert r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-12
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-9
    error = {r["identity_error"] for r in found}
    assert len(error) == 1 and abs(error.pop() - np.abs(np.cov(got.T, bias=True) - np.eye(5)).max()) < 1e-12


def test_odd_rows(spark):
    """Repeats, null keys, shorter and empty vectors, no variance, one row, none."""
    x = [[1, 2], [1, 2], [3, 7], [5], [], [4, 4]]
    rows = [*[(i, v, 0, "k") for i, v in enumerate(x)], (None, [9, 1], 0, "k"), (1, [1, 2], 0, "k")]
    df = spark.createDataFrame(rows, ROWS)
    fitted = whitening.fit(df, "x", pad=100)
    full = np.array([v + [100] * (2 - len(v)) for _, v, *_ in rows])
    deviation, whitened, _ = brute(full, 2)
    found = whitening.whiten(df, fitted, "x", "vec_id").collect()
    assert sorted((r["deviation"], r["component"]) for r in found) == sorted((d, c) for d in deviation for c in (1, 2))
    assert np.abs(np.sort(np.abs([r["whitened"] for r in found])) - np.sort(np.abs(whitened).ravel())).max() < 1e-9
    assert sum(r["vec_id"] is None for r in found) == 2
    for few in ([], rows[:1], rows[:2]):
        df = spark.createDataFrame(few, ROWS)
        assert whitening.whiten(df, whitening.fit(df, "x"), "x", "vec_id").count() == 0
    flat = spark.createDataFrame([(1, [1, 5]), (2, [3, 5]), (3, [9, 5])], "vec_id long, x array<bigint>")
    assert whitening.whiten(flat, whitening.fit(flat, "x"), "x", "vec_id").agg(F.max("component")).first()[0] == 1
    wild = spark.createDataFrame([(1, [1 << 40]), (2, [0])], "vec_id long, x array<bigint>")
    assert {r["deviation"] for r in whitening.whiten(wild, whitening.fit(wild, "x"), "x", "vec_id").collect()} == {None}


def test_query_leaves_out_what_is_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25], 0), (2, [-0.5, 0.125], 0), (3, None, 0), (4, [nan, 0.0], 0), (5, [inf, 0.0], 0), (6, [None, 0.0], 0), (7, [0.0, -0.01], None), (None, [0.3, 0.3], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op11_embedding_whitening(spark, str(tmp_path)).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 7, None} and {r["n"] for r in found} == {4}
    x = np.array([[1000032, 1000016], [999968, 1000008], [1000000, 999999], [1000019, 1000019]])
    assert {r["deviation"] for r in found} == set(brute(x, 2)[0])
