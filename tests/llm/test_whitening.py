"""Embedding whitening against a dense eigensolver and exact whole-number arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.llm import queries, whitening as W

SCHEMA = "vec_id long, embedding array<float>, n string, id string, deviation string, component string"


def table(spark, vectors, start=0):
    rows = [(start + i, None if v is None else [None if x is None else float(x) for x in v], *["x"] * 4)
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def matrix(rows, n, k):
    out = np.zeros((n, k))
    for r in rows:
        out[r["vec_id"], r["component"] - 1] = r["whitened"]
    return out


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    c = (rng.standard_normal((300, 12)) * np.linspace(0.3, 3, 12) + 5).astype(np.float32)
    rows = W.whiten(table(spark, c), components=7).collect()
    assert len(rows) == 300 * 7
    x = np.floor(c.astype(np.float64) * 64)
    x = [[int(v) + W.OFFSET for v in r] for r in x]
    s = [sum(r[j] for r in x) for j in range(12)]
    centred = np.array([[300 * r[j] - s[j] for j in range(12)] for r in x], object)
    v = np.array([[int(a) / 300 ** 3 for a in b] for b in centred.T @ centred])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:7], axes[:, ::-1][:, :7]
    want = (centred.astype(np.float64) / 300) @ axes / np.sqrt(values)
    got = matrix(rows, 300, 7)
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-10
    far = [int(sum(a * a for a in r)) for r in centred]
    for r in rows:
        assert r["n"] == 300 and int(r["deviation"]) == far[r["vec_id"]] and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[r["component"] - 1] / np.trace(v), rel_tol=1e-12)


@pytest.mark.parametrize("spectrum", [[9.0] * 5 + [4.0] * 4 + [1.0] * 7, list(10.0 ** -np.arange(16)),
                                      [1.0, 1.0 + 1e-9, 1.0 + 1e-6, *[0.5] * 13], [0.0] * 15 + [2.0]])
def test_slicing_separates_close_and_equal_eigenvalues(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((d, d)))
    a = q @ np.diag(spectrum) @ q.T
    a = (a + a.T) / 2
    k = W.count_above(a, 1e-9)
    assert k == sum(s > 1e-9 for s in spectrum)
    values, axes = W.leading(a, k)
    assert np.abs(values - sorted(spectrum, reverse=True)[:k]).max() < 1e-13 * max(spectrum) * d
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13 and np.abs(a @ axes - axes * values).max() < 1e-12 * max(spectrum)


def test_counts_are_the_inertia():
    rng = np.random.default_rng(8)
    for d in (1, 2, 3, 9, 30):
        a = rng.integers(-3, 4, (d, d)).astype(float)
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
            if np.abs(values - shift).min() > 1e-9:
                assert W.count_above(a, shift) == (values > shift).sum()
    assert W.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # no usable pivot of one row


def test_odd_vectors(spark):
    good = [[1, 2, 3], [2, 1, 0], [0, 0, 1], [5, 5, 5], [1, 2, 3]]
    odd = [None, [], [1, None, 2], [float("nan"), 0, 0], [float("inf"), 0, 0], [1e30, 0, 0], [1, 2]]
    rows = W.whiten(table(spark, good + odd)).collect()
    assert {r["vec_id"] for r in rows} == set(range(5)) and {r["n"] for r in rows} == {5}
    assert {r["component"] for r in rows} == {1, 2, 3} and max(r["identity_error"] for r in rows) < 1e-10
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append((r["component"], r["whitened"], r["deviation"]))
    assert sorted(by[0]) == sorted(by[4])  # a repeated vector
    null_id = table(spark, good).withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))
    assert sum(r["vec_id"] is None for r in W.whiten(null_id).collect()) == 3


def test_nothing_to_whiten(spark):
    for vectors in ([], [None], [[]], [[1, 2]], [[1, 2], [1, 2]]):
        assert W.whiten(table(spark, vectors)).collect() == []


def test_large_entries_stay_exact(spark):
    vectors = [[2.0 ** 40, 1.0], [2.0 ** 40 + 2 ** 17, 2.0], [0.0, 5.0]]
    model = W.fit(table(spark, vectors))
    x = [[int(a * 64) for a in v] for v in vectors]
    s = [sum(r[j] for r in x) for j in range(2)]
    trace = sum((3 * r[j] - s[j]) ** 2 for r in x for j in range(2)) / 27
    assert math.isclose(model.trace, trace, rel_tol=1e-15)
    far = {r["vec_id"]: int(r["deviation"]) for r in W.transform(table(spark, vectors), model).collect()}
    assert far == {i: sum((3 * r[j] - s[j]) ** 2 for j in range(2)) for i, r in enumerate(x)}


def test_query_over_the_whole_table(spark):
    rows = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert {r["n"] for r in rows} == {len({r["vec_id"] for r in rows})} and len(rows) == 32 * rows[0]["n"] <= 32 * n
    assert rows[0]["identity_error"] < 1e-4
