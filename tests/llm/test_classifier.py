"""Quality classifier: its parts against brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.data import edge_docs, edge_rows, empty_docs
from veritext.llm import classifier as C, queries

NO_LABELS = "doc_id long, quality int"


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, len(C.FEATURES)))
    z = C.mapped(x, np.zeros(x.shape[1]), np.ones(x.shape[1]), width=20_000)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-far / (2 * C.BANDWIDTH ** 2))).max() < 0.04


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(2)
    x, n = np.arange(30.0), rng.integers(1, 5, 30).astype(float)
    y = rng.binomial(n.astype(int), np.linspace(0.1, 0.9, 30)).astype(float)
    at, share = C.isotonic(x, n, y)
    assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
    # max-min formula of isotonic regression, by brute force
    want = [max(min(y[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(sorted(set(np.round(want, 12))), share)


def test_normal_equations_equal_a_direct_solution(spark):
    rng = np.random.default_rng(4)
    stats = rng.standard_normal((200, len(C.FEATURES)))
    y = (stats[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([(s.tolist(), float(v)) for s, v in zip(stats, y)], "stats array<double>, y double")
    model = C.Classifier(stats.mean(axis=0), stats.std(axis=0), None)
    zz, zy = C._normal_equations(rows.repartition(5), model)
    z = C.mapped(stats, model.mean, model.spread)
    assert np.allclose(zz, z.T @ z) and np.allclose(zy, z.T @ y)


def test_statistics_of_odd_texts():
    assert C.statistics_of(b"") == C.statistics_of(b" \n\t ") == [0.0] * len(C.FEATURES)
    one = dict(zip(C.FEATURES, C.statistics_of(b"AB#1")))
    assert one["symbols"] == one["digits"] == 0.25 and one["capitals"] == 0.5 and one["commonest_word"] == 1.0
    twice = dict(zip(C.FEATURES, C.statistics_of(b"a b c d e f\na b c d e f\n")))
    assert twice["repeated_lines"] == 0.5 and np.isclose(twice["repeated_windows"], 2 / 8)
    assert np.isfinite(C.statistics_of(("x" * 300_000 + " " + "y z " * 100_000).encode())).all()


def test_odd_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 1), (4, 0), (5, 0), (9, 0), (None, 1), (99, 1)], NO_LABELS)
    got = C.classify(docs, labels, F.col("doc_id") > 0).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] == 1}
    assert len(same) == 1  # repeated rows
    none = spark.createDataFrame([], NO_LABELS)
    assert {r["score"] for r in C.classify(docs, none, F.lit(True)).collect()} == {0.5}
    assert C.classify(empty_docs(spark), labels, F.lit(True)).collect() == []
    one_kind = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 1)], NO_LABELS)
    assert all(r["score"] > 0.5 for r in C.classify(docs, one_kind, F.lit(True)).collect() if r["doc_id"] in (1, 2, 3))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = got.filter("held_out").join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [r["predicted"] for r in held if r["quality"] == 1]
    bad = [r["predicted"] for r in held if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.15
    # calibrated: the mean score is the share of good documents
    assert abs(np.mean([r["score"] for r in held]) - len(good) / len(held)) < 0.03
