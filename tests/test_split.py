"""Splits and folds: exact sizes, disjointness, balance, and equality with a brute-force sort."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from veritext.operators import features as FE
from veritext.operators import split as SP
from veritext.sources import tables as TB


def _h(i, seed=42):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


def _labelled(spark):
    return FE.label_map(TB.doc_labels(spark, SF_CHECK)).filter(F.col("y").isNotNull()).select("review_id", "y")


def test_hash_split_matches_python(spark):
    rows = SP.split_hash(TB.documents_unlabelled(spark, SF_CHECK).select("review_id")).collect()
    for r in rows:
        assert r["split"] == ("test" if _h(r["review_id"])[:8] < "33333333" else "train")
    share = sum(r["split"] == "test" for r in rows) / len(rows)
    assert 0.12 < share < 0.28


def test_exact_split_sizes_and_membership(spark):
    ids = [r[0] for r in TB.documents_unlabelled(spark, SF_CHECK).select("review_id").collect()]
    got = {r["review_id"]: r["split"] for r in SP.split_exact(
        TB.documents_unlabelled(spark, SF_CHECK).select("review_id")).collect()}
    assert sorted(got) == sorted(ids)  # every row exactly once
    k = math.ceil(0.2 * len(ids))
    want_test = set(sorted(ids, key=lambda i: (_h(i), i))[:k])
    assert {i for i, s in got.items() if s == "test"} == want_test


def test_stratified_split_and_folds(spark):
    lab = _labelled(spark)
    rows = {r["review_id"]: r["y"] for r in lab.collect()}
    split = {r["review_id"]: r["split"] for r in SP.split_exact(lab, strata=["y"]).collect()}
    folds = {r["review_id"]: r["fold"] for r in SP.fold_assign(lab).collect()}
    by_y = defaultdict(list)
    for i, y in rows.items():
        by_y[y].append(i)
    for y, ids in by_y.items():
        order = sorted(ids, key=lambda i: (_h(i), i))
        k = math.ceil(0.2 * len(ids))
        assert {i for i in ids if split[i] == "test"} == set(order[:k])
        assert all(folds[i] == n % 5 for n, i in enumerate(order))
        sizes = Counter(folds[i] for i in ids).values()
        assert max(sizes) - min(sizes) <= 1


def test_rank_is_exact_with_many_buckets_and_nulls(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("review_id"),
                                     F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 2)
                                      .alias("y"))
    got = {r["review_id"]: r["rank"] for r in SP.hash_rank(df, ["y"], bucket_digits=2).collect()}
    by = defaultdict(list)
    for i in range(5000):
        by[None if i % 7 == 0 else i % 2].append(i)
    for ids in by.values():
        for n, i in enumerate(sorted(ids, key=lambda i: (_h(i), i))):
            assert got[i] == n + 1


def test_folds_under_heavy_label_skew(spark):
    """90 % of rows in one label: ranks stay exact and every window group stays small."""
    n = 200_000
    df = spark.range(0, n).select(F.col("id").alias("review_id"),
                                  F.when(F.col("id") % 10 == 0, F.lit(0)).otherwise(F.lit(1)).alias("y"))
    folds = SP.fold_assign(df)
    sizes = {(r["y"], r["fold"]): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        vals = [sizes[(y, f)] for f in range(5)]
        assert max(vals) - min(vals) <= 1
    buckets = (df.withColumn("_b", F.substring(SP.seeded_hash(), 1, 4)).groupBy("y", "_b").count()
                 .agg(F.max("count")).first()[0])
    assert buckets < n / 1000  # the largest ranking group is a tiny share of the hot label
