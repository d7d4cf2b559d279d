"""Metric tables against brute force; AUC and blend properties."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from veritext.operators import metrics as ME
from veritext.operators import scoring as SC
from veritext.plans.catalog_metrics import score_docs, with_pred


def brute_auc(pairs):
    pos = [p for p, y in pairs if y == 1]
    neg = [p for p, y in pairs if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def test_auc_equals_pairwise_count(spark):
    rows = score_docs(spark, SF_CHECK).filter(F.col("y").isNotNull()).select("p_tree", "p_text", "y").collect()
    for col in ("p_tree", "p_text"):
        want = brute_auc([(r[col], r["y"]) for r in rows])
        got = ME.roc_auc(score_docs(spark, SF_CHECK), col).collect()[0]["auc"]
        assert abs(got - want) < 1e-6


def test_auc_with_ties_groups_and_few_bins(spark):
    rnd = random.Random(3)
    data = [(g, round(rnd.random(), 2), rnd.randint(0, 1)) for g in ("a", "b") for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, p double, y int")
    got = {r["g"]: r["auc"] for r in ME.roc_auc(df, "p", group=["g"], bins=8).collect()}
    for g in ("a", "b"):
        assert abs(got[g] - brute_auc([(p, y) for gg, p, y in data if gg == g])) < 1e-6
    flipped = ME.roc_auc(df.withColumn("p", 1 - F.col("p")), "p", group=["g"]).collect()
    for r in flipped:
        assert abs(r["auc"] - (1 - got[r["g"]])) < 1e-6


def test_confusion_sums_to_n_and_matches_report(spark):
    s = with_pred(score_docs(spark, SF_CHECK))
    n = s.filter(F.col("y").isNotNull()).count()
    conf = {(r["y"], r["pred"]): r["n"] for r in ME.confusion(s).collect()}
    assert len(conf) == 4 and sum(conf.values()) == n
    rep = {(r["class_label"], r["metric"]): r["value"] for r in ME.class_report(s).collect()}
    tp, fp, fn = conf[(1, 1)], conf[(0, 1)], conf[(1, 0)]
    assert abs(rep[("1", "precision")] - round(tp / (tp + fp), 6)) < 1e-9
    assert abs(rep[("1", "recall")] - round(tp / (tp + fn), 6)) < 1e-9
    assert rep[("1", "support")] == tp + fn


def test_blend_lies_between_inputs(spark):
    h = SC.hybrid(score_docs(spark, SF_CHECK)).collect()
    for r in h:
        a, b = 1 - float(r["confidence_tree"] if r["label_tree"] == "Human" else 1 - r["confidence_tree"]), \
            1 - float(r["confidence_text"] if r["label_text"] == "Human" else 1 - r["confidence_text"])
        assert min(a, b) - 1e-12 <= r["final_score"] <= max(a, b) + 1e-12
        assert r["confidence"] >= 0.5 and r["is_uncertain"] == (r["confidence"] < 0.7)


def test_auc_with_clustered_scores_and_nulls(spark):
    """Scores packed into [0.49, 0.51] (unrounded) still split evenly; null scores drop out."""
    rnd = random.Random(11)
    data = [(0.49 + 0.02 * rnd.random(), rnd.randint(0, 1)) for _ in range(4000)] + [(None, 1), (None, 0)]
    df = spark.createDataFrame(data, "p double, y int")
    got = ME.roc_auc(df, "p", bins=64).collect()[0]
    assert abs(got["auc"] - brute_auc([(p, y) for p, y in data if p is not None])) < 1e-6
    assert got["n_pos"] + got["n_neg"] == 4000


def test_hybrid_from_two_score_tables_equals_one_projection(spark):
    """Scores kept in separate tables and joined on the key give the same verdicts."""
    s = score_docs(spark, SF_CHECK)
    joined = SC.join_model_scores(s.select("review_id", "p_tree"), s.select("review_id", "p_text"))
    a = sorted(tuple(r) for r in SC.hybrid(joined).select("review_id", "final_score", "final_label").collect())
    b = sorted(tuple(r) for r in SC.hybrid(s).select("review_id", "final_score", "final_label").collect())
    assert a == b and len(a) > 0
