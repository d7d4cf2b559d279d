"""Evaluation tables (A6-A9, A14, J6, J7, M5, F3): each is a DataFrame, computed in Spark.

Counting metrics are one aggregate pass (partial aggregation, one tiny shuffle). ROC AUC is exact
and tie-aware without a global sort (see ``roc_auc``).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.session import cut_lineage


EPS = 1e-15


def _div(a, b):
    """``a / b``, 0.0 when undefined (the reference's zero-division behaviour)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", labels=(0, 1)) -> DataFrame:
    """``(y, pred, n)`` over the full label grid, zero-filled. One aggregate pass."""
    counts = df.filter(F.col(y).isNotNull()).agg(*[
        F.count_if((F.col(y) == a) & (F.col(pred) == b)).cast("bigint").alias(f"n_{a}_{b}")
        for a in labels for b in labels])
    cells = ", ".join(f"{a}, {b}, n_{a}_{b}" for a in labels for b in labels)
    return counts.selectExpr(f"stack({len(labels) ** 2}, {cells}) AS ({y}, {pred}, n)")


def _binary_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    t = df.filter(F.col(y).isNotNull())
    return t.agg(
        F.count_if((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"),
        F.count_if((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"),
        F.count_if((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn"),
        F.count_if((F.col(y) == 0) & (F.col(pred) == 0)).alias("tn"),
    )


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall, F1 for positive class 1; one row."""
    c = _binary_counts(df, y, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p = _div(tp, tp + fp)
    r = _div(tp, tp + fn)
    return c.select(
        F.round(_div(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"),
        F.round(p, 6).alias("precision"),
        F.round(r, 6).alias("recall"),
        F.round(_div(2 * p * r, p + r), 6).alias("f1"),
        (tp + fp + fn + tn).cast("bigint").alias("n"),
    )


def class_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / F1 / support, accuracy, macro and weighted averages.

    Long form ``(class_label, metric, value)``; undefined ratios are 0.
    """
    c = _binary_counts(df, y, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    per = {}
    # class 1: positives are y = 1; class 0: the mirror image
    for cls, (t_p, f_p, f_n) in {"1": (tp, fp, fn), "0": (tn, fn, fp)}.items():
        p = _div(t_p, t_p + f_p)
        r = _div(t_p, t_p + f_n)
        per[cls] = {"precision": p, "recall": r, "f1": _div(2 * p * r, p + r),
                    "support": (t_p + f_n).cast("double")}
    s0, s1 = per["0"]["support"], per["1"]["support"]
    cols = {}
    for cls in ("0", "1"):
        for m, e in per[cls].items():
            cols[f"{cls}|{m}"] = e
    for m in ("precision", "recall", "f1"):
        cols[f"macro avg|{m}"] = (per["0"][m] + per["1"][m]) / 2.0
        cols[f"weighted avg|{m}"] = _div(per["0"][m] * s0 + per["1"][m] * s1, s0 + s1)
    cols["macro avg|support"] = n.cast("double")
    cols["weighted avg|support"] = n.cast("double")
    cols["accuracy|accuracy"] = _div(tp + tn, n)
    wide = c.select(*[F.round(e, 6).alias(k) for k, e in cols.items()])
    longf = wide.unpivot([], list(cols), "key", "value")
    parts = F.split(F.col("key"), r"\|")
    return longf.select(parts[0].alias("class_label"), parts[1].alias("metric"), "value")


def roc_auc(df: DataFrame, score: str, y: str = "y", group: list[str] = (),
            bins: int = 1024) -> DataFrame:
    """Exact ROC AUC with ties counted one half, per group.

    AUC = sum over positives of (negatives scored lower + half the negatives scored equal) / (P N).
    Rows collapse to ``(group, score) -> (positives, negatives)`` first (partial aggregation: the
    shuffle carries distinct scores, not rows); ``auc_from_counts`` does the rest.
    """
    group = list(group)
    # Only the label is filtered here: a predicate on a computed score would be pushed below any
    # repartition of the input and evaluated there. Null scores are dropped after the distinct
    # scores are checkpointed.
    s = df.filter(F.col(y).isNotNull())
    per_score = (s.groupBy(*group, F.col(score).alias("_s"))
                  .agg(F.sum(F.col(y).cast("long")).alias("_pos"),
                       F.sum((1 - F.col(y)).cast("long")).alias("_neg")))
    return auc_from_counts(per_score, "_s", "_pos", "_neg", group, bins)


def auc_from_counts(per_score: DataFrame, score: str, pos: str, neg: str, group: list[str] = (),
                    bins: int = 1024) -> DataFrame:
    """AUC from one row per (group, distinct score) with positive and negative counts.

    Distinct scores go into ``bins`` equi-depth bins (boundaries from ``percentile_approx`` over the
    distinct scores, assigned by a binary-search ``Bucketizer``), so clustered scores still spread
    over all bins. Per-bin negative totals and their running sum form a table of at most
    groups x bins rows; the running count of lower negatives *inside* a bin is a window partitioned
    by (group, bin): many small partitions, so no task sees all distinct scores. The distinct-score
    table is checkpointed to the shared folder, so the boundary job and the AUC share one pass over
    the input without holding executor memory, and a lost executor does not re-run the input.
    """
    group = list(group)
    ps = cut_lineage(per_score.select(*group, F.col(score).cast("double").alias("_s"),
                                      F.col(pos).alias("_pos"), F.col(neg).alias("_neg")))
    qs = [i / bins for i in range(1, bins)]
    row = ps.agg(F.percentile_approx("_s", qs, 10 * bins).alias("b")).first()
    bounds = sorted({float(x) for x in (row["b"] or []) if x is not None and not math.isnan(x)})
    splits = [-math.inf] + bounds + [math.inf]
    ps = Bucketizer(splits=splits, inputCol="_s", outputCol="_bin_d", handleInvalid="keep") \
        .transform(ps).withColumn("_bin", F.col("_bin_d").cast("int")).drop("_bin_d") \
        .filter(F.col("_s").isNotNull() & ~F.isnan("_s"))  # above the checkpoint: not pushed into the input
    bin_tot = ps.groupBy(*group, "_bin").agg(F.sum("_neg").alias("_bneg"))
    wb = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bin_off = bin_tot.select(*group, "_bin", F.coalesce(F.sum("_bneg").over(wb), F.lit(0)).alias("_boff"))
    # equi-join on (group, bin): the in-bin window needs that partitioning anyway, so the join adds
    # no shuffle of the score rows (AQE may still broadcast the small side)
    joined = ps.join(bin_off, group + ["_bin"])
    wi = Window.partitionBy(*group, "_bin").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_boff") + F.coalesce(F.sum("_neg").over(wi), F.lit(0))
    contrib = joined.withColumn("_c", F.col("_pos") * (below + 0.5 * F.col("_neg")))
    out = contrib.groupBy(*group).agg(
        F.sum("_c").alias("_num"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return out.select(*group, F.round(_div(F.col("_num"), F.col("n_pos") * F.col("n_neg")), 6).alias("auc"),
                      F.col("n_pos").cast("bigint"), F.col("n_neg").cast("bigint"))


def log_loss(df: DataFrame, p_pos: str, y: str = "y", group: list[str] = ()) -> DataFrame:
    """Mean cross-entropy with probabilities clipped to [1e-15, 1 - 1e-15]."""
    p = F.least(F.greatest(F.col(p_pos), F.lit(EPS)), F.lit(1 - EPS))
    ll = -(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))
    t = df.filter(F.col(y).isNotNull())
    return t.groupBy(*group).agg(F.round(F.avg(ll), 6).alias("log_loss"),
                                 F.count("*").cast("bigint").alias("n"))


def compare_models(scored: DataFrame, models: dict[str, str], y: str = "y") -> DataFrame:
    """AUC per model over the same rows. ``models``: name -> score column; one pass over
    ``scored`` stacks the score columns."""
    stack = F.inline(F.array(*(F.struct(F.lit(name).alias("model"), F.col(c).alias("p"))
                               for name, c in models.items())))
    return roc_auc(scored.select(y, stack), "p", y, group=["model"])
