"""Run tables: training log (S11, A15, W6), grid-search summary (A10, T3) and importance tables
(A11, T2, P12).

A run log has one record per logged step. Logs are small by nature (one record per evaluation or
per logging interval), so windows over a whole log are fine; the inputs that produce them (scored
reviews) are aggregated in Spark first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.operators import metrics as ME
from veritext.schemas import LOG_RECORD

LOG_FIELDS = [f.name for f in LOG_RECORD.fields]


def eval_records(scored: DataFrame, p_pos: str, period: str = "fold", y: str = "y") -> DataFrame:
    """Evaluation records, one per ``period`` value: accuracy, precision, recall, F1 and loss of the
    positive-class probability, with ``epoch = period + 1`` and ``step`` = rows seen so far."""
    pred = (F.col(p_pos) > 1.0 - F.col(p_pos)).cast("int")
    p = F.least(F.greatest(F.col(p_pos), F.lit(ME.EPS)), F.lit(1 - ME.EPS))
    ll = -(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))
    t = scored.filter(F.col(y).isNotNull())
    c = t.groupBy(period).agg(
        F.count_if((F.col(y) == 1) & (pred == 1)).alias("tp"),
        F.count_if((F.col(y) == 0) & (pred == 1)).alias("fp"),
        F.count_if((F.col(y) == 1) & (pred == 0)).alias("fn"),
        F.count_if((F.col(y) == 0) & (pred == 0)).alias("tn"),
        F.avg(ll).alias("eval_loss"),
        F.count("*").alias("n"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = ME._div(tp, tp + fp), ME._div(tp, tp + fn)
    seen = F.sum("n").over(Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0))
    return c.select(
        (F.col(period) + 1).cast("double").alias("epoch"),
        seen.cast("int").alias("step"),
        F.round(ME._div(tp + tn, F.col("n")), 6).alias("eval_accuracy"),
        F.round(ME._div(2 * prec * rec, prec + rec), 6).alias("eval_f1"),
        F.round("eval_loss", 6).alias("eval_loss"),
        F.round(prec, 6).alias("eval_precision"),
        F.round(rec, 6).alias("eval_recall"),
    )


def log_document(records: DataFrame, run_id: str) -> DataFrame:
    """One row per run in the trainer-state shape: ``log_history`` sorted by step, best F1."""
    full = records.select(*[
        (F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in LOG_RECORD.fields])
    agg = full.agg(
        F.max("eval_f1").alias("best_metric"),
        F.max_by("step", F.struct(F.col("eval_f1"), -F.col("step"))).alias("_best_step"),
        F.array_sort(F.collect_list(F.struct(*LOG_FIELDS))).alias("log_history"),
    )
    return agg.select(F.lit(run_id).alias("run_id"), "best_metric",
                      F.concat(F.lit("checkpoint-"), F.col("_best_step").cast("string"))
                       .alias("best_model_checkpoint"), "log_history")


def explode_log(doc: DataFrame) -> DataFrame:
    """One row per record, run id kept."""
    return doc.select("run_id", F.inline("log_history"))


def best_record(records: DataFrame, metric: str = "eval_f1") -> DataFrame:
    """The record with the highest metric (earliest step on ties), per run."""
    ev = records.filter(F.col(metric).isNotNull())
    best = ev.groupBy("run_id").agg(
        F.max_by(F.struct(*[c for c in ev.columns if c != "run_id"]),
                 F.struct(F.col(metric), -F.col("step"))).alias("b"))
    return best.select("run_id", "b.*")


def early_stop(records: DataFrame, metric: str = "eval_f1", patience: int = 2,
               keep_last: int = 2) -> DataFrame:
    """Running best, evaluations without gain, the stop point, and which checkpoints a
    keep-``keep_last`` policy (plus the best one) retains."""
    ev = records.filter(F.col(metric).isNotNull())
    w = Window.partitionBy("run_id").orderBy("step")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumns({
        "_rn": F.row_number().over(w),
        "running_best": F.max(metric).over(upto),
        "_prev_best": F.max(metric).over(before),
    })
    ev = ev.withColumn("improved", F.col("_prev_best").isNull() | (F.col(metric) > F.col("_prev_best")))
    last_imp = F.max(F.when(F.col("improved"), F.col("_rn"))).over(upto)
    ev = ev.withColumn("evals_without_gain", (F.col("_rn") - last_imp).cast("int"))
    first_stop = F.min(F.when(F.col("evals_without_gain") >= patience, F.col("step"))).over(
        Window.partitionBy("run_id"))
    ev = ev.withColumn("stop_step", first_stop)
    rn_desc = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("step")))
    is_best = F.col(metric) == F.max(metric).over(Window.partitionBy("run_id"))
    first_best = F.min(F.when(is_best, F.col("step"))).over(Window.partitionBy("run_id"))
    ev = ev.withColumn("keep_checkpoint", (rn_desc <= keep_last) | (F.col("step") == first_best))
    return ev.select("run_id", "epoch", "step", metric, "running_best", "improved",
                     "evals_without_gain", "stop_step", "keep_checkpoint")


# ---- grid search ---------------------------------------------------------------------------------

def fold_scores(scored: DataFrame, params: list[tuple], param_names: list[str], score_fn,
                fold: str = "fold", k: int = 5, y: str = "y") -> DataFrame:
    """Per (param set, fold): AUC on the fold (test) and on the other folds (train).

    ``params`` is a short list of tuples ``(param_id, *values)``; every row is scored under each set
    by ``inline`` over a literal array (a projection, not a join) and collapses to counts per (param, fold,
    score) before any shuffle; only these counts are repeated, as test for their own fold and as train for
    the k - 1 others. ``auc_from_counts`` runs per group.
    """
    grid = F.array(*[F.struct(F.lit(p[0]).alias("param_id"),
                              *[F.lit(v).alias(n) for n, v in zip(param_names, p[1:])])
                     for p in params])
    g = scored.filter(F.col(y).isNotNull()).select("*", F.inline(grid))
    g = g.withColumn("_score", score_fn(*[F.col(n) for n in param_names]))
    own = g.groupBy("param_id", F.col(fold).alias("_fold"), "_score").agg(
        F.sum(F.col(y).cast("long")).alias("_p"), F.sum((1 - F.col(y)).cast("long")).alias("_n"))
    roles = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                        lambda f: F.struct(f.alias("fold_id"),
                                           F.when(f == F.col("_fold"), F.lit("test")).otherwise(F.lit("train"))
                                            .alias("role")))
    counts = own.select("param_id", "_score", "_p", "_n", F.inline(roles)).groupBy(
        "param_id", "fold_id", "role", "_score").agg(F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    auc = ME.auc_from_counts(counts, "_score", "_pos", "_neg", ["param_id", "fold_id", "role"])
    wide = auc.groupBy("param_id", "fold_id").pivot("role", ["test", "train"]).agg(F.first("auc"))
    return wide.select("param_id", F.col("fold_id").alias("fold"), F.col("test").alias("test_auc"),
                       F.col("train").alias("train_auc"))


def grid_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of test and train AUC per parameter set, rank by mean test
    AUC (lowest id first on ties) and the best set flagged."""
    s = scores.groupBy("param_id").agg(
        F.round(F.avg("test_auc"), 6).alias("mean_test_auc"),
        F.round(F.stddev_pop("test_auc"), 6).alias("std_test_auc"),
        F.round(F.avg("train_auc"), 6).alias("mean_train_auc"),
        F.round(F.stddev_pop("train_auc"), 6).alias("std_train_auc"),
    )
    rank = F.row_number().over(Window.orderBy(F.desc("mean_test_auc"), "param_id"))
    return s.withColumn("rank_test", rank.cast("int")).withColumn("is_best", F.col("rank_test") == 1)


# ---- importances ---------------------------------------------------------------------------------

def univariate_importance(df: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """Model-free importance: |corr(feature, y)| normalized to sum 1 (undefined -> 0)."""
    t = df.filter(F.col(y).isNotNull())
    wide = t.agg(*[F.coalesce(F.abs(F.corr(F.col(f).cast("double"), F.col(y).cast("double"))), F.lit(0.0))
                   .alias(f) for f in features])
    longf = wide.unpivot([], features, "feature", "raw")
    total = F.sum("raw").over(Window.partitionBy())
    return longf.select("feature", F.round(ME._div(F.col("raw"), total), 6).alias("importance"))


def importance_topk(imp: DataFrame, k: int = 10) -> DataFrame:
    """Highest first, ties by name, top k with their rank."""
    r = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    return imp.withColumn("rank", r.cast("int")).filter(F.col("rank") <= k)


def select_by_importance(imp: DataFrame, order: list[str], threshold: float) -> DataFrame:
    """Features with importance >= threshold, in the matrix's column order."""
    pos = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("feature")).cast("int") - 1
    return imp.filter(F.col("importance") >= threshold).select(pos.alias("position"), "feature", "importance")
