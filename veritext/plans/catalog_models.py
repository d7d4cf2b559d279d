"""Registered queries, part 7: Spark ML training, persistence and trained scoring.

Model outputs have no SQL oracle. Keys whose rows, labels or invariants SQL can state have one for these;
``tests/test_models.py`` checks every key's numbers by their properties.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veritext.constants import NUMERIC_FEATURES, TAG_FEATURES, WS_CLASS_RE2
from veritext.operators import features as FE
from veritext.operators import metrics as ME
from veritext.operators import models as MO
from veritext.operators import scoring as SC
from veritext.operators import split as SP
from veritext.operators import textmodel as TM
from veritext.plans.catalog_matrix import featurized, full_features
from veritext.plans.registry import query
from veritext.plans.sql import _q, clean_sql, with_views
from veritext.session import scratch_path, written
from veritext.sources import tables as TB


_TEST = "substr(md5(CAST(review_id AS VARCHAR) || ':42'), 1, 8) < '33333333'"
_HELD = with_views("reviews_docs") + f"""
, held AS (SELECT review_id, CASE label WHEN 'OR' THEN 1 WHEN 'CG' THEN 0 END AS y FROM reviews_docs
           WHERE label IN ('OR', 'CG') AND {_TEST})"""


def train_test(spark, sf):
    """Featurized, labelled reviews with the shared hash split, checkpointed for the iterative fits."""
    d = SP.split_hash(MO.prepared(full_features(spark, sf, labelled=True)))
    return d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")


def baseline(train):
    """M1: the reference's baseline (100 trees, depth 4)."""
    return MO.fit_trees(train, max_iter=100, max_depth=4, seed=42)


@query("train_gbt", _HELD + "SELECT review_id, y, true AS valid FROM held")
def q_train_gbt(spark, sf):
    """M1 / M2: the baseline scores every held-out row with a probability, and its class follows."""
    train, test = train_test(spark, sf)
    s = MO.score(baseline(train), test)
    valid = F.col("p_pos").between(0.0, 1.0) & ((F.col("p_pos") > 0.5) == (F.col("pred") == 1))
    return s.select("review_id", F.col("y").cast("int").alias("y"), valid.alias("valid"))


@query("importance_splits", with_views("reviews_docs") + f"""
, cats AS (SELECT DISTINCT category FROM reviews_docs WHERE label IN ('OR', 'CG') AND NOT {_TEST}),
slots AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_q(n)})" for i, n in enumerate(NUMERIC_FEATURES + TAG_FEATURES))}) v(position, feature)
  UNION ALL SELECT {len(NUMERIC_FEATURES + TAG_FEATURES) - 1} + row_number() OVER (ORDER BY category), 'category_' || category FROM cats)
SELECT CAST(position AS INT) AS position, feature, 1.0::DOUBLE AS gain_total, true AS used_is_split FROM slots""")
def q_importance_splits(spark, sf):
    """The baseline's matrix slots; gains sum to 1, and a slot has gain only where trees split
    on it."""
    train, _ = train_test(spark, sf)
    model = baseline(train)
    names = MO.feature_names(model, train)
    gain = dict(MO.gain_importances(model, names))
    total = round(sum(gain.values()), 6)
    rows = [(i, n, total, gain[n] == 0 or c > 0) for i, (n, c) in enumerate(MO.split_counts(model, names))]
    return spark.createDataFrame(rows, "position int, feature string, gain_total double, used_is_split boolean")


@query("importance_top_gain")
def q_importance_top_gain(spark, sf):
    """The ten slots of highest gain, over the numeric block, tags and every category slot."""
    train, _ = train_test(spark, sf)
    model = baseline(train)
    names = MO.feature_names(model, train)
    splits = dict(MO.split_counts(model, names))
    top = sorted(MO.gain_importances(model, names), key=lambda r: (-r[1], r[0]))[:10]
    return spark.createDataFrame([(i + 1, n, round(g, 6), splits[n]) for i, (n, g) in enumerate(top)],
                                 "rank int, feature string, gain double, splits int")


@query("train_gbt_early")
def q_train_gbt_early(spark, sf):
    """M7: boosting stops when the validation loss stops improving."""
    train, test = train_test(spark, sf)
    val_hash = F.substring(SP.seeded_hash(seed=7), 1, 8)
    train = train.withColumn("is_val", val_hash < F.lit(SP.TEST_HASH_CUT))
    model = MO.fit_trees(train, max_iter=100, max_depth=4, seed=42,
                         validationIndicatorCol="is_val", validationTol=0.01)
    auc = MO.auc_of(model.transform(test))
    trees = len(model.stages[-1].trees)
    return spark.createDataFrame([(trees, round(auc, 6))], "trees_used int, test_auc double")


def text_rows(spark, sf):
    """Chat turns split three ways by hash, words hashed to slots, written once."""
    chat = FE.label_map(TB.reviews_chat(spark, sf)).filter(F.col("y").isNotNull())
    chat = SP.split_exact(chat, strata=["y"])  # before the clean-up: the cut is found on keys and labels
    chat = FE.with_clean_text(chat).filter(F.col("cleaned_text") != "")
    val = F.substring(SP.seeded_hash(seed=7), 1, 8) < F.lit(SP.TEST_HASH_CUT)
    part = (F.when(F.col("split") == "test", F.lit(TM.TEST)).when(val, F.lit(TM.VALIDATION)).otherwise(F.lit(TM.TRAIN)))
    return TM.prepared(chat.withColumn("part", part))


LOG = ("epoch double, step int, loss double, eval_accuracy double, eval_precision double, eval_recall double, "
       "eval_f1 double, eval_loss double, n int")


@query("train_text")
def q_train_text(spark, sf):
    """M6: text-only classifier on human vs machine turns, trained in rounds: one record per round on the
    validation rows, two rounds without gain stop it, and the best round's saved weights are evaluated on
    the test rows."""
    rows = text_rows(spark, sf)
    log, path = TM.fit_rounds(rows)
    best = TM.best_round(log)
    test = TM.evaluate(TM.load_round(spark, path, best), rows).select(
        F.lit(best).alias("step"), F.col("f1").alias("test_f1"), F.col("n").alias("test_n"))
    return spark.createDataFrame(log, LOG).join(test, "step", "left").withColumn("is_best", F.col("step") == best)


_TEXT_SQL = with_views("reviews_chat") + f"""
, chat AS (SELECT review_id, CASE label WHEN 'OR' THEN 1 WHEN 'CG' THEN 0 END AS y, text_ FROM reviews_chat
  WHERE label IN ('OR', 'CG')),
cut AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id)
   <= ceil(0.2 * count(*) OVER (PARTITION BY y)) AS test FROM chat),
txt AS (SELECT review_id, y, list_filter(regexp_split_to_array({clean_sql('text_')}, '[{WS_CLASS_RE2}]+'), lambda x: x <> '') AS w,
   CASE WHEN test THEN 'test' WHEN substr(md5(CAST(review_id AS VARCHAR) || ':7'), 1, 8) < '33333333' THEN 'validation'
    ELSE 'train' END AS part FROM cut WHERE {clean_sql('text_')} <> ''),
oc AS (SELECT review_id, y, part, root, CAST(('0x' || substr(md5(x), 1, 8))::BIGINT % {TM.SLOTS} AS INT) AS slot
  FROM (SELECT review_id, y, part, sqrt(len(w)) AS root, unnest(w) AS x FROM txt)),
sz AS (SELECT count(*)::DOUBLE AS n FROM txt WHERE part = 'train'),
idf AS (SELECT slot, ln((n + 1) / (count(DISTINCT review_id) + 1)) AS idf FROM oc, sz WHERE part = 'train' GROUP BY slot, n),
gr AS (SELECT slot, sum((0.5::DOUBLE - y) / root) * idf / n AS g, idf FROM oc JOIN idf USING (slot), sz WHERE part = 'train'
  GROUP BY slot, idf, n)
"""


@query("text_gradient", _TEXT_SQL + "SELECT slot, round(idf, 6) AS idf, round(g, 6) AS gradient FROM gr WHERE abs(g) > 1e-9")
def q_text_gradient(spark, sf):
    """M6: the first gradient of the training, by slot."""
    rows = text_rows(spark, sf)
    model = TM.TextModel(TM.slot_weights(rows.filter(F.col("part") == TM.TRAIN)), np.zeros(TM.SLOTS))
    g, _, _ = TM.gradient(rows, model)
    at = np.flatnonzero(np.abs(g) > 1e-9)
    frame = pd.DataFrame({"slot": at.astype("int32"), "idf": model.idf[at], "gradient": g[at]})
    return spark.createDataFrame(frame, "slot int, idf double, gradient double").select(
        "slot", F.round("idf", 6).alias("idf"), F.round("gradient", 6).alias("gradient"))


_STEP = TM.Rounds()


@query("text_first_round", _TEXT_SQL + f"""
, wt AS (SELECT slot, -{_STEP.learning_rate}::DOUBLE * g / (abs(g) + {_STEP.eps!r}::DOUBLE) * idf AS wi FROM gr),
bias AS (SELECT -{_STEP.learning_rate}::DOUBLE * g / (abs(g) + {_STEP.eps!r}::DOUBLE) AS b
  FROM (SELECT sum(0.5::DOUBLE - y) / count(*) AS g FROM txt WHERE part = 'train')),
sc AS (SELECT t.review_id, t.y, coalesce(m.m, 0.0::DOUBLE) + b AS m FROM txt t LEFT JOIN (SELECT review_id, sum(wi / root) AS m
   FROM oc JOIN wt USING (slot) WHERE part = 'validation' GROUP BY 1) m USING (review_id), bias WHERE part = 'validation'),
cf AS (SELECT count(*) FILTER (m > 0 AND y = 1)::DOUBLE AS tp, count(*) FILTER (m > 0 AND y = 0)::DOUBLE AS fp,
  count(*) FILTER (m <= 0 AND y = 1)::DOUBLE AS fn, count(*) AS n,
  avg(ln(1 + exp(CASE WHEN y = 1 THEN -m ELSE m END))) AS loss,
  count(*) FILTER ((m > 0) = (y = 1))::DOUBLE AS good FROM sc)
SELECT 1 AS step, round(good / n, 6) AS eval_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS eval_precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS eval_recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS eval_f1, round(loss, 6) AS eval_loss,
  CAST(n AS INT) AS n FROM cf""")
def q_text_first_round(spark, sf):
    """M6: the record of the first round, evaluated from its weights."""
    log, _ = TM.fit_rounds(text_rows(spark, sf), TM.Rounds(max_rounds=1))
    return spark.createDataFrame(log, LOG).select("step", "eval_accuracy", "eval_precision", "eval_recall", "eval_f1",
                                                  "eval_loss", "n")


@query("model_roundtrip", _HELD + "SELECT review_id, true AS same FROM held")
def q_model_roundtrip(spark, sf):
    """Save the fitted pipeline to shared storage, load it, score again: same numbers."""
    train, test = train_test(spark, sf)
    model = MO.fit_trees(train, max_iter=10, max_depth=3, seed=42)
    path = MO.save_model(model, scratch_path(spark, "tree-model"))
    again = MO.load_model(path)
    a = MO.score(model, test).select("review_id", F.col("p_pos").alias("p_before"))
    b = MO.score(again, test).select("review_id", F.col("p_pos").alias("p_after"))
    return a.join(b, "review_id").select("review_id", (F.col("p_before") == F.col("p_after")).alias("same"))


# ---- trained hybrid (M9) --------------------------------------------------------------------------


def labelled_texts(spark, sf):
    """Documents with a ``y`` and their cleaned texts, numbered by ``_at`` and written once. The tree model reads
    their numbers and the text model the texts: only held-out rows need both, so only their texts are joined back."""
    known = FE.label_map(TB.doc_labels(spark, sf)).filter(F.col("y").isNotNull())
    docs = TB.documents_unlabelled(spark, sf).join(known, "review_id")
    rows = FE.with_clean_text(docs).drop("text_").withColumn("y", F.col("y").cast("double"))
    return written(rows.withColumn("_at", F.monotonically_increasing_id()), "reviews-labelled")


def trained_models(spark, sf, max_iter: int = 20):
    """Paths of a tree and a text model fitted on the training rows of ``documents``, and the held-out
    rows with their features and cleaned text."""
    texts = SP.split_hash(labelled_texts(spark, sf))
    numbers = SP.split_hash(MO.prepared(featurized(spark, texts.drop("label"), ["_at", "y"])))
    train, test = F.col("split") == "train", F.col("split") == "test"
    tree = MO.save_model(MO.fit_trees(numbers.filter(train), max_iter=max_iter, max_depth=4, seed=42),
                         scratch_path(spark, "tree-model"))
    text = MO.save_model(MO.fit_text(texts.filter(train)), scratch_path(spark, "text-model"))
    held = texts.filter(test).select("_at", "label", "cleaned_text")
    test = numbers.filter(test).join(held, "_at").drop("_at")
    return tree, text, test


def hybrid_trained(spark, sf):
    """Held-out reviews scored by two saved models and blended."""
    tree, text, test = trained_models(spark, sf)
    return SC.hybrid(MO.score_both(test, MO.load_model(tree), MO.load_model(text)))


@query("score_trained", _HELD + """
SELECT review_id, y, true AS probabilities, true AS blended, true AS thresholds FROM held""")
def q_score_trained(spark, sf):
    """M9 with trained models: for every held-out review both probabilities exist, the verdict is their
    0.3 / 0.7 blend towards AI, and label, confidence and flag follow its thresholds."""
    h = hybrid_trained(spark, sf)
    ai = lambda p: 1.0 - F.col(p)  # noqa: E731  probability of class 0 (AI)
    blend = F.abs(F.col("final_score") - (0.3 * ai("p_tree") + 0.7 * ai("p_text"))) < 1e-9
    label = F.when(F.col("final_score") >= 0.5, "AI").otherwise("Human")
    sure = F.when(F.col("final_score") >= 0.5, F.col("final_score")).otherwise(1.0 - F.col("final_score"))
    follows = (F.col("final_label") == label) & (F.abs(F.col("confidence") - sure) < 1e-9) & (
        F.col("is_uncertain") == (F.col("confidence") < 0.7))
    return h.select("review_id", F.col("y").cast("int").alias("y"),
                    (F.col("p_tree").between(0.0, 1.0) & F.col("p_text").between(0.0, 1.0)).alias("probabilities"),
                    blend.alias("blended"), follows.alias("thresholds"))


def report(spark, sf):
    """Train, score, report: metrics of the trained hybrid on the held-out rows (the entry point)."""
    h = hybrid_trained(spark, sf)
    pred = F.when(F.col("final_label") == "Human", 1).otherwise(0)
    return ME.binary_metrics(h.select(F.col("y").cast("int").alias("y"), pred.alias("pred")))
