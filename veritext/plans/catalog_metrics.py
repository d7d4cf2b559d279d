"""Registered queries, part 4: metrics and verdicts over the closed-form score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritext.functions import scores as S
from veritext.operators import features as FE
from veritext.operators import metrics as ME
from veritext.operators import scoring as SC
from veritext.operators import split as SP
from veritext.operators import usermetrics as UM
from veritext.plans.registry import query
from veritext.plans.sql import with_views
from veritext.sources import tables as TB


def score_docs(spark, sf):
    """Row features on label-free documents, labels attached, closed-form scores."""
    return SC.score_table(TB.reviews_docs(spark, sf, before_labels=FE.text_features))


def with_pred(df, p="p_tree"):
    return df.withColumn("pred", S.argmax(S.pair_of(p)))


_ST = with_views("score_table")
_PRED = "CASE WHEN p_tree > 1.0 - p_tree THEN 1 ELSE 0 END"


@query("confusion", _ST + f"""
, g(y, pred) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
c AS (SELECT y, {_PRED} AS pred FROM score_table WHERE y IS NOT NULL)
SELECT g.y, g.pred, CAST(count(c.y) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.y = c.y AND g.pred = c.pred GROUP BY g.y, g.pred""")
def q_confusion(spark, sf):
    return ME.confusion(with_pred(score_docs(spark, sf)))


def _counts_sql():
    return f"""
, c AS (SELECT count_if(y = 1 AND pred = 1) AS tp, count_if(y = 0 AND pred = 1) AS fp,
               count_if(y = 1 AND pred = 0) AS fn, count_if(y = 0 AND pred = 0) AS tn
        FROM (SELECT y, {_PRED} AS pred FROM score_table WHERE y IS NOT NULL))"""


def _div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


@query("binary_metrics", _ST + _counts_sql() + f"""
, m AS (SELECT *, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r FROM c)
SELECT round({_div('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round(p, 6) AS precision,
       round(r, 6) AS recall, round({_div('2 * p * r', 'p + r')}, 6) AS f1,
       CAST(tp + fp + fn + tn AS BIGINT) AS n
FROM m""")
def q_binary_metrics(spark, sf):
    return ME.binary_metrics(with_pred(score_docs(spark, sf)))


@query("class_report", _ST + _counts_sql() + f"""
, k AS (SELECT *, {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1,
               {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0,
               CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0 FROM c),
k2 AS (SELECT *, {_div('2 * p1 * r1', 'p1 + r1')} AS f1_1, {_div('2 * p0 * r0', 'p0 + r0')} AS f1_0 FROM k)
SELECT class_label, metric, round(value, 6) AS value FROM (
  SELECT '0' AS class_label, 'precision' AS metric, p0 AS value FROM k2
  UNION ALL SELECT '0', 'recall', r0 FROM k2
  UNION ALL SELECT '0', 'f1', f1_0 FROM k2
  UNION ALL SELECT '0', 'support', s0 FROM k2
  UNION ALL SELECT '1', 'precision', p1 FROM k2
  UNION ALL SELECT '1', 'recall', r1 FROM k2
  UNION ALL SELECT '1', 'f1', f1_1 FROM k2
  UNION ALL SELECT '1', 'support', s1 FROM k2
  UNION ALL SELECT 'macro avg', 'precision', (p0 + p1) / 2.0 FROM k2
  UNION ALL SELECT 'weighted avg', 'precision', {_div('p0 * s0 + p1 * s1', 's0 + s1')} FROM k2
  UNION ALL SELECT 'macro avg', 'recall', (r0 + r1) / 2.0 FROM k2
  UNION ALL SELECT 'weighted avg', 'recall', {_div('r0 * s0 + r1 * s1', 's0 + s1')} FROM k2
  UNION ALL SELECT 'macro avg', 'f1', (f1_0 + f1_1) / 2.0 FROM k2
  UNION ALL SELECT 'weighted avg', 'f1', {_div('f1_0 * s0 + f1_1 * s1', 's0 + s1')} FROM k2
  UNION ALL SELECT 'macro avg', 'support', CAST(tp + fp + fn + tn AS DOUBLE) FROM k2
  UNION ALL SELECT 'weighted avg', 'support', CAST(tp + fp + fn + tn AS DOUBLE) FROM k2
  UNION ALL SELECT 'accuracy', 'accuracy', {_div('tp + tn', 'tp + fp + fn + tn')} FROM k2)""")
def q_class_report(spark, sf):
    return ME.class_report(with_pred(score_docs(spark, sf)))


def auc_sql(src: str, score: str, group: list[str] = ()) -> str:
    """Tie-aware AUC in plain SQL: group by score, prefix sum of lower negatives."""
    g = ", ".join(group)
    gsel = g + ", " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    return f"""SELECT {gsel}round(sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM (SELECT {gsel}{score} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM {src}
            WHERE y IS NOT NULL AND {score} IS NOT NULL GROUP BY {gsel}{score}))
{"GROUP BY " + g if g else ""}"""


@query("roc_auc", _ST + auc_sql("score_table", "p_tree"))
def q_roc_auc(spark, sf):
    return ME.roc_auc(score_docs(spark, sf), "p_tree")


@query("log_loss", _ST + """
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, CAST(count(*) AS BIGINT) AS n
FROM (SELECT y, least(greatest(p_text, 1e-15), 1 - 1e-15) AS p FROM score_table WHERE y IS NOT NULL)""")
def q_log_loss(spark, sf):
    return ME.log_loss(score_docs(spark, sf), "p_text")


_HASH_TEST = "substr(md5(CAST(review_id AS VARCHAR) || ':42'), 1, 8) < '33333333'"


@query("compare_models", _ST + f"""
, t AS (SELECT * FROM score_table WHERE {_HASH_TEST}),
longf AS (SELECT 'tree' AS model, y, p_tree AS p FROM t UNION ALL SELECT 'text', y, p_text FROM t)
""" + auc_sql("longf", "p", ["model"]))
def q_compare_models(spark, sf):
    test = SP.split_hash(score_docs(spark, sf)).filter(F.col("split") == "test")
    return ME.compare_models(test, {"tree": "p_tree", "text": "p_text"})


# ---- verdicts ------------------------------------------------------------------------------------

@query("softmax", _ST + """
SELECT review_id, list_transform(pr, lambda x: round(x, 6)) AS probs
FROM (SELECT review_id, list_transform(e, lambda x: x / list_sum(e)) AS pr
      FROM (SELECT review_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e
            FROM (SELECT review_id, [0.0::DOUBLE, z_text] AS l FROM score_table)))""")
def q_softmax(spark, sf):
    d = score_docs(spark, sf)
    return d.select("review_id", F.transform(S.softmax(F.array(F.lit(0.0), F.col("z_text"))),
                                            lambda x: F.round(x, 6)).alias("probs"))


@query("argmax_class", _ST + """
SELECT review_id, CASE WHEN p_text > 1.0 - p_text THEN 1 ELSE 0 END AS pred,
       greatest(1.0 - p_text, p_text) AS confidence, p_text AS p_pos
FROM score_table""")
def q_argmax_class(spark, sf):
    d = score_docs(spark, sf).withColumn("probs", S.pair_of("p_text"))
    cls = S.argmax("probs")
    return d.select("review_id", cls.alias("pred"), F.element_at("probs", cls + 1).alias("confidence"),
                    F.element_at("probs", 2).alias("p_pos"))


_HYB = """
, v AS (SELECT review_id,
               CASE WHEN p_tree > 1.0 - p_tree THEN 'Human' ELSE 'AI' END AS label_tree,
               greatest(1.0 - p_tree, p_tree) AS confidence_tree,
               CASE WHEN p_text > 1.0 - p_text THEN 'Human' ELSE 'AI' END AS label_text,
               greatest(1.0 - p_text, p_text) AS confidence_text FROM score_table),
b AS (SELECT *, 0.3 * CASE WHEN label_tree = 'AI' THEN confidence_tree ELSE 1.0 - confidence_tree END
              + 0.7 * CASE WHEN label_text = 'AI' THEN confidence_text ELSE 1.0 - confidence_text END
              AS final_score FROM v),
h AS (SELECT *, CASE WHEN final_score >= 0.5 THEN 'AI' ELSE 'Human' END AS final_label,
             CASE WHEN final_score >= 0.5 THEN final_score ELSE 1.0 - final_score END AS confidence FROM b)
"""


def hybrid_docs(spark, sf):
    return SC.hybrid(score_docs(spark, sf))


# final_score and confidence blend 6-place scores with 1-place weights: exactly 7 places, so they
# are rounded to 7 (rounding to 6 would hit decimal ties that engines break differently).
@query("score_hybrid", _ST + _HYB + """
SELECT review_id, label_tree, round(confidence_tree, 6) AS confidence_tree, label_text,
       round(confidence_text, 6) AS confidence_text, round(final_score, 7) AS final_score,
       final_label, round(confidence, 7) AS confidence, confidence < 0.7 AS is_uncertain FROM h""")
def q_score_hybrid(spark, sf):
    h = hybrid_docs(spark, sf)
    return h.select("review_id", "label_tree", F.round("confidence_tree", 6).alias("confidence_tree"),
                    "label_text", F.round("confidence_text", 6).alias("confidence_text"),
                    F.round("final_score", 7).alias("final_score"), "final_label",
                    F.round("confidence", 7).alias("confidence"), "is_uncertain")


@query("join_scores", _ST + _HYB + """
SELECT review_id, label_tree, label_text, round(final_score, 7) AS final_score, final_label FROM h""")
def q_join_scores(spark, sf):
    """The two models' scores as two tables, joined by review and blended."""
    scores = score_docs(spark, sf)
    tree = scores.select("review_id", "p_tree")
    text = scores.select("review_id", "p_text")
    h = SC.hybrid(SC.join_model_scores(tree, text))
    return h.select("review_id", "label_tree", "label_text", F.round("final_score", 7).alias("final_score"), "final_label")


@query("custom_metric", _ST + f"""
, f AS (SELECT y, p_tree AS p, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'),
   review_id) - 1) % 5 AS INT) AS fold FROM score_table WHERE y IS NOT NULL),
c AS (SELECT fold, avg((p - y) * (p - y)) AS brier, (count(*) FILTER (p > 0.5 AND y = 1))::DOUBLE AS tp,
   (count(*) FILTER (p > 0.5 AND y = 0))::DOUBLE AS fp, (count(*) FILTER (p <= 0.5 AND y = 1))::DOUBLE AS fn,
   (count(*) FILTER (p <= 0.5 AND y = 0))::DOUBLE AS tn FROM f GROUP BY 1)
SELECT fold, 'brier' AS metric, round(brier, 6) AS value FROM c UNION ALL
SELECT fold, 'mcc', round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0), 6)
FROM c""")
def q_custom_metric(spark, sf):
    """a metric of the user's own, per fold."""
    rows = SP.fold_assign(score_docs(spark, sf).filter(F.col("y").isNotNull()).select("review_id", "y", "p_tree"))
    return UM.evaluate(rows, UM.BrierAndCorrelation(), "fold", p="p_tree").select(
        "fold", "metric", F.round("value", 6).alias("value"))


@query("confidence_pct", _ST + _HYB + """
SELECT review_id, printf('%.2f%%', confidence * 100.0) AS confidence_pct FROM h""")
def q_confidence_pct(spark, sf):
    h = hybrid_docs(spark, sf)
    return h.select("review_id", S.percent_text("confidence").alias("confidence_pct"))
