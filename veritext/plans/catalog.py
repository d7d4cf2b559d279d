"""Registered queries, part 1: scans, clean-up, row features and the profile stage.

Every query reads the provided tables through the stand-in views and runs over whole tables.
Floating outputs are rounded (6 places) on both sides so engines agree on the last bits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veritext.operators import features as FE
from veritext.operators import profile as PR
from veritext.plans.registry import query
from veritext.plans.sql import char_length_sql, clean_sql, with_views, word_count_sql
from veritext.schemas import REVIEW_COLUMNS
from veritext.sources import tables as TB


def features_docs(spark, sf):
    """Text features computed on the label-free documents, labels attached afterwards."""
    return TB.reviews_docs(spark, sf, before_labels=FE.text_features)


# ---- flagship: per-label length profile ---------------------------------------------------------

@query("label_profile", with_views("features_docs") + """
SELECT label, count(*) AS n,
       round(avg(char_length), 6) AS avg_char_length,
       round(avg(word_count), 6) AS avg_word_count,
       round(avg(punctuation_ct), 6) AS avg_punctuation_ct,
       round(avg(CASE WHEN is_extreme_star THEN 1.0 ELSE 0.0 END), 6) AS extreme_star_share
FROM features_docs GROUP BY label""")
def q_label_profile(spark, sf):
    f = features_docs(spark, sf)
    return f.groupBy("label").agg(
        F.count("*").alias("n"),
        F.round(F.avg("char_length"), 6).alias("avg_char_length"),
        F.round(F.avg("word_count"), 6).alias("avg_word_count"),
        F.round(F.avg("punctuation_ct"), 6).alias("avg_punctuation_ct"),
        F.round(F.avg(F.col("is_extreme_star").cast("double")), 6).alias("extreme_star_share"),
    )


# ---- S1: scan ------------------------------------------------------------------------------------

@query("scan_reviews", with_views("reviews_docs") + "SELECT * FROM reviews_docs")
def q_scan_reviews(spark, sf):
    return TB.reviews_docs(spark, sf)


# ---- H1-H4 ---------------------------------------------------------------------------------------

@query("clean_text", with_views("reviews_docs", "reviews_chat", "reviews_pages") + f"""
SELECT 'docs' AS view_name, review_id, {clean_sql('text_')} AS cleaned_text FROM reviews_docs
UNION ALL
SELECT 'chat' AS view_name, review_id, {clean_sql('text_')} AS cleaned_text FROM reviews_chat
UNION ALL
SELECT 'pages' AS view_name, review_id, {clean_sql('text_')} AS cleaned_text FROM reviews_pages""")
def q_clean_text(spark, sf):
    parts = [("docs", TB.documents_unlabelled(spark, sf)), ("chat", TB.reviews_chat(spark, sf)),
             ("pages", TB.reviews_pages(spark, sf))]
    out = None
    for name, df in parts:
        d = FE.with_clean_text(df).select(F.lit(name).alias("view_name"), "review_id", "cleaned_text")
        out = d if out is None else out.unionByName(d)
    return out


# ---- P2 / P6 / H5-H7 / F1 ------------------------------------------------------------------------

_TF_COLS = ["review_id", "label", "rating", "char_length", "word_count", "punctuation_ct",
            "is_extreme_star"]


@query("text_features", with_views("features_docs") + f"SELECT {', '.join(_TF_COLS)} FROM features_docs")
def q_text_features(spark, sf):
    return features_docs(spark, sf).select(*_TF_COLS)


@query("raw_lengths", with_views("reviews_docs") + f"""
SELECT review_id, label, {char_length_sql("coalesce(text_, '')")} AS char_length,
       {word_count_sql("coalesce(text_, '')")} AS word_count FROM reviews_docs""")
def q_raw_lengths(spark, sf):
    return TB.reviews_docs(spark, sf, before_labels=FE.raw_lengths).select(
        "review_id", "label", "char_length", "word_count")


@query("numeric_block", with_views("features_docs") + """
SELECT review_id, rating, char_length, word_count, punctuation_ct, is_extreme_star FROM features_docs""")
def q_numeric_block(spark, sf):
    return FE.numeric_block(TB.documents_unlabelled(spark, sf).transform(FE.text_features))


@query("drop_empty", with_views("features_docs") + """
SELECT review_id, cleaned_text, label FROM features_docs
WHERE nullif(cleaned_text, '') IS NOT NULL AND label IS NOT NULL""")
def q_drop_empty(spark, sf):
    return FE.drop_empty(TB.reviews_docs(spark, sf, before_labels=FE.with_clean_text))


@query("label_map", with_views("reviews_docs") + """
SELECT review_id, label, CASE label WHEN 'OR' THEN 1 WHEN 'CG' THEN 0 END AS y FROM reviews_docs""")
def q_label_map(spark, sf):
    return FE.label_map(TB.reviews_docs(spark, sf)).select("review_id", "label", "y")


# ---- profile ---------------------------------------------------------------------------------------

@query("head", with_views("reviews_docs") + "SELECT * FROM reviews_docs ORDER BY review_id LIMIT 5")
def q_head(spark, sf):
    first = PR.head(TB.documents_unlabelled(spark, sf))  # five rows meet the labels
    return PR.head(TB.attach_labels(spark, sf, first).select(*REVIEW_COLUMNS))


@query("null_counts", with_views("reviews_docs") + """
SELECT column_name, null_count FROM (
  SELECT 'review_id' AS column_name, CAST(count_if(review_id IS NULL) AS BIGINT) AS null_count FROM reviews_docs
  UNION ALL SELECT 'category', CAST(count_if(category IS NULL) AS BIGINT) FROM reviews_docs
  UNION ALL SELECT 'rating', CAST(count_if(rating IS NULL) AS BIGINT) FROM reviews_docs
  UNION ALL SELECT 'label', CAST(count_if(label IS NULL) AS BIGINT) FROM reviews_docs
  UNION ALL SELECT 'text_', CAST(count_if(text_ IS NULL) AS BIGINT) FROM reviews_docs)""")
def q_null_counts(spark, sf):
    flags = TB.reviews_docs(spark, sf, before_labels=lambda d: d.withColumn(  # text reduced to a flag
        "text_", F.when(F.col("text_").isNotNull(), F.lit(True))))
    return PR.null_counts(flags.select(*REVIEW_COLUMNS))


@query("label_counts", with_views("reviews_docs") + """
SELECT CASE label WHEN 'OR' THEN 1 WHEN 'CG' THEN 0 END AS y, count(*) AS n FROM reviews_docs
WHERE label IN ('OR', 'CG') GROUP BY 1 ORDER BY n DESC, y""")
def q_label_counts(spark, sf):
    return PR.value_counts(FE.label_map(TB.doc_labels(spark, sf)), "y")


@query("length_box_stats", with_views("reviews_docs") + f"""
, lens AS (SELECT label, CAST({char_length_sql("coalesce(text_, '')")} AS DOUBLE) AS v
           FROM reviews_docs WHERE label IS NOT NULL),
q AS (SELECT label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM lens GROUP BY label),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
             q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
       min(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END) AS whisker_low,
       max(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END) AS whisker_high,
       CAST(count_if(NOT (v BETWEEN lower_fence AND upper_fence)) AS BIGINT) AS n_outliers,
       CAST(count(*) AS BIGINT) AS n
FROM f JOIN lens USING (label)
GROUP BY f.label, q1, median, q3, iqr, lower_fence, upper_fence""")
def q_length_box_stats(spark, sf):
    lens = TB.reviews_docs(spark, sf, before_labels=FE.raw_lengths)
    b = PR.box_stats(lens, "char_length", "label")
    # quartiles interpolate in floating point; 6 places make engines agree on the last bits
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "iqr", "lower_fence",
                                                      "upper_fence")})
