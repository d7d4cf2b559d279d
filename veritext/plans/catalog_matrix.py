"""Registered queries, part 3: category dimension, dummies, feature matrix, contract, input
checks, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritext.constants import (CATEGORY_MAPPING, FEATURE_CONTRACT, NUMERIC_FEATURES, TAG_FEATURES,
                                WS_CLASS_RE2)
from veritext.operators import features as FE
from veritext.operators import matrix as MX
from veritext.operators import rejects as RJ
from veritext.operators import split as SP
from veritext.operators.featurize import featurize
from veritext.plans.catalog_lexicon import lexicon_params
from veritext.plans.registry import query
from veritext.plans.sql import _q, with_views
from veritext.plans.sql_lexicon import full_features_prefix
from veritext.schemas import category_dim, contract_df
from veritext.session import scratch_path
from veritext.sources import tables as TB

# The stand-in data has no display names: each review gets one of the dictionary's display names by
# key, plus one name the dictionary lacks, so both lookup outcomes occur.
DISPLAYS = [d for d, _ in CATEGORY_MAPPING] + ["Garden"]


def display_of(key: str = "review_id") -> F.Column:
    return F.element_at(F.array(*[F.lit(d) for d in DISPLAYS]),
                        (F.col(key) % len(DISPLAYS) + 1).cast("int"))


_DISPLAY_SQL = "[" + ", ".join(_q(d) for d in DISPLAYS) + f"][review_id % {len(DISPLAYS)} + 1]"
_DIM_SQL = "dim(display, name) AS (VALUES " + ", ".join(
    f"({_q(d)}, {_q(n)})" for d, n in CATEGORY_MAPPING) + ")"


def featurized(spark, df, keep_extra=()):
    p = lexicon_params(spark)
    return featurize(df, p["lexicon"], p["tag_lexicon"], p["negations"], p["boosters"], p["contrast"],
                     p["suffix_rules"], keep_extra=keep_extra)


def full_features(spark, sf, keep_extra=(), labelled=False):
    """Featurized documents (label-free), then labels and ``y`` attached; ``labelled``: only documents with a
    ``y`` are featurized, for callers that use no others."""
    def features(docs):
        if labelled:
            known = FE.label_map(TB.doc_labels(spark, sf)).filter(F.col("y").isNotNull())
            docs = docs.join(known.select("review_id"), "review_id", "left_semi")
        if not keep_extra:
            return featurized(spark, docs)
        # Texts are written and come back by row number: kept beside the tokens, a text would be copied
        # once for each of its words.
        path = scratch_path(spark, "reviews-featurized")
        rows = FE.with_clean_text(docs).withColumn("_at", F.monotonically_increasing_id())
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        extra = rows.select(F.col("_at").alias("_of"), *keep_extra)
        return featurized(spark, rows, ["_at"]).join(extra, F.col("_at") == F.col("_of")).drop("_at", "_of")

    return TB.reviews_docs(spark, sf, before_labels=features).transform(FE.label_map)


# ---- J2 ------------------------------------------------------------------------------------------

@query("category_lookup", with_views("reviews_docs") + f""", {_DIM_SQL}
SELECT r.review_id, r.display, dim.name,
       CASE WHEN dim.name IS NULL THEN 'category' END AS reject_reason
FROM (SELECT review_id, {_DISPLAY_SQL} AS display FROM reviews_docs) r
LEFT JOIN dim ON r.display = dim.display""")
def q_category_lookup(spark, sf):
    d = TB.documents_unlabelled(spark, sf).select("review_id", display_of().alias("display"))
    return MX.category_lookup(d, category_dim(spark)).select("review_id", "display", "name",
                                                             "reject_reason")


# ---- A13 -----------------------------------------------------------------------------------------

@query("one_hot", with_views("reviews_docs") + """
, cats AS (SELECT list(DISTINCT category ORDER BY category) AS cs FROM reviews_docs)
SELECT review_id, list_transform(cs, lambda c: CASE WHEN c = category THEN 1 ELSE 0 END)::INT[] AS dummies
FROM reviews_docs, cats""")
def q_one_hot(spark, sf):
    d = TB.documents_unlabelled(spark, sf).select("review_id", "category")
    return MX.dummies(d).drop("category")


# ---- J1 / M8 -------------------------------------------------------------------------------------

_NUM_SQL = ", ".join(
    [f"CAST({c} AS DOUBLE)" for c in NUMERIC_FEATURES] + [f'CAST("{t}" AS DOUBLE)' for t in TAG_FEATURES])


@query("feature_matrix", full_features_prefix() + f"""
, cats AS (SELECT list(DISTINCT category ORDER BY category) AS cs FROM reviews_docs)
SELECT review_id, y,
       list_concat([{_NUM_SQL}],
                   list_transform(cats.cs, lambda c: CASE WHEN c = category THEN 1.0 ELSE 0.0 END)::DOUBLE[])
         AS features
FROM full_features, cats""")
def q_feature_matrix(spark, sf):
    return MX.feature_matrix(full_features(spark, sf))


# ---- P3 / P8-P10 / P15 / H21 ------------------------------------------------------------------------

# every 7th review arrives without a rating; defaults come before the features
_RATING = "coalesce(CASE WHEN f.review_id % 7 = 3 THEN NULL ELSE f.rating END, 5.0)"
_DEFAULTED = {"rating": _RATING, "is_extreme_star": f"({_RATING} IN (1.0, 5.0))"}


def _conform_sql() -> str:
    cols = []
    for name in FEATURE_CONTRACT:
        if name.startswith("category_"):
            cols.append(f"CAST(CASE WHEN 'category_' || dim.name || '_5' = {_q(name)} THEN 1.0 ELSE 0.0 END "
                        f"AS DOUBLE) AS \"{name}\"")
        else:
            cols.append(f"coalesce(CAST({_DEFAULTED.get(name, f'f.{chr(34)}{name}{chr(34)}')} AS DOUBLE), 0.0) "
                        f"AS \"{name}\"")
    return ", ".join(cols)


@query("conform_features", full_features_prefix() + f""", {_DIM_SQL}
SELECT f.review_id, {_conform_sql()}
FROM full_features f LEFT JOIN dim ON {_DISPLAY_SQL.replace('review_id', 'f.review_id')} = dim.display""")
def q_conform_features(spark, sf):
    some = TB.documents_unlabelled(spark, sf).withColumn(
        "rating", F.when(F.col("review_id") % 7 != 3, F.col("rating")))
    f = featurized(spark, FE.with_defaults(some)).withColumn("display", display_of())
    named = MX.category_lookup(f, category_dim(spark)).withColumn("category", F.col("name"))
    return MX.conform(named)


# ---- U1 ------------------------------------------------------------------------------------------

@query("schema_drift", with_views("reviews_docs") + ", contract(name) AS (VALUES "
       + ", ".join(f"({_q(n)})" for n in FEATURE_CONTRACT) + "),\n"
       + "present(name) AS (SELECT * FROM (VALUES "
       + ", ".join(f"({_q(n)})" for n in NUMERIC_FEATURES + TAG_FEATURES)
       + ") v UNION ALL SELECT DISTINCT 'category_' || category FROM reviews_docs)\n"
       + """SELECT name, 'missing' AS kind FROM (SELECT name FROM contract EXCEPT ALL SELECT name FROM present)
UNION ALL
SELECT name, 'extra' AS kind FROM (SELECT name FROM present EXCEPT ALL SELECT name FROM contract)""")
def q_schema_drift(spark, sf):
    present = MX.matrix_names(MX.fitted_categories(TB.documents_unlabelled(spark, sf)))
    return MX.schema_drift(contract_df(spark), present)


# ---- P5 / P16 ------------------------------------------------------------------------------------

@query("reject_blank", with_views("reviews_docs", "reviews_chat", "reviews_pages") + """
, u AS (SELECT 'docs' AS view_name, review_id, text_ FROM reviews_docs
        UNION ALL SELECT 'chat', review_id, text_ FROM reviews_chat
        UNION ALL SELECT 'pages', review_id, text_ FROM reviews_pages)
SELECT view_name, review_id,
       CASE WHEN coalesce(regexp_replace(text_, '^[WS]+|[WS]+\\z', '', 'g'), '') = '' THEN 'blank' END
         AS reject_reason
FROM u""".replace("WS", WS_CLASS_RE2))
def q_reject_blank(spark, sf):
    parts = [("docs", TB.documents_unlabelled(spark, sf)), ("chat", TB.reviews_chat(spark, sf)),
             ("pages", TB.reviews_pages(spark, sf))]
    out = None
    for name, df in parts:
        d = RJ.with_reject_reason(df, rating_col=None).select(
            F.lit(name).alias("view_name"), "review_id", "reject_reason")
        out = d if out is None else out.unionByName(d)
    return out


@query("reject_rating", with_views("reviews_docs") + """
SELECT review_id, rating + 1.0 AS rating,
       CASE WHEN NOT (rating + 1.0 BETWEEN 1.0 AND 5.0) THEN 'rating' END AS reject_reason
FROM reviews_docs""")
def q_reject_rating(spark, sf):
    d = TB.documents_unlabelled(spark, sf).withColumn("rating", F.col("rating") + 1.0)
    return RJ.with_reject_reason(d).select("review_id", "rating", "reject_reason")


# ---- M10 / W1-W3 / A3 ---------------------------------------------------------------------------

_H = "md5(CAST(review_id AS VARCHAR) || ':42')"


@query("split_hash", with_views("reviews_docs") + f"""
SELECT review_id, CASE WHEN substr({_H}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split
FROM reviews_docs""")
def q_split_hash(spark, sf):
    return SP.split_hash(TB.documents_unlabelled(spark, sf).select("review_id"))


@query("split_sizes", with_views("reviews_docs") + f"""
SELECT CASE WHEN substr({_H}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split,
       count(*) AS n
FROM reviews_docs WHERE label IN ('OR', 'CG') GROUP BY 1""")
def q_split_sizes(spark, sf):
    lab = FE.label_map(TB.doc_labels(spark, sf)).filter(F.col("y").isNotNull())
    return SP.split_hash(lab).groupBy("split").agg(F.count("*").alias("n"))


@query("split_exact", with_views("reviews_docs") + f"""
SELECT review_id,
       CASE WHEN row_number() OVER (ORDER BY {_H}, review_id) <= ceil(0.2 * count(*) OVER ())
            THEN 'test' ELSE 'train' END AS split
FROM reviews_docs""")
def q_split_exact(spark, sf):
    return SP.split_exact(TB.documents_unlabelled(spark, sf).select("review_id"))


@query("split_stratified", with_views("reviews_docs") + f"""
SELECT review_id, y,
       CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {_H}, review_id)
                 <= ceil(0.2 * count(*) OVER (PARTITION BY y)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT review_id, CASE label WHEN 'OR' THEN 1 WHEN 'CG' THEN 0 END AS y FROM reviews_docs)
WHERE y IS NOT NULL""")
def q_split_stratified(spark, sf):
    lab = FE.label_map(TB.doc_labels(spark, sf)).filter(F.col("y").isNotNull()).select("review_id", "y")
    return SP.split_exact(lab, strata=["y"])


@query("fold_assign", with_views("reviews_docs") + f"""
SELECT review_id, y,
       CAST((row_number() OVER (PARTITION BY y ORDER BY {_H}, review_id) - 1) % 5 AS INT) AS fold
FROM (SELECT review_id, CASE label WHEN 'OR' THEN 1 WHEN 'CG' THEN 0 END AS y FROM reviews_docs)
WHERE y IS NOT NULL""")
def q_fold_assign(spark, sf):
    lab = FE.label_map(TB.doc_labels(spark, sf)).filter(F.col("y").isNotNull()).select("review_id", "y")
    return SP.fold_assign(lab)
