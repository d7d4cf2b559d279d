"""Registered queries, part 5: file round trips, run log, grid summary and importance tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.constants import IMPORTANCE_THRESHOLD, NUMERIC_FEATURES, TAG_FEATURES
from veritext.functions import scores as S
from veritext.operators import features as FE
from veritext.operators import matrix as MX
from veritext.operators import metrics as ME
from veritext.operators import runs as RU
from veritext.operators import split as SP
from veritext.plans.catalog_matrix import full_features
from veritext.plans.catalog_metrics import auc_sql, score_docs
from veritext.plans.registry import query
from veritext.plans.sql import _q, with_views
from veritext.plans.sql_lexicon import full_features_prefix
from veritext.schemas import CONTRACT, RUN_LOG, RUN_METRICS
from veritext.session import scratch_path
from veritext.sources import files as FL
from veritext.sources import infer as IN
from veritext.sources import tables as TB

_H = "md5(CAST(review_id AS VARCHAR) || ':42')"
_HASH_TEST = f"substr({_H}, 1, 8) < '33333333'"
_FOLDS = f"""
, folds AS (SELECT st.*, CAST((row_number() OVER (PARTITION BY y ORDER BY {_H}, review_id) - 1) % 5 AS INT)
                     AS fold
            FROM score_table st WHERE y IS NOT NULL)"""


# ---- S3 ------------------------------------------------------------------------------------------

_CSV_COLS = ["review_id", "category", "rating", "label", "cleaned_text", "char_length", "word_count",
             "punctuation_ct", "is_extreme_star"]
PROCESSED = T.StructType([
    T.StructField("review_id", T.LongType()), T.StructField("category", T.StringType()),
    T.StructField("rating", T.DoubleType()), T.StructField("label", T.StringType()),
    T.StructField("cleaned_text", T.StringType()), T.StructField("char_length", T.LongType()),
    T.StructField("word_count", T.LongType()), T.StructField("punctuation_ct", T.LongType()),
    T.StructField("is_extreme_star", T.BooleanType()),
])


@query("csv_roundtrip", with_views("features_docs") + f"SELECT {', '.join(_CSV_COLS)} FROM features_docs")
def q_csv_roundtrip(spark, sf):
    processed = TB.reviews_docs(spark, sf, before_labels=FE.text_features).select(*_CSV_COLS)
    path = FL.write_csv(processed, scratch_path(spark, "processed-csv"))
    return FL.read_csv(spark, path, PROCESSED)


@query("sink_by_category", with_views("reviews_docs") + """
SELECT review_id, category, CASE WHEN category = 'src3' THEN rating + 10 ELSE rating END AS rating FROM reviews_docs""")
def q_sink_by_category(spark, sf):
    """S3: the default sink, one folder per category; a re-run replaces one category and no other."""
    docs = TB.documents_unlabelled(spark, sf).select("review_id", "category", "rating")
    path = FL.write_reviews(docs, scratch_path(spark, "reviews-by-category"))
    one = docs.filter(F.col("category") == "src3").withColumn("rating", F.col("rating") + 10)
    FL.replace_categories(one, path)
    return spark.read.schema(docs.schema).parquet(path).select("review_id", "category", "rating")


# A broken file: every 17th record has a field too many, every 19th lacks one.
INFERRED = ["id", "length", "share", "long_text", "note", "nothing"]
_BROKEN = {"too_many": 17, "too_few": 19}
_RECORD_SQL = """
, rec AS (SELECT review_id AS id, review_id % 17 = 0 AS too_many, review_id % 19 = 0 AS too_few,
   review_id::VARCHAR AS a, CASE WHEN review_id % 5 = 0 THEN '' ELSE length(text_)::VARCHAR END AS b,
   (review_id % 8)::VARCHAR || '.5' AS c, CASE WHEN length(text_) > 500 THEN 'true' ELSE 'false' END AS d,
   CASE WHEN review_id % 2 = 0 THEN review_id::VARCHAR ELSE coalesce(category, 'none') END AS e FROM reviews_docs),
line AS (SELECT *, a || ',' || b || ',' || c || ',' || d || CASE WHEN too_few THEN '' ELSE ',' || e END ||
   CASE WHEN too_many THEN ',' || ',more' ELSE ',' END AS record FROM rec),
"""


@query("csv_inferred", with_views("reviews_docs") + _RECORD_SQL + """
good AS (SELECT * FROM line WHERE too_many = too_few)
SELECT 'reject' AS kind, record AS name, 'malformed' AS value FROM line WHERE too_many <> too_few UNION ALL
SELECT 'type', name, CASE WHEN n = 0 THEN 'string' WHEN longs = n THEN 'bigint' WHEN doubles = n THEN 'double'
   WHEN booleans = n THEN 'boolean' ELSE 'string' END FROM
 (SELECT name, count(*) FILTER (v <> '') AS n, count(*) FILTER (v <> '' AND try_cast(v AS BIGINT) IS NOT NULL AND v NOT LIKE '%.%') AS longs,
   count(*) FILTER (v <> '' AND try_cast(v AS DOUBLE) IS NOT NULL) AS doubles, count(*) FILTER (v IN ('true', 'false')) AS booleans
  FROM (SELECT 'id' AS name, a AS v FROM good UNION ALL SELECT 'length', b FROM good UNION ALL SELECT 'share', c FROM good
   UNION ALL SELECT 'long_text', d FROM good UNION ALL SELECT 'note', CASE WHEN too_few THEN '' ELSE e END FROM good
   UNION ALL SELECT 'nothing', CASE WHEN too_few THEN 'more' ELSE '' END FROM good) GROUP BY 1)
UNION ALL SELECT 'rows', 'typed', count(*)::VARCHAR FROM good""")
def q_csv_inferred(spark, sf):
    """Types from all rows of a file of unknown types, malformed records apart."""
    docs = TB.documents_unlabelled(spark, sf)
    i = F.col("review_id")
    few, many = i % _BROKEN["too_few"] == 0, i % _BROKEN["too_many"] == 0
    note = F.when(i % 2 == 0, i.cast("string")).otherwise(F.coalesce("category", F.lit("none")))
    record = F.concat(
        i.cast("string"), F.lit(","), F.when(i % 5 == 0, "").otherwise(F.length("text_").cast("string")), F.lit(","),
        (i % 8).cast("string"), F.lit(".5,"), F.when(F.length("text_") > 500, "true").otherwise("false"),
        F.when(few, "").otherwise(F.concat(F.lit(","), note)), F.when(many, ",,more").otherwise(","))
    path = scratch_path(spark, "unknown-csv")
    docs.filter(F.col("text_").isNotNull()).select(record.alias("value")).write.text(path)
    typed, rejects = IN.read_csv_inferred(spark, path, INFERRED, header=False)
    types = spark.createDataFrame([("type", f.name, f.dataType.simpleString()) for f in typed.schema],
                                  "kind string, name string, value string")
    n = typed.agg(F.lit("rows").alias("kind"), F.lit("typed").alias("name"), F.count(F.lit(1)).cast("string").alias("value"))
    bad = rejects.select(F.lit("reject").alias("kind"), F.col("record").alias("name"), F.col("reject_reason").alias("value"))
    return types.unionByName(bad).unionByName(n)


# latin-1 read of UTF-8 bytes: every byte becomes the code point of the same value
_HEXV = "(instr('0123456789ABCDEF', substr(h, {i}, 1)) - 1)"
_LATIN1_SQL = (with_views("reviews_chat") + """
, hx AS (SELECT review_id, text_, upper(to_hex(encode(text_))) AS h FROM reviews_chat)
SELECT review_id,
       CASE WHEN text_ IS NULL THEN NULL ELSE
         array_to_string(list_transform(range(0, length(h) // 2),
                                        lambda i: chr(CAST(""" + _HEXV.format(i="2 * i + 1") + " * 16 + "
       + _HEXV.format(i="2 * i + 2") + """ AS INTEGER))), '') END AS text_,
       CAST(octet_length(encode(text_)) AS BIGINT) AS n_chars_latin1
FROM hx""")


@query("csv_charset", _LATIN1_SQL)
def q_csv_charset(spark, sf):
    """Text written as UTF-8 and read back as latin-1, as the reference's readers do."""
    chat = TB.reviews_chat(spark, sf).select("review_id", "text_")
    path = FL.write_csv(chat, scratch_path(spark, "chat-csv"))
    schema = T.StructType([T.StructField("review_id", T.LongType()), T.StructField("text_", T.StringType())])
    back = FL.read_csv(spark, path, schema, encoding="ISO-8859-1")
    return back.select("review_id", "text_", F.length("text_").cast("bigint").alias("n_chars_latin1"))


# ---- S4 ------------------------------------------------------------------------------------------

_BASE_NAMES = NUMERIC_FEATURES + TAG_FEATURES


@query("contract_roundtrip", with_views("reviews_docs") + """
SELECT CAST(position AS INT) AS position, name FROM (
  SELECT * FROM (VALUES """ + ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(_BASE_NAMES)) + f""") v(position, name)
  UNION ALL
  SELECT {len(_BASE_NAMES) - 1} + row_number() OVER (ORDER BY category), 'category_' || category
  FROM (SELECT DISTINCT category FROM reviews_docs WHERE category IS NOT NULL))""")
def q_contract_roundtrip(spark, sf):
    contract = MX.matrix_names(MX.fitted_categories(TB.documents_unlabelled(spark, sf)))
    path = FL.write_json(contract, scratch_path(spark, "feature-contract"))
    return FL.read_json(spark, path, CONTRACT).orderBy("position")


# ---- S5 ------------------------------------------------------------------------------------------

@query("run_metrics", with_views("score_table") + f"""
, t AS (SELECT * FROM score_table WHERE {_HASH_TEST}),
a AS ({auc_sql('t', 'p_tree')})
SELECT 'closed_form_tree' AS run_id, a.auc AS test_auc_score,
       CAST({len(_BASE_NAMES)} + (SELECT count(DISTINCT category) FROM reviews_docs) AS INT) AS num_features,
       '{{"OR":1,"CG":0}}' AS label_mapping,
       (SELECT CAST(count(*) AS BIGINT) FROM score_table WHERE y IS NOT NULL AND NOT {_HASH_TEST})
         AS training_samples,
       (SELECT CAST(count(*) AS BIGINT) FROM t WHERE y IS NOT NULL) AS test_samples
FROM a""")
def q_run_metrics(spark, sf):
    scored = SP.split_hash(score_docs(spark, sf)).filter(F.col("y").isNotNull())
    auc = ME.roc_auc(scored.filter(F.col("split") == "test"), "p_tree")
    # three one-row results become one row by a union and a keyed aggregate (no join needed)
    parts = (auc.select(F.lit("auc").alias("k"), F.col("auc").cast("double").alias("v"))
             .unionByName(scored.groupBy("split").agg(F.count("*").cast("double").alias("v"))
                          .select(F.col("split").alias("k"), "v"))
             .unionByName(TB.documents_unlabelled(spark, sf)
                          .agg(F.count_distinct("category").cast("double").alias("v"))
                          .select(F.lit("categories").alias("k"), "v")))
    one = parts.groupBy().agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
                                for k in ("auc", "train", "test", "categories")])
    row = one.select(F.lit("closed_form_tree").alias("run_id"), F.col("auc").alias("test_auc_score"),
                     (F.col("categories") + len(_BASE_NAMES)).cast("int").alias("num_features"),
                     F.create_map(F.lit("OR"), F.lit(1), F.lit("CG"), F.lit(0)).alias("label_mapping"),
                     F.coalesce(F.col("train"), F.lit(0)).cast("bigint").alias("training_samples"),
                     F.coalesce(F.col("test"), F.lit(0)).cast("bigint").alias("test_samples"))
    path = FL.write_json(row, scratch_path(spark, "run-metrics"), mode="append")
    back = FL.read_json(spark, path, RUN_METRICS)
    return back.withColumn("label_mapping", F.to_json("label_mapping"))


# ---- S11 / A15 / W6 --------------------------------------------------------------------------------

_REC_SQL = f"""
, rc AS (SELECT fold, count_if(y = 1 AND pr = 1) AS tp, count_if(y = 0 AND pr = 1) AS fp,
                count_if(y = 1 AND pr = 0) AS fn, count_if(y = 0 AND pr = 0) AS tn,
                avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS eval_loss, count(*) AS n
         FROM (SELECT fold, y, CASE WHEN p_text > 1.0 - p_text THEN 1 ELSE 0 END AS pr,
                      least(greatest(p_text, 1e-15), 1 - 1e-15) AS p FROM folds)
         GROUP BY fold),
rm AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS pp,
              coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS rr FROM rc),
rec AS (SELECT 'closed_form_text' AS run_id, CAST(fold + 1 AS DOUBLE) AS epoch,
               CAST(sum(n) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS step,
               CAST(NULL AS DOUBLE) AS loss, CAST(NULL AS DOUBLE) AS learning_rate,
               CAST(NULL AS DOUBLE) AS grad_norm,
               round(CAST(tp + tn AS DOUBLE) / n, 6) AS eval_accuracy,
               round(coalesce(2 * pp * rr / nullif(pp + rr, 0), 0.0), 6) AS eval_f1,
               round(eval_loss, 6) AS eval_loss, round(pp, 6) AS eval_precision, round(rr, 6) AS eval_recall,
               CAST(NULL AS DOUBLE) AS eval_runtime, CAST(NULL AS DOUBLE) AS eval_samples_per_second,
               CAST(NULL AS DOUBLE) AS eval_steps_per_second
        FROM rm)
"""


def run_log_records(spark, sf):
    """Evaluation log of the closed-form text scorer, one record per fold, through a JSON file."""
    scored = SP.fold_assign(score_docs(spark, sf).filter(F.col("y").isNotNull()))
    doc = RU.log_document(RU.eval_records(scored, "p_text"), "closed_form_text")
    path = FL.write_json(doc, scratch_path(spark, "trainer-state"))
    return RU.explode_log(FL.read_json(spark, path, RUN_LOG))


@query("run_log", with_views("score_table") + _FOLDS + _REC_SQL + """
SELECT * FROM rec ORDER BY eval_f1 DESC, step LIMIT 1""")
def q_run_log(spark, sf):
    return RU.best_record(run_log_records(spark, sf))


@query("early_stop", with_views("score_table") + _FOLDS + _REC_SQL + """
, e AS (SELECT *, row_number() OVER (ORDER BY step) AS rn,
               max(eval_f1) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_best,
               max(eval_f1) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best
        FROM rec),
e2 AS (SELECT *, (prev_best IS NULL OR eval_f1 > prev_best) AS improved FROM e),
e3 AS (SELECT *, CAST(rn - max(CASE WHEN improved THEN rn END)
                   OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT)
                 AS evals_without_gain FROM e2)
SELECT run_id, epoch, step, eval_f1, running_best, improved, evals_without_gain,
       min(CASE WHEN evals_without_gain >= 2 THEN step END) OVER () AS stop_step,
       (row_number() OVER (ORDER BY step DESC) <= 2
        OR step = min(CASE WHEN eval_f1 = (SELECT max(eval_f1) FROM rec) THEN step END) OVER ())
         AS keep_checkpoint
FROM e3""")
def q_early_stop(spark, sf):
    return RU.early_stop(run_log_records(spark, sf))


# ---- A10 / T3 ------------------------------------------------------------------------------------

GRID = [(1, 1.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0), (4, 2.0, 1.0), (5, 1.0, 2.0), (6, 1.0, -1.0)]


def _grid_score(w_tree, w_text):
    return F.round(S.sigmoid(w_tree * F.col("z_tree") + w_text * F.col("z_text")), 6)


_GRID_SQL = f"""
, params(param_id, w_tree, w_text) AS (VALUES """ + ", ".join(
    f"({p}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for p, a, b in GRID) + """),
sc AS (SELECT p.param_id, f.fold, f.y,
              round(1.0 / (1.0 + exp(-(w_tree * z_tree + w_text * z_text))), 6) AS s
       FROM folds f, params p),
roles AS (SELECT param_id, fold AS fold_id, 'test' AS role, y, s FROM sc
          UNION ALL
          SELECT param_id, r.fold_id, 'train' AS role, y, s
          FROM sc, (VALUES (0), (1), (2), (3), (4)) r(fold_id) WHERE r.fold_id <> sc.fold),
ps AS (SELECT param_id, fold_id, role, s, sum(y) AS pos, sum(1 - y) AS neg FROM roles
       GROUP BY param_id, fold_id, role, s),
au AS (SELECT param_id, fold_id, role, round(sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc
       FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY param_id, fold_id, role ORDER BY s
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM ps)
       GROUP BY param_id, fold_id, role),
fs AS (SELECT param_id, fold_id AS fold, max(CASE WHEN role = 'test' THEN auc END) AS test_auc,
              max(CASE WHEN role = 'train' THEN auc END) AS train_auc
       FROM au GROUP BY param_id, fold_id)
"""


@query("grid_summary", with_views("score_table") + _FOLDS + _GRID_SQL + """
, g AS (SELECT param_id, round(avg(test_auc), 6) AS mean_test_auc, round(stddev_pop(test_auc), 6) AS std_test_auc,
               round(avg(train_auc), 6) AS mean_train_auc, round(stddev_pop(train_auc), 6) AS std_train_auc
        FROM fs GROUP BY param_id)
SELECT *, CAST(row_number() OVER (ORDER BY mean_test_auc DESC, param_id) AS INT) AS rank_test,
       row_number() OVER (ORDER BY mean_test_auc DESC, param_id) = 1 AS is_best
FROM g""")
def q_grid_summary(spark, sf):
    scored = SP.fold_assign(score_docs(spark, sf).filter(F.col("y").isNotNull()))
    fs = RU.fold_scores(scored, GRID, ["w_tree", "w_text"], _grid_score)
    return RU.grid_summary(fs)


# ---- A11 / T2 / P12 ------------------------------------------------------------------------------

_GIVEN = ["src0", "src1", "src2", "src3", "src4"]  # the category columns of this contract
_SLOTS = _BASE_NAMES + [f"category_{c}" for c in _GIVEN]


def _imp_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {_q(f)} AS feature, coalesce(abs(corr(CAST(\"{f}\" AS DOUBLE), CAST(y AS DOUBLE))), 0.0) AS raw "
        f"FROM matrix WHERE y IS NOT NULL" for f in _SLOTS)
    dummies = ", ".join(f"CASE WHEN category = {_q(c)} THEN 1 ELSE 0 END AS \"category_{c}\"" for c in _GIVEN)
    return f""", matrix AS (SELECT *, {dummies} FROM full_features),
imp0 AS ({parts}),
imp AS (SELECT feature, round(coalesce(raw / nullif(sum(raw) OVER (), 0), 0.0), 6) AS importance FROM imp0)
"""


def importances(spark, sf):
    return RU.univariate_importance(MX.one_hot(full_features(spark, sf), _GIVEN), _SLOTS)


@query("importance_topk", full_features_prefix() + _imp_sql() + """
SELECT feature, importance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp) WHERE rank <= 10""")
def q_importance_topk(spark, sf):
    return RU.importance_topk(importances(spark, sf))


@query("select_by_importance", full_features_prefix() + _imp_sql() + """
SELECT CAST(list_position([""" + ", ".join(_q(n) for n in _SLOTS) + f"""], feature) - 1 AS INT) AS position,
       feature, importance
FROM imp WHERE importance >= {IMPORTANCE_THRESHOLD}""")
def q_select_by_importance(spark, sf):
    return RU.select_by_importance(importances(spark, sf), _SLOTS, IMPORTANCE_THRESHOLD)
