"""Spark ML properties: fixed seed, learnable signal, contract order, save/load equality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from veritext.operators import boosting as B
from veritext.operators import models as MO
from veritext.operators import split as SP
from veritext.plans import all_queries as A
from veritext.plans import catalog_boosting as CB
from veritext.plans.catalog_matrix import full_features


def _separable(spark):
    """Labelled by a feature threshold, so a correct learner must get it nearly right."""
    f = full_features(spark, SF_CHECK)
    return MO.prepared(f.withColumn("y", (F.col("word_count") > 300).cast("int")))


def test_trees_learn_a_threshold_and_keep_slot_order(spark):
    d = SP.split_hash(_separable(spark))
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    model = MO.fit_trees(train, max_iter=5, max_depth=2, seed=42)
    assert MO.auc_of(model.transform(test)) > 0.95
    names = MO.feature_names(model, train)
    cats = sorted(r[0] for r in train.select("category").distinct().collect())
    assert names[:len(MO.BASE_FEATURES)] == MO.BASE_FEATURES
    assert names[len(MO.BASE_FEATURES):] == [f"category_{c}" for c in cats]
    imp = MO.gain_importances(model, names)
    assert abs(sum(v for _, v in imp) - 1.0) < 1e-9
    top = max(imp, key=lambda x: x[1])[0]
    assert top == "word_count"
    splits = dict(MO.split_counts(model, names))
    assert splits["word_count"] >= 1


def test_same_seed_same_model(spark):
    d = _separable(spark)
    a = MO.score(MO.fit_trees(d, max_iter=3, max_depth=2, seed=42), d).orderBy("review_id").collect()
    b = MO.score(MO.fit_trees(d, max_iter=3, max_depth=2, seed=42), d).orderBy("review_id").collect()
    assert a == b


def test_model_roundtrip_gives_equal_predictions(spark):
    rows = A.QUERIES["model_roundtrip"](spark, SF_CHECK).collect()
    assert rows and all(r["same"] for r in rows)


def test_text_rounds_stop_and_the_best_is_evaluated(spark):
    rows = sorted(A.QUERIES["train_text"](spark, SF_CHECK).collect(), key=lambda r: r["step"])
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["eval_f1"] == max(r["eval_f1"] for r in rows)
    assert best[0]["test_f1"] is not None and all(r["test_f1"] is None for r in rows if not r["is_best"])
    assert len(rows) == 30 or rows[-1]["step"] - best[0]["step"] >= 2
    assert all(r["n"] > 0 for r in rows)


def test_grid_reports_both_folds_and_the_refit(spark):
    rows = A.QUERIES["train_grid"](spark, SF_CHECK).collect()
    assert sorted(r["param_id"] for r in rows) == list(range(1, 17))
    assert {(r["reg_alpha"], r["reg_lambda"]) for r in rows} == {(0.0, 0.5), (0.0, 1.5), (1.0, 0.5), (1.0, 1.5)}
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["mean_test_auc"] == max(r["mean_test_auc"] for r in rows)
    assert 0.0 <= best[0]["test_auc_best"] <= 1.0 and best[0]["num_original_features"] > 9
    assert abs(best[0]["best_cv_score"] - best[0]["mean_test_auc"]) < 1e-6
    # trees fit their own rows at least as well as the held-out ones
    assert all(r["mean_train_auc"] >= r["mean_test_auc"] - 0.02 for r in rows)


def test_early_stopping_uses_fewer_trees(spark):
    r = A.QUERIES["train_gbt_early"](spark, SF_CHECK).collect()[0]
    assert 1 <= r["trees_used"] < 100 and 0.0 <= r["test_auc"] <= 1.0


def test_selected_refit_uses_the_best_parameters_and_only_selected_slots(spark):
    t = CB.tuned(spark, SF_CHECK)
    best = max(t["summary"].values(), key=lambda r: (r["mean_test_auc"], -r["param_id"]))
    model = B.load(spark, t["selected"])
    assert model.settings == t["sets"][best["param_id"] - 1] == B.load(spark, t["tuned"]).settings
    used = {r["feature"] for r in B.importances(spark.read.parquet(f"{t['selected']}/nodes")).collect()}
    assert used and used <= set(t["slots"])
    assert CB.tuned(spark, SF_CHECK) is t  # trained once
    areas = {r["model"]: r["auc"] for r in A.QUERIES["train_compare"](spark, SF_CHECK).collect()}
    assert set(areas) == {"baseline", "tuned", "selected"} and min(areas.values()) > 0.5
    one = A.QUERIES["train_selected"](spark, SF_CHECK).collect()
    assert {r["feature"] for r in one} == set(t["slots"]) and {r["test_auc"] for r in one} == {areas["selected"]}


def test_saved_split_counts_equal_sql_over_the_same_files(spark, tmp_path):
    import duckdb

    d = _separable(spark)
    model = MO.fit_trees(d, max_iter=4, max_depth=3, seed=42)
    names = MO.feature_names(model, d)
    path = MO.save_model(model, str(tmp_path / "m"))
    got = dict(tuple(r) for r in MO.saved_split_counts(spark, path, names).collect())
    want = duckdb.sql(f"SELECT nodeData.split.featureIndex, count(*) FROM '{path}/stages/*GBT*/data/*.parquet' "
                      "WHERE nodeData.split.featureIndex >= 0 GROUP BY 1").fetchall()
    assert got == {names[i]: n for i, n in want}
    assert got == {n: c for n, c in MO.split_counts(model, names) if c}


def test_trained_hybrid_is_the_same_in_batch_and_stream(spark, tmp_path):
    from veritext.plans.catalog_lexicon import lexicon_params
    from veritext.plans.catalog_models import trained_models
    from veritext.schemas import REVIEW_COLUMNS
    from veritext.sources import tables as TB
    from veritext.streaming import scoring as ST

    tree, text, _ = trained_models(spark, SF_CHECK, max_iter=3)
    rows = TB.reviews_chat(spark, SF_CHECK).select(*REVIEW_COLUMNS).filter("review_id % 3 = 0")
    rows = rows.withColumn("rating", F.when(F.col("review_id") % 2 == 0, F.col("rating")))  # null ratings
    rows = rows.unionByName(rows.limit(1))  # one review is delivered twice
    params = lexicon_params(spark)
    rows.write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    batch, _ = ST.score_reviews(rows, params, (MO.load_model(tree), MO.load_model(text)))
    q = ST.start_scoring(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "no"),
                         str(tmp_path / "ckpt"), params, model_paths=(tree, text))
    q.awaitTermination()
    stream = ST.read_scored(spark, str(tmp_path / "out"))
    key = lambda r: tuple(str(x) for x in r)
    a, b = (sorted((tuple(r) for r in d.select(*ST.SCORED_COLUMNS).collect()), key=key) for d in (batch, stream))
    assert a == b and len(a) == rows.count()
