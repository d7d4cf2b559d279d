"""the search runs every set of the grid; models trained inside a task are those of the passes over all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tests.test_boosting import reviews
from veritext.constants import SEARCH_AXES
from veritext.operators import boosting as B
from veritext.operators import metrics as ME
from veritext.plans import all_queries as A
from veritext.plans import catalog_boosting as CB

JOBS = [(B.Settings(4, 0.3, 4, reg_lambda=0.1), None), (B.Settings(6, 1.0, 3, reg_alpha=0.5), 1),
        (B.Settings(3, 0.6, 5, gamma=0.2, min_child_weight=0.0), 2), (B.Settings(2, 0.5, 0), None)]


@pytest.mark.parametrize("slots", [None, ["b", "category_z"], ["a"]])
def test_trees_grown_inside_a_task_are_those_of_the_passes(spark, monkeypatch, slots):
    df, _ = reviews(spark)
    space = B.fit_space(df, ["a", "b"], max_bins=8)
    space = space if slots is None else space.only(slots)
    monkeypatch.setattr(B, "IN_TASK", -1)
    passes = [m.trees for m in B.fit_many(df, space, JOBS, fold="fold")]
    monkeypatch.setattr(B, "IN_TASK", 1 << 20)
    assert [m.trees for m in B.fit_many(df, space, JOBS, fold="fold")] == passes
    # many small pieces of rows in mapped files, one model at a time
    for name, value in (("CHUNK", 17), ("AT_ONCE", 1), ("MAPPED", 64)):
        monkeypatch.setattr(B, name, value)
    assert [m.trees for m in B.fit_many(df, space, JOBS, fold="fold")] == passes


def test_a_search_scores_every_set_of_every_fold(spark):
    df, _ = reviews(spark)
    df = df.withColumn("fold", F.when(F.col("review_id") > 5, F.col("fold")))  # rows of no fold train everywhere
    space = B.fit_space(df, ["a", "b"])
    sets = B.grid({"n_estimators": [7, 3], "learning_rate": [1.0], "max_depth": [1, 6], "reg_lambda": [0.1, 2.0]})
    got = {(r["param_id"], r["fold"]): (r["test_auc"], r["train_auc"]) for r in B.search(df, space, sets, folds=4).collect()}
    assert len(got) == 32 and all(got[i, 3][0] is None and got[i, 3][1] is not None for i in range(1, 9))  # no row has fold 3
    for i, f in ((3, 0), (8, 2)):
        model = B.fit(df.filter(~F.col("fold").eqNullSafe(f)), space, sets[i - 1])
        own = [ME.roc_auc(B.score(model, df.filter(F.col("fold").eqNullSafe(f) == held)), "p_pos").first()["auc"]
               for held in (True, False)]
        assert got[i, f] == tuple(own)


def test_the_search_of_the_tuned_model_is_the_whole_grid(spark, monkeypatch):
    asked = []

    class Asked(Exception):
        pass

    def search(rows, space, sets, *a, **kw):
        asked.extend(sets)
        raise Asked

    monkeypatch.setattr(CB, "train_test", lambda *a: (None, None))
    for name in ("baseline", "space_of"):
        monkeypatch.setattr(CB, name, lambda *a: None)
    for name, value in (("save_model", ""), ("feature_names", []), ("gain_importances", [])):
        monkeypatch.setattr(CB.MO, name, lambda *a, value=value: value)
    monkeypatch.setattr(CB.SP, "fold_assign", lambda train: train)
    monkeypatch.setattr(CB.B, "search", search)
    with pytest.raises(Asked):
        CB.tuned(spark, "no such folder")
    assert len(asked) == 768 and asked == B.grid(SEARCH_AXES)


def test_grid_reports_the_whole_grid(spark):
    rows = sorted(A.QUERIES["train_grid"](spark, SF_CHECK).collect(), key=lambda r: r["param_id"])
    assert [tuple(r[n] for n in SEARCH_AXES) for r in rows] == [tuple(float(getattr(s, n)) for n in SEARCH_AXES)
                                                               for s in B.grid(SEARCH_AXES)]
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["mean_test_auc"] == max(r["mean_test_auc"] for r in rows)
    assert 0.0 <= best[0]["test_auc_best"] <= 1.0 and best[0]["num_original_features"] > 9
    assert abs(best[0]["best_cv_score"] - best[0]["mean_test_auc"]) < 1e-6
    assert all(r["mean_train_auc"] >= r["mean_test_auc"] - 0.02 for r in rows)
