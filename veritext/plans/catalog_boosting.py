"""Registered queries, part 8: regularised boosting, its search, and the refit on selected features.

The trees of one round, and the fold scores of one-split models, have exact SQL oracles: the same cuts,
gains, leaf weights and areas. Keys that train further have oracles for what SQL can state, and tests for
the rest.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from veritext.constants import IMPORTANCE_THRESHOLD, NUMERIC_FEATURES, SEARCH_AXES, TAG_FEATURES
from veritext.operators import boosting as B
from veritext.operators import metrics as ME
from veritext.operators import models as MO
from veritext.operators import runs as RU
from veritext.operators import split as SP
from veritext.plans.catalog_models import _HELD, _TEST, baseline, train_test
from veritext.plans.registry import query
from veritext.plans.sql_lexicon import full_features_prefix
from veritext.session import scratch_path
from veritext.sources import files as FL

NUMBERS = NUMERIC_FEATURES + TAG_FEATURES
TREE_SETS = [B.Settings(1, 0.3, 2), B.Settings(1, 1.0, 2, reg_alpha=4.0, reg_lambda=0.5)]
STUMPS = B.grid({"n_estimators": [1], "max_depth": [1], "learning_rate": [0.3], "reg_alpha": [0.0, 40.0],
                 "reg_lambda": [0.5, 50.0]})

# -- the same in SQL ---------------------------------------------------------------------------------

_AXIS_NAMES = [f.name for f in dataclasses.fields(B.Settings)]


def _settings_sql(sets) -> str:
    rows = ", ".join(f"({i}, {', '.join(f'{float(getattr(s, n))}::DOUBLE' for n in _AXIS_NAMES)})"
                     for i, s in enumerate(sets, 1))
    return f"params(param_id, {', '.join(_AXIS_NAMES)}) AS (VALUES {rows})"


def _space_sql() -> str:
    """CTEs tr (training rows) and cand (f, code, cut, category): every cut of every feature."""
    x = ", ".join(f'CAST("{c}" AS DOUBLE)' for c in NUMBERS)
    return f"""
 tr AS (SELECT review_id, y, [{x}] AS x, category FROM full_features WHERE y IS NOT NULL AND NOT {_TEST}),
 vals AS (SELECT f, list(v ORDER BY v) AS vs, count(*) AS n FROM
   (SELECT unnest(range({len(NUMBERS)})) AS f, unnest(x) AS v FROM tr) GROUP BY f),
 cuts AS (SELECT DISTINCT f, vs[CAST(ceil(i * n / {B.MAX_BINS}.0::DOUBLE) AS INT)] AS cut
   FROM vals, range(1, {B.MAX_BINS + 1}) t(i)),
 cand AS (SELECT f, row_number() OVER (PARTITION BY f ORDER BY cut) - 1 AS code, cut, NULL::VARCHAR AS category FROM cuts
  UNION ALL SELECT {len(NUMBERS)}, row_number() OVER (ORDER BY category) - 1, NULL, category FROM
   (SELECT DISTINCT category FROM tr WHERE category IS NOT NULL))"""


_LEFT = (f"CASE WHEN c.f < {len(NUMBERS)} THEN r.x[c.f + 1] <= c.cut "
         "ELSE r.category IS DISTINCT FROM c.category END")


def _t(g: str) -> str:
    return f"(sign({g}) * greatest(abs({g}) - reg_alpha, 0.0::DOUBLE))"


def _level_sql(rows: str, name: str, keys: str) -> str:
    """CTEs of the best cut per ``keys`` of ``rows`` (keys, review_id, y, x, category): <name>, in the first
    round, where every gradient is 0.5 - y and every hessian 0.25."""
    worth = "{0} * {0} / ({1} + reg_lambda)"
    left, right, whole = (worth.format(_t(g), h) for g, h in (("gl", "hl"), ("g - gl", "h - hl"), ("g", "h")))
    return f"""
 {name}_sums AS (SELECT {keys}, c.f, c.code, any_value(c.cut) AS cut, any_value(c.category) AS category,
   sum(0.5::DOUBLE - r.y) AS g, count(*) * 0.25::DOUBLE AS h,
   coalesce(sum(0.5::DOUBLE - r.y) FILTER ({_LEFT}), 0.0::DOUBLE) AS gl, (count(*) FILTER ({_LEFT})) * 0.25::DOUBLE AS hl
  FROM {rows} r, cand c GROUP BY {keys}, c.f, c.code),
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY gain DESC, f, code) AS place_in_order FROM
   (SELECT s.*, 0.5::DOUBLE * ({left} + {right} - {whole}) - gamma AS gain FROM {name}_sums s JOIN params USING (param_id)
    WHERE hl >= min_child_weight AND h - hl >= min_child_weight AND hl > 0 AND h - hl > 0)
   WHERE gain > {B.LEAST_GAIN}) WHERE place_in_order = 1)"""


def _names_sql(f: str, category: str) -> str:
    return f"CASE WHEN {f} < {len(NUMBERS)} THEN {NUMBERS!r}[{f} + 1] ELSE 'category_' || {category} END"


_TREE_SQL = full_features_prefix() + f""", {_settings_sql(TREE_SETS)}, {_space_sql()},
 r0 AS (SELECT param_id, '' AS place, tr.* FROM tr, params),
 {_level_sql('r0', 'b0', 'param_id, place')},
 r1 AS (SELECT r.param_id, r.place || CASE WHEN {_LEFT} THEN 'L' ELSE 'R' END AS place, r.review_id, r.y, r.x, r.category
   FROM r0 r JOIN b0 c USING (param_id, place)),
 {_level_sql('r1', 'b1', 'param_id, place')},
 r2 AS (SELECT r.param_id, r.place || CASE WHEN {_LEFT} THEN 'L' ELSE 'R' END AS place, r.review_id, r.y, r.x, r.category
   FROM r1 r JOIN b1 c USING (param_id, place)),
 nodes AS (SELECT param_id, place, sum(0.5::DOUBLE - y) AS g, count(*) * 0.25::DOUBLE AS h FROM
   (SELECT param_id, place, y FROM r0 UNION ALL SELECT param_id, place, y FROM r1 UNION ALL SELECT param_id, place, y FROM r2)
   GROUP BY ALL),
 splits AS (SELECT param_id, place, f, cut, category, gain FROM b0 UNION ALL SELECT param_id, place, f, cut, category, gain FROM b1)
SELECT CAST(n.param_id AS INT) AS param_id, n.place, {_names_sql('s.f', 's.category')} AS feature, round(s.cut, 6) AS cut,
  round(coalesce(s.gain, 0.0), 6) AS gain, round(h, 6) AS cover,
  round(-learning_rate * {_t('g')} / (h + reg_lambda), 6) AS weight
FROM nodes n JOIN params p USING (param_id) LEFT JOIN splits s ON s.param_id = n.param_id AND s.place = n.place"""

_FOLDS = ("CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) - 1) "
          "% 5 AS INT)")

_STUMPS_SQL = full_features_prefix() + f""", {_settings_sql(STUMPS)}, {_space_sql()},
 fd AS (SELECT *, {_FOLDS} AS own FROM tr),
 folds AS (SELECT unnest(range(5)) AS fold),
 r0 AS (SELECT param_id, fold, fd.* FROM fd, params, folds WHERE own <> fold),
 {_level_sql('r0', 'b0', 'param_id, fold')},
 p AS (SELECT param_id, folds.fold, own = folds.fold AS test, r.y, -learning_rate * CASE WHEN c.f IS NULL THEN 0.0
    WHEN {_LEFT} THEN {_t('gl')} / (hl + reg_lambda) ELSE {_t('g - gl')} / (h - hl + reg_lambda) END AS m
  FROM fd r, folds JOIN params ON true LEFT JOIN b0 c USING (param_id, fold)),
 runs AS (SELECT param_id, fold, test, m, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY ALL),
 areas AS (SELECT param_id, fold, test, sum(pos * (lower + 0.5::DOUBLE * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM
   (SELECT *, coalesce(sum(neg) OVER (PARTITION BY param_id, fold, test ORDER BY m
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM runs) GROUP BY ALL)
SELECT CAST(param_id AS INT) AS param_id, CAST(fold AS INT) AS fold,
  round(coalesce(max(auc) FILTER (test), 0.0), 6) AS test_auc,
  round(coalesce(max(auc) FILTER (NOT test), 0.0), 6) AS train_auc FROM areas GROUP BY ALL"""


# -- queries -----------------------------------------------------------------------------------------


def space_of(train):
    return B.fit_space(train, NUMBERS, "category")


def _paths(tree: B.Tree) -> dict[int, str]:
    """Node numbers as paths of L and R from the root."""
    out = {0: ""}
    for node in range(len(tree.feature)):
        if tree.feature[node] >= 0:
            out[tree.left[node]], out[tree.right[node]] = out[node] + "L", out[node] + "R"
    return out


@query("boost_tree", _TREE_SQL)
def q_boost_tree(spark, sf):
    """M1: the first tree under two settings, grown to depth 2 over the training rows: every node with its
    cut, gain, cover and regularised weight."""
    train, _ = train_test(spark, sf)
    models = B.fit_many(train, space_of(train), [(s, None) for s in TREE_SETS])
    out = None
    for i, model in enumerate(models, 1):
        paths = spark.createDataFrame(list(_paths(model.trees[0]).items()), "node int, place string")
        nodes = B.node_table(spark, model).join(paths, "node").select(
            F.lit(i).alias("param_id"), "place", "feature", F.round("cut", 6).alias("cut"),
            F.round("gain", 6).alias("gain"), F.round("cover", 6).alias("cover"), F.round("weight", 6).alias("weight"))
        out = nodes if out is None else out.unionByName(nodes)
    return out


@query("train_grid_stumps", _STUMPS_SQL)
def q_train_grid_stumps(spark, sf):
    """M3: the search itself over one-split models, where SQL can follow every fold: areas on the fold left
    out and on the others."""
    train, _ = train_test(spark, sf)
    scores = B.search(SP.fold_assign(train), space_of(train), STUMPS)
    return scores.select("param_id", F.col("fold").cast("int").alias("fold"), "test_auc", "train_auc")


_TUNED: dict[tuple[str, str], dict] = {}


def tuned(spark, sf) -> dict:
    """M3 / M4 / S5 / S7, once per session and table folder: the search over ``SEARCH_AXES`` with stratified folds,
    the best set refit on all slots and on the selected ones, both models and the record saved."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _TUNED:
        return _TUNED[key]
    train, test = train_test(spark, sf)
    first = baseline(train)
    base = MO.save_model(first, scratch_path(spark, "baseline-model"))
    gains = MO.gain_importances(first, MO.feature_names(first, train))
    selected = [n for n, v in gains if v >= IMPORTANCE_THRESHOLD]
    space, sets = space_of(train), B.grid(SEARCH_AXES)
    summary = {r["param_id"]: r for r in RU.grid_summary(B.search(SP.fold_assign(train), space, sets)).collect()}
    best = next(i for i, r in summary.items() if r["is_best"])
    on_all = B.save(spark, B.fit(train, space, sets[best - 1]), scratch_path(spark, "tuned-model"))
    on_few = B.save(spark, B.fit(train, space.only(selected), sets[best - 1]), scratch_path(spark, "selected-model"))
    auc = ME.roc_auc(B.score(B.load(spark, on_all), test), "p_pos").first()["auc"]
    record = {"best_params": {n: float(v) for n, v in dataclasses.asdict(sets[best - 1]).items()},
              "best_cv_score": summary[best]["mean_test_auc"], "test_auc_best": auc, "num_original_features": len(gains)}
    path = FL.write_json(spark.createDataFrame([record], RECORD), scratch_path(spark, "tuned-run"), mode="append")
    _TUNED[key] = {"sets": sets, "summary": summary, "baseline": base, "tuned": on_all, "selected": on_few,
                   "slots": selected, "record": path, "test": test}
    return _TUNED[key]


RECORD = "best_params map<string,double>, best_cv_score double, test_auc_best double, num_original_features int"


@query("train_grid")
def q_train_grid(spark, sf):
    """Every set of the grid, leaf regularisation included, with its mean areas over stratified
    folds; the best set's record, read back, stands in its row."""
    t = tuned(spark, sf)
    rows = [(i, *(float(getattr(s, n)) for n in SEARCH_AXES), r["mean_test_auc"], r["std_test_auc"], r["mean_train_auc"],
             r["is_best"]) for i, s in enumerate(t["sets"], 1) for r in [t["summary"][i]]]
    grid = spark.createDataFrame(rows, "param_id int, " + ", ".join(f"{n} double" for n in SEARCH_AXES) + ", mean_test_auc double, "
                                 "std_test_auc double, mean_train_auc double, is_best boolean")
    kept = FL.read_json(spark, t["record"], RECORD).select(
        "best_cv_score", "test_auc_best", "num_original_features", F.lit(True).alias("is_best"))
    return grid.join(kept, "is_best", "left")


@query("train_selected")
def q_train_selected(spark, sf):
    """Slots with baseline gain importance >= 0.020, refit with the best parameters of the search;
    the saved model's splits on each slot and its area on the held-out rows."""
    t = tuned(spark, sf)
    model = B.load(spark, t["selected"])
    auc = ME.roc_auc(B.score(model, t["test"]), "p_pos").first()["auc"]
    used = B.importances(spark.read.parquet(f"{t['selected']}/nodes"))
    slots = spark.createDataFrame([(n,) for n in t["slots"]], "feature string")
    return slots.join(used, "feature", "left").select(
        "feature", F.lit(len(t["slots"])).alias("n_selected"), F.coalesce("splits", F.lit(0)).alias("splits"),
        F.lit(auc).alias("test_auc"))


@query("selected_roundtrip", _HELD + "SELECT review_id, y, true AS same, true AS best_params FROM held")
def q_selected_roundtrip(spark, sf):
    """The saved selected model carries the recorded best parameters and scores the held-out
    rows like a fresh fit with them."""
    t = tuned(spark, sf)
    train, _ = train_test(spark, sf)
    saved = B.load(spark, t["selected"])
    best = FL.read_json(spark, t["record"], RECORD).first()["best_params"]
    params = {n: float(v) for n, v in dataclasses.asdict(saved.settings).items()}
    fresh = B.fit(train, space_of(train).only(t["slots"]), B.Settings(
        **{f.name: type(f.default)(best[f.name]) for f in dataclasses.fields(B.Settings)}))
    p = B.probabilities(t["test"], [(saved, None), (fresh, None)], ["review_id", "y"], "_p")
    return p.select("review_id", F.col("y").cast("int").alias("y"), (F.col("_p")[0] == F.col("_p")[1]).alias("same"),
                    F.lit(params == best).alias("best_params"))


@query("train_compare")
def q_train_compare(spark, sf):
    """M5: baseline, tuned model and selected refit, each from its saved form, on the same held-out rows."""
    t = tuned(spark, sf)
    made = ("_cat_idx", "_cat_vec", "features", "rawPrediction", "probability", "prediction")
    first = MO.positive_probability(MO.load_model(t["baseline"]).transform(t["test"]), "p_baseline").drop(*made)
    both = [(B.load(spark, t[name]), None) for name in ("tuned", "selected")]
    # the two boosted models stand beside the first one's score, so one pass over the rows serves all
    p = B.probabilities(first, both, ["y", "p_baseline"], "_p")
    scored = p.select(F.col("y").cast("int").alias("y"), "p_baseline", F.col("_p")[0].alias("p_tuned"),
                      F.col("_p")[1].alias("p_selected"))
    return ME.compare_models(scored, {n: f"p_{n}" for n in ("baseline", "tuned", "selected")})


@query("importance_nodes", _HELD + """, feature_kinds(kind) AS (VALUES ('number'), ('category'))
SELECT kind, true AS counts_agree FROM feature_kinds""")
def q_importance_nodes(spark, sf):
    """Splits per kind of slot, read from the saved node table of the baseline as a DataFrame; the counts
    agree with those of the trees in memory."""
    train, _ = train_test(spark, sf)
    model = MO.fit_trees(train, max_iter=10, max_depth=4, seed=42)
    names = MO.feature_names(model, train)
    path = MO.save_model(model, scratch_path(spark, "tree-model"))
    kind = F.when(F.col("feature").startswith("category_"), "category").otherwise("number")
    in_memory = spark.createDataFrame(MO.split_counts(model, names), "feature string, n int")
    saved = MO.saved_split_counts(spark, path, names)
    both = in_memory.join(saved, "feature", "left")
    return both.groupBy(kind.alias("kind")).agg(
        F.bool_and(F.col("n") == F.coalesce("splits", F.lit(0))).alias("counts_agree"))
