"""Second-order boosting against a plain recursive version, and its saved form."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.operators import boosting as B

SCHEMA = "review_id long, y double, a double, b double, category string, fold int"


def reviews(spark, n=240, seed=9):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = float(rng.integers(0, 12))
        b = None if rng.random() < 0.2 else float(np.round(rng.standard_normal(), 1))
        c = None if rng.random() < 0.1 else str(rng.choice(["x", "y", "z"]))
        y = float(rng.random() < 0.1 + 0.05 * a + (0.3 if c == "y" else 0) + (0.1 if b is None else 0))
        rows.append((i, y, a, b, c, int(i % 3)))
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def plain_fit(rows, cuts, labels, s, bins=None):
    """The same trees, by recursion over lists."""
    def split_rows():
        for f in range(2):
            for k, cut in enumerate(cuts[f]):
                has_none = [any(r[2 + f] is None for r in part) for part in (rows,)][0]
                for missing in ((False, True) if has_none else (False,)):
                    yield f, k, missing, lambda r, f=f, cut=cut, m=missing: m if r[2 + f] is None else r[2 + f] <= cut
        for k, v in enumerate(labels):
            yield 2, k, False, lambda r, v=v: r[4] != v

    def weight(g, h):
        return -s.learning_rate * math.copysign(max(abs(g) - s.reg_alpha, 0), g) / (h + s.reg_lambda)

    def worth(g, h):
        return max(abs(g) - s.reg_alpha, 0) ** 2 / (h + s.reg_lambda)

    margin = {r[0]: 0.0 for r in rows}
    for _ in range(s.n_estimators):
        p = {i: 1 / (1 + math.exp(-m)) for i, m in margin.items()}
        new = {}

        def grow(part, depth):
            g, h = sum(p[r[0]] - r[1] for r in part), sum(p[r[0]] * (1 - p[r[0]]) for r in part)
            best = (B.LEAST_GAIN, None)
            for f, k, missing, goes in split_rows() if depth < s.max_depth else ():
                left, right = [r for r in part if goes(r)], [r for r in part if not goes(r)]
                if missing and not any(r[2 + f] is None for r in part):
                    continue
                sums = [(sum(p[r[0]] - r[1] for r in x), sum(p[r[0]] * (1 - p[r[0]]) for r in x)) for x in (left, right)]
                if not left or not right or min(x[1] for x in sums) < s.min_child_weight:
                    continue
                gain = 0.5 * (worth(*sums[0]) + worth(*sums[1]) - worth(g, h)) - s.gamma
                if gain > best[0] + 1e-9:
                    best = (gain, (left, right))
            if best[1] is None:
                new.update({r[0]: weight(g, h) for r in part})
            else:
                for x in best[1]:
                    grow(x, depth + 1)

        grow(rows, 0)
        margin = {i: margin[i] + new[i] for i in margin}
    return {i: 1 / (1 + math.exp(-m)) for i, m in margin.items()}


@pytest.mark.parametrize("s", [B.Settings(3, 0.3, 2), B.Settings(2, 0.5, 3, reg_alpha=2.0, reg_lambda=0.5),
                               B.Settings(3, 1.0, 2, reg_alpha=0.5, gamma=0.3, min_child_weight=4.0)])
def test_equals_a_plain_version(spark, s):
    df, rows = reviews(spark)
    space = B.fit_space(df, ["a", "b"], max_bins=8)
    assert space.labels == ["x", "y", "z"] and all(c == sorted(set(c)) for c in space.cuts)
    got = {r["review_id"]: r["p_pos"] for r in B.score(B.fit(df, space, s), df).collect()}
    want = plain_fit(rows, space.cuts, space.labels, s)
    assert len(got) == len(rows) and max(abs(got[i] - want[i]) for i in got) < 1e-7


def test_many_models_in_one_go_equal_single_fits(spark, monkeypatch):
    df, _ = reviews(spark)
    space = B.fit_space(df, ["a", "b"], max_bins=8)
    monkeypatch.setattr(B, "STATE_EVERY", 2)  # margins are written between rounds
    jobs = [(B.Settings(5, 0.3, 2, reg_lambda=lam), fold) for lam in (0.1, 1.5) for fold in (None, 1)]
    together = B.fit_many(df, space, jobs, fold="fold")
    monkeypatch.setattr(B, "STATE_EVERY", 100)
    for (s, fold), model in zip(jobs, together):
        rows = df if fold is None else df.filter(F.col("fold") != fold)
        assert B.fit(rows, space, s).trees == model.trees


def test_regularisation_shrinks_and_prunes(spark):
    df, _ = reviews(spark)
    space = B.fit_space(df, ["a", "b"])
    free, l1, l2 = (B.fit(df, space, B.Settings(1, 1.0, 3, reg_alpha=a, reg_lambda=lam)).trees[0]
                    for a, lam in ((0.0, 0.0), (1e9, 0.0), (0.0, 1e9)))
    assert len(free.feature) > 1 and l1.feature == [-1] and l1.weight == [0.0]  # T(G) = 0 everywhere
    assert max(map(abs, l2.weight)) < 1e-6 < max(map(abs, free.weight))


def test_saved_nodes_give_the_same_model_and_counts(spark, tmp_path):
    import duckdb

    df, _ = reviews(spark)
    space = B.fit_space(df, ["a", "b"])
    model = B.fit(df, space, B.Settings(4, 0.3, 3))
    path = B.save(spark, model, str(tmp_path / "m"))
    again = B.load(spark, path)
    assert again == model
    got = {tuple(r) for r in B.importances(spark.read.parquet(f"{path}/nodes")).select("feature", "splits").collect()}
    want = duckdb.sql(f"SELECT feature, count(*) FROM '{path}/nodes/*.parquet' WHERE feature IS NOT NULL GROUP BY 1")
    assert got == set(want.fetchall()) and sum(n for _, n in got) == sum(f >= 0 for t in model.trees for f in t.feature)


def test_limited_slots(spark):
    df, _ = reviews(spark)
    space = B.fit_space(df, ["a", "b"]).only(["b", "category_z"])
    model = B.fit(df, space, B.Settings(3, 0.5, 3))
    used = {(f, c) for t in model.trees for f, c in zip(t.feature, t.code) if f >= 0}
    assert used and all(f == 1 or (f, c) == (2, space.labels.index("z")) for f, c in used)


def test_empty_and_one_sided(spark):
    df, _ = reviews(spark)
    none = df.limit(0)
    space = B.fit_space(none, ["a", "b"])
    assert space.cuts == [[], []] and space.labels == []
    model = B.fit(none, space, B.Settings(2, 0.3, 2))
    assert {r["p_pos"] for r in B.score(model, df).collect()} == {0.5}
    same = df.withColumn("y", F.lit(1.0))
    p = B.score(B.fit(same, B.fit_space(same, ["a", "b"]), B.Settings(3)), same).agg(F.min("p_pos")).first()[0]
    assert p > 0.7


def test_search_equals_fold_by_fold(spark):
    from veritext.operators import metrics as ME

    df, _ = reviews(spark)
    space = B.fit_space(df, ["a", "b"])
    sets = B.grid({"n_estimators": [2, 4], "learning_rate": [0.3], "max_depth": [2], "reg_alpha": [0.0, 1.0]})
    assert len(sets) == 4 and sets[1] == B.Settings(2, 0.3, 2, 1.0)
    got = {(r["param_id"], r["fold"]): (r["test_auc"], r["train_auc"]) for r in
           B.search(df, space, sets, folds=3).collect()}
    assert len(got) == 12
    for i, f in ((1, 0), (4, 2)):
        model = B.fit(df.filter(F.col("fold") != f), space, sets[i - 1])
        own = [ME.roc_auc(B.score(model, df.filter((F.col("fold") == f) == held)), "p_pos").first()["auc"]
               for held in (True, False)]
        assert got[i, f] == tuple(own)
