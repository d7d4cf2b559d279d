"""Training in rounds: gradient against differences of the loss, stop rule, restored weights."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.operators import runs as RU
from veritext.operators import textmodel as TM

SCHEMA = "review_id long, y int, part string, cleaned_text string"
SLOTS = 64


def reviews(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.5)
        words = [f"w{rng.integers(0, 30)}" for _ in range(int(rng.integers(0, 12)))] + ["good" if y and rng.random() < 0.7 else "w1"]
        rows.append((i, y, ("train", "validation", "test")[i % 4 if i % 4 < 3 else 0], " ".join(words)))
    rows += [(n, 1, "train", ""), (n + 1, None, "train", "unlabelled good"), (n + 2, 0, None, "no part")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def loss(rows, model, l2):
    total = n = 0
    for r in rows:
        if r["part"] == "train":
            m = model.bias + sum(model.idf[s] * model.weights[s] for s in r["slots"]) / max(len(r["slots"]), 1) ** 0.5
            total, n = total + np.logaddexp(0, -m if r["y"] > 0.5 else m), n + 1
    return total / n + l2 * (model.weights @ model.weights) / 2


def test_gradient_is_the_slope_of_the_loss(spark):
    rows = TM.prepared(reviews(spark), slots=SLOTS)
    idf = TM.slot_weights(rows.filter("part = 'train'"), SLOTS)
    rng = np.random.default_rng(0)
    model = TM.TextModel(idf, rng.standard_normal(SLOTS), 0.3)
    g, g_bias, _ = TM.gradient(rows, model, 0.01)
    held = rows.collect()
    for s in rng.integers(0, SLOTS, 6):
        off = np.eye(SLOTS)[s] * 1e-5
        slope = (loss(held, TM.TextModel(idf, model.weights + off, 0.3), 0.01)
                 - loss(held, TM.TextModel(idf, model.weights - off, 0.3), 0.01)) / 2e-5
        assert abs(slope - g[s]) < 1e-6
    slope = (loss(held, TM.TextModel(idf, model.weights, 0.3 + 1e-5), 0.01)
             - loss(held, TM.TextModel(idf, model.weights, 0.3 - 1e-5), 0.01)) / 2e-5
    assert abs(slope - g_bias) < 1e-6


def test_stops_where_the_log_says_and_restores_the_best_round(spark):
    rows = TM.prepared(reviews(spark), slots=SLOTS)
    log, path = TM.fit_rounds(rows, TM.Rounds(max_rounds=25, learning_rate=0.3), SLOTS)
    assert [r["step"] for r in log] == list(range(1, len(log) + 1)) and 3 <= len(log) < 25
    records = spark.createDataFrame(log).withColumn("run_id", F.lit("a"))
    stop = {r["stop_step"] for r in RU.early_stop(records, patience=2).collect()}
    assert stop == {len(log)}
    best = RU.best_record(records).first()
    assert TM.best_round(log) == best["step"]
    model = TM.load_round(spark, path, best["step"], SLOTS)
    again = TM.evaluate(model, rows, TM.VALIDATION).first()
    assert (again["f1"], again["accuracy"], again["n"]) == (best["eval_f1"], best["eval_accuracy"], best["n"])
    assert TM.evaluate(model, rows).first()["f1"] > 0.6
    assert TM.score(model, rows).count() == 302  # the unlabelled row is in no part


@pytest.mark.parametrize("parts", [1, 7])
def test_result_does_not_depend_on_the_number_of_tasks(spark, parts):
    rows = TM.prepared(reviews(spark).repartition(parts), slots=SLOTS)
    log, _ = TM.fit_rounds(rows, TM.Rounds(max_rounds=4), SLOTS)
    one = TM.fit_rounds(TM.prepared(reviews(spark).coalesce(2), slots=SLOTS), TM.Rounds(max_rounds=4), SLOTS)[0]
    assert [r["eval_f1"] for r in log] == [r["eval_f1"] for r in one]


def test_nothing_to_train_on(spark):
    rows = TM.prepared(reviews(spark).filter("y > 5"), slots=SLOTS)
    log, path = TM.fit_rounds(rows, TM.Rounds(max_rounds=5), SLOTS)
    assert len(log) == 3 and all(r["n"] == 0 and r["eval_f1"] == 0.0 for r in log)
    assert TM.score(TM.load_round(spark, path, 1, SLOTS), rows).collect() == []
