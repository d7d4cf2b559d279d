"""Stream-native scoring, user metrics, inferred CSV, shipped models, replaced categories."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veritext.operators import predict as PD
from veritext.operators import usermetrics as UM
from veritext.plans.catalog_lexicon import lexicon_params
from veritext.schemas import REVIEW_COLUMNS, REVIEWS
from veritext.session import scratch_path
from veritext.sources import files as FL
from veritext.sources import infer as IN
from veritext.sources import tables as TB
from veritext.streaming import native as NT
from veritext.streaming import scoring as ST


def test_native_stream_equals_batch_and_drops_replays(spark, tmp_path):
    rows = TB.reviews_chat(spark, SF_SMALL).select(*REVIEW_COLUMNS)
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "x", 9.0, None, "fine text"), (-3, None, None, None, " \n"),
                                 (-4, "x", 1.0, None, "in the of and! der est very! that the <b>or</b> not with")], REVIEWS)
    rows = rows.unionByName(odd).cache()
    src, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    params = lexicon_params(spark)
    rows.write.parquet(src)
    NT.start(spark, src, sink, ckpt, params).awaitTermination()
    rows.filter("review_id % 2 = 0").write.mode("append").parquet(src)
    spark.createDataFrame([(-9, "x", 2.0, None, "a new one")], REVIEWS).write.mode("append").parquet(src)
    NT.start(spark, src, sink, ckpt, params).awaitTermination()
    good, bad = NT.read(spark, sink)
    extra = spark.createDataFrame([(-9, "x", 2.0, None, "a new one")], REVIEWS)
    want, rejected = ST.score_reviews(rows.unionByName(extra), params)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, good.collect()), key=key) == sorted(map(tuple, want.select(*good.columns).collect()), key=key)
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, rejected.collect())) and len(bad.collect()) == 3


def test_lexicons_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(NT, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        NT.token_rules(spark, lexicon_params(spark))


def test_user_metric_of_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(UM, "SHARE", 2)  # several shares per group
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 10 else None, int(rng.random() < 0.4), float(rng.random())) for i in range(500)]
    rows += [("hot", None, 0.5), ("hot", 1, None), ("lone", 1, 0.9)]
    df = spark.createDataFrame(rows, "g string, y int, p double").repartition(7)
    got = {(r["g"], r["metric"]): r["value"] for r in UM.evaluate(df, UM.BrierAndCorrelation(), "g", p="p").collect()}
    for g in ("hot", None, "lone"):
        y, p = (np.array([r[i] for r in rows if r[0] == g and None not in r[1:]], float) for i in (1, 2))
        assert np.isclose(got[g, "brier"], ((y - p) ** 2).mean())
        mcc = np.corrcoef(y > 0.5, p > 0.5)[0, 1] if len(y) > 1 else 0.0
        assert np.isclose(got[g, "mcc"], mcc)
    assert UM.evaluate(df.limit(0), UM.BrierAndCorrelation(), "g", p="p").collect() == []


def test_types_come_from_all_rows(spark):
    path = scratch_path(spark, "odd-csv")
    lines = [f"{i},{i}.5,true,x{i}," for i in range(300)] + ["7,,False,,", '8,1e3,TRUE,"a, b",', "9,2", "1,2,3,4,5,6", "+5,.5,,7,"]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(path)
    typed, rejects = IN.read_csv_inferred(spark, path, ["a", "b", "c", "d", "e"], header=False)
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "double", "boolean", "string", "string"]
    assert typed.count() == 303 and typed.filter("d = 'a, b'").first()["b"] == 1000.0
    assert sorted(r["record"] for r in rejects.collect()) == ["1,2,3,4,5,6", "9,2"]
    spark.createDataFrame([("late,1,true,x,",)], "value string").write.mode("append").text(path)  # one row changes a type
    typed, _ = IN.read_csv_inferred(spark, path, ["a", "b", "c", "d", "e"], header=False)
    assert typed.schema["a"].dataType.simpleString() == "string"


def test_a_new_model_file_changes_the_result(spark):
    df = spark.createDataFrame([(1, 100, 10, 3), (2, 0, 0, 0)], "review_id long, char_length long, word_count long, punctuation_ct long")
    cols = ["char_length", "word_count", "punctuation_ct"]

    def p(**kw):
        made = PD.shipped_factory(spark, PD.save_weights(spark, scratch_path(spark, "model"), **kw))
        return {r["review_id"]: r["probability"][1] for r in PD.batch_predict(df, cols, made).collect()}

    first, other = p(), p(weights=(0.0, 0.0, 0.0), bias=0.0)
    assert other == {1: 0.5, 2: 0.5} and first[1] != 0.5
    assert first == {r["review_id"]: r["probability"][1] for r in PD.batch_predict(df, cols).collect()}


def test_replacing_one_category(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "review_id long, category string")
    path = FL.write_reviews(df, scratch_path(spark, "cats"))
    FL.replace_categories(spark.createDataFrame([(9, "b"), (8, "new")], df.schema), path)
    back = spark.read.schema(df.schema).parquet(path)
    assert {tuple(r) for r in back.collect()} == {(1, "a"), (9, "b"), (8, "new"), (3, None)}
    plan = back.filter(F.col("category") == "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan
