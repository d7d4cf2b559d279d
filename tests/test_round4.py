"""Round 4: models on a cluster, exact seating, sums of boosting and tagging, featurizing once."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import functions as F

from veritext.llm import hpylm
from veritext.operators import boosting as B
from veritext.operators import matrix as MX
from veritext.operators import predict as PD
from veritext.operators import tagger as TG
from veritext.plans import catalog_matrix as CM
from veritext.session import scratch_path


def test_a_model_ships_where_folders_do_not(spark, monkeypatch):
    add = SparkContext.addFile

    def as_on_a_cluster(self, path, recursive=False):
        assert not os.path.isdir(unquote(urlparse(path).path)), "addFile does not support local directories"
        return add(self, path, recursive)

    monkeypatch.setattr(SparkContext, "addFile", as_on_a_cluster)
    df = spark.createDataFrame([(1, 100, 10, 3), (2, 0, 0, 0)], "id long, a long, b long, c long")
    made = PD.shipped_factory(spark, PD.save_weights(spark, scratch_path(spark, "a model"), (0.0, 0.0, 0.1), 0.0))
    got = {r["id"]: r["probability"][1] for r in PD.batch_predict(df, ["a", "b", "c"], made).collect()}
    assert got[2] == 0.5 and 0.5 < got[1] < 0.6


def test_customers_are_seated_one_by_one():
    rng = np.random.default_rng(4)
    customers = np.concatenate([[1, 2, 3, 2000], rng.integers(1, 300, 40)]).astype(float)
    strength = np.exp(rng.uniform(-5, 8, len(customers)))
    keys = rng.integers(0, 1 << 60, len(customers)).astype(np.uint64)
    for d in (0.1, 0.5, 0.95):
        want = []
        for n, a, seed in zip(customers, strength, hpylm._seed(keys, np.uint64(3))):
            t = 1
            for j in range(1, int(n)):
                t += hpylm._uniform(np.array([seed]), np.array([j]))[0] < a / (a + j - d * t)
            want.append(t)
        assert hpylm.seat(customers, strength, d, keys, np.uint64(3)).tolist() == want
    # all at once or in any parts: the same
    assert hpylm.seat(customers[7:], strength[7:], 0.95, keys[7:], np.uint64(3)).tolist() == want[7:]


def test_a_pass_sorts_each_feature_once_for_all_models(spark, monkeypatch):
    """The sums of many models cost no sort of the rows per model."""
    rng, calls, unique = np.random.default_rng(2), [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: (calls.append(1), unique(*a, **k))[1])
    bins = rng.integers(-1, 6, (200, 3)).astype(np.int32)
    y, n = rng.integers(0, 2, 200).astype(float), 10
    batch = pa.RecordBatch.from_arrays([B._packed(bins), pa.array(y), pa.array(np.zeros(200, np.int32)),
                                        B._packed(np.zeros((200, n)))], names=["bins", "y", "fold", "margins"])
    growing = []
    for _ in range(n):
        tree = B.Tree()
        growing.append((tree, [tree.add(0.0, 0.0)]))

    class Rows:
        def mapInArrow(self, run, schema):
            self.out = list(run(iter([batch])))
            return self

        def repartition(self, *_):
            return self

        groupBy = repartition

        def agg(self, *_):
            return self

    got = B._cells(Rows(), 3, [[] for _ in growing], growing, [None] * n).out[0].to_pylist()
    assert len(calls) == 3
    assert {(r["model"], r["feature"], r["bin"]) for r in got} == {
        (m, f, int(b)) for m in range(n) for f in range(3) for b in set(bins[:, f].tolist())}
    for r in got[:20]:
        here = bins[:, r["feature"]] == r["bin"]
        assert r["g"] == int((0.5 - y[here]).sum() * 2 ** 32) and r["h"] == int(here.sum() * 0.25 * 2 ** 32)
    assert (B._rows(B._packed(bins).slice(7, 5), 3) == bins[7:12]).all() and B._rows(B._packed(bins[:0]), 3).shape == (0, 3)


def _tables(spark, path):
    text = "good words, but not very good; he quickly runs. "
    docs = [(i, text * (1 + i % 3), f"s{i % 2}") for i in range(12)] + [(3, "another third", "s1"), (None, "no id", "s0")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(6)] + [(2, 1), (7, None)], "doc_id long, quality int").write.parquet(
        f"{path}/labels.parquet")
    return str(path)


def test_training_featurizes_labelled_rows_only_and_texts_stay_out_of_the_tokens(spark, tmp_path, monkeypatch):
    sf, seen, made = _tables(spark, tmp_path), [], CM.featurized

    def watched(spark, df, keep_extra=()):
        seen.append((df.count(), list(keep_extra)))
        return made(spark, df, keep_extra)

    monkeypatch.setattr(CM, "featurized", watched)
    key = ["review_id", "y", "word_count", "sentiment_score", "VERB", "category"]
    rows = lambda df: sorted(map(str, df.select(*key).collect()))
    want = rows(CM.full_features(spark, sf).filter("y IS NOT NULL"))
    assert rows(CM.full_features(spark, sf, labelled=True)) == want and len(want) == 8
    with_text = CM.full_features(spark, sf, ["cleaned_text"], labelled=True)
    assert rows(with_text) == want
    assert all(r["word_count"] == len(r["cleaned_text"].split()) for r in with_text.collect())
    assert seen == [(14, []), (7, []), (7, ["_at"])]


def test_the_matrix_makes_its_features_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(x):
        made.add(1)
        return x

    names = [*MX.NUMERIC_FEATURES, *MX.TAG_FEATURES]
    df = spark.range(6).select(F.col("id").alias("review_id"), F.lit(1).alias("y"), *(F.lit(1).alias(c) for c in names),
                               count.asNondeterministic()("id").cast("string").alias("category"))
    assert len(MX.feature_matrix(df).collect()) == 6
    assert made.value <= 12  # a checkpoint counts the rows, then writes them; each further use reads them


def test_a_long_text_is_tagged_in_pieces():
    """The steps taken one after another do not grow with the longest text."""
    rng = np.random.default_rng(3)
    m = TG.Markov(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3))
    text = rng.integers(0, 9, 3 * TG.PIECE + 5)
    whole = TG.expected([text, text[:7]], m)
    forward, like = m.start * m.emit[:, text[0]], 0.0
    for x in text[1:]:
        like += np.log(forward.sum())
        forward = (forward / forward.sum()) @ m.move * m.emit[:, x]
    like += np.log(forward.sum()) + TG.expected([text[:7]], m)[3]
    assert np.isclose(whole[3], like) and np.isclose(whole[1].sum(), len(text) - 1 + 6)
    assert np.isclose(whole[2].sum(), len(text) + 7) and np.isclose(whole[0].sum(), 2)


def test_words_hash_to_the_same_slots(spark):
    from veritext.operators import textmodel as TM

    df = spark.createDataFrame([(1, ["a", "b\u00e9", "a"]), (2, []), (3, None)], "id long, words array<string>").coalesce(1)
    got = df.select("words", TG.slots_of("words", 512).alias("s"), TM.word_slots(F.array_join("words", " "), 512).alias("w"))
    assert all(r["s"] == r["w"] for r in got.collect())
