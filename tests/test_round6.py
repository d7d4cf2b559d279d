"""each model is trained on what it needs alone; texts are not joined to numbers for training, and their tokens
come from one split."""

from __future__ import annotations

import random
import time

from tests.test_round4 import _tables
from veritext.constants import PUNCTUATION, WS_CODE_POINTS
from veritext.functions import text as T
from veritext.operators import models as MO
from veritext.plans import catalog_models as CO
from veritext.plans.catalog_matrix import full_features


def _some(spark, tmp_path):
    """The tables of round 4 with more labelled documents, two of them with two labels or two texts."""
    sf = _tables(spark, tmp_path)
    docs = [(i, f"good word{i % 4}, but not <b>bad</b>! " * (i % 3), f"s{i % 3}") for i in range(100, 140)]
    docs += [(100, "another text", None), (139, None, "s9")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.mode("append").parquet(f"{sf}/documents.parquet")
    labels = [(i, i % 2) for i in range(100, 140)] + [(101, 1), (101, 0), (120, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.mode("append").parquet(f"{sf}/labels.parquet")
    return sf


def test_training_reads_numbers_and_texts_apart(spark, tmp_path, monkeypatch):
    sf, seen = _some(spark, tmp_path), {}
    for name in ("fit_trees", "fit_text"):
        made = getattr(MO, name)
        monkeypatch.setattr(MO, name, lambda train, *a, _name=name, _made=made, **k: (
            seen.update({_name: train}), _made(train, *a, **k))[1])
    _, _, test = CO.trained_models(spark, sf, max_iter=2)
    assert "cleaned_text" not in seen["fit_trees"].columns
    assert "Join" not in seen["fit_text"]._jdf.queryExecution().optimizedPlan().toString()
    # the same rows as from the features of all documents
    want = CO.SP.split_hash(MO.prepared(full_features(spark, sf, ["cleaned_text"])))
    rows = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    numbers, texts = ["review_id", "y", "category", *MO.BASE_FEATURES], ["review_id", "y", "cleaned_text"]
    train, held = want.filter("split = 'train'"), want.filter("split = 'test'")
    assert rows(seen["fit_trees"], numbers) == rows(train, numbers)
    assert rows(seen["fit_text"], texts) == rows(train, texts)
    assert sorted(test.columns) == sorted(want.columns)
    assert rows(test, sorted(want.columns)) == rows(held, sorted(want.columns)) and held.count() > 3


def test_tokens_are_split_once_and_in_linear_time(spark):
    rng = random.Random(6)
    signs = [*PUNCTUATION, *map(chr, WS_CODE_POINTS), *"abé中\U0001f600​"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(2000)]
    texts += ["", None, " ", "...", "-" * 200_000, "a" + "-" * 200_000 + "b", "- " * 50_000 + "x" + " -" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert "lambda" not in str(T.tokens("t"))
    start = time.monotonic()
    got = {r["i"]: r["w"] for r in df.select("i", T.tokens("t").alias("w")).collect()}
    assert time.monotonic() - start < 20
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else [w for w in (x.strip(PUNCTUATION) for x in t.split()) if w])
