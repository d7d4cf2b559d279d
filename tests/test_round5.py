"""Texts are split once and hashed once, with the same results as one test per character."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritext.constants import PUNCTUATION, WS_CODE_POINTS
from veritext.functions import text as T
from veritext.operators import features as FE
from veritext.operators import models as MO


def test_runs_split_at_white_space_only(spark):
    points = [c for c in [*range(0x3100), 0xFEFF, 0x1F600] if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}b{chr(c)}{chr(c)}c") for c in points], "c int, t string")
    got = df.select("c", F.size(T.ws_pieces("t")).alias("n"), T.punctuation_count("t").alias("p")).collect()
    assert {r["c"] for r in got if r["n"] == 3} == set(WS_CODE_POINTS)
    assert {r["n"] for r in got} == {1, 3}
    assert {r["c"] for r in got if r["p"] == 3} == set(map(ord, PUNCTUATION))
    assert {r["p"] for r in got} == {0, 3}


def test_pieces_give_the_same_counts_and_tokens(spark):
    texts = ["", " ", None, "a", " (a) b- - c ", "...", "x y\x1f!"]
    df = spark.createDataFrame([(i, t, 5.0) for i, t in enumerate(texts)], "review_id int, text_ string, rating double")
    alone = FE.text_features(df)
    shared = FE.text_features(df, pieces_col="p")
    assert shared.select(alone.columns).collect() == alone.collect()
    pairs = shared.select(T.tokens("cleaned_text").alias("a"), T.tokens("cleaned_text", F.col("p")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in pairs)


def test_text_model_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    rows = [(float(i % 2), f"w{i % 3} {'good' if i % 2 else 'bad'}") for i in range(40)]
    df = spark.createDataFrame(rows, "y double, cleaned_text string")
    model = MO.fit_text(df.withColumn("cleaned_text", seen("cleaned_text")), num_features=64)
    assert read.value == 40
    assert all(r["prediction"] == r["y"] for r in model.transform(df).collect())


def test_rows_with_texts_are_kept_by_column(spark):
    cols = {c: F.lit(1) for c in MO.BASE_FEATURES}
    df = spark.createDataFrame([(1, 1, "a"), (2, None, "b")], "review_id int, y int, cleaned_text string").withColumns(cols)
    kept = MO.prepared(df, texts=True)
    assert kept.inputFiles() and kept.collect() == MO.prepared(df).collect()
