"""Category columns: sizes, custom keys, defaults before features."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritext.operators import features as FE
from veritext.operators import matrix as MX


def test_dummies_of_twenty_thousand_categories(spark):
    df = spark.range(20_000).select(F.col("id").alias("review_id"), F.concat(F.lit("c"), F.lpad("id", 5, "0")).alias("category"))
    made = MX.Pipeline(stages=MX.dummy_stages()).fit(df).transform(df)
    row = made.filter("review_id = 123").first()["_cat_vec"]
    assert row.size == 20_000 and list(row.indices) == [123]
    assert MX.fitted_categories(df).count() == 20_000


def test_unknown_and_null_categories_are_all_zeros(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "review_id long, category string")
    got = {r["review_id"]: r["dummies"] for r in MX.dummies(df).collect()}
    assert got == {1: [1, 0], 2: [0, 1], 3: [0, 0]}


def test_a_custom_key_is_applied_to_the_dictionary(spark):
    df = spark.createDataFrame([(1, "Books"), (2, "unknown")], "review_id long, category string")
    same = MX.conform(df, ["category_Books_5"], key=lambda n: f"category_{n}_5").collect()
    none = MX.conform(df, ["category_Books_5"], key=lambda n: f"category_{n.lower()}").collect()
    assert [r["category_Books_5"] for r in same] == [1.0, 0.0]
    assert [r["category_Books_5"] for r in none] == [0.0, 0.0]


def test_a_null_rating_counts_as_five_before_the_features(spark):
    df = spark.createDataFrame([(1, None, None, "x")], "review_id long, category string, rating double, text_ string")
    r = FE.text_features(FE.with_defaults(df)).first()
    assert r["rating"] == 5.0 and r["is_extreme_star"] and r["category"] == "unknown"
