"""Token encoding by row, and batches of a fixed size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veritext.constants import CLS_ID, PAD_ID, SEP_ID, UNK_ID
from veritext.operators import encode as EN

VOCAB = [("hello", 1000), ("world", 1001)]


def vocab(spark):
    return spark.createDataFrame(VOCAB, "term string, id int")


def test_a_review_delivered_twice_stays_two_rows(spark):
    rows = [(1, "hello world"), (1, "hello world"), (1, "world"), (2, ""), (None, "hello there"), (None, "")]
    df = spark.createDataFrame(rows, "review_id long, cleaned_text string").repartition(3)
    got = sorted((str(r["review_id"]), r["ids"]) for r in EN.token_ids(df, vocab(spark)).collect())
    assert got == sorted([("1", [1000, 1001]), ("1", [1000, 1001]), ("1", [1001]), ("2", []), ("None", [1000, UNK_ID]),
                          ("None", [])])
    fixed = EN.encode_fixed(EN.token_ids(df, vocab(spark)), 6).filter("review_id = 1").collect()
    assert len(fixed) == 3 and all(len(r["input_ids"]) == len(r["attention_mask"]) == 6 for r in fixed)


@pytest.mark.parametrize("hot", [False, True])
def test_batches_of_a_fixed_size(spark, hot):
    n = 203
    ids = [(7 if hot and i % 3 else i, [1000] * (i % 11)) for i in range(n)]  # hot: two thirds share an id
    df = spark.createDataFrame(ids, "review_id long, ids array<int>").repartition(5)
    got = EN.encode_dynamic(df, 8).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["batch_id"], []).append(r)
    assert sorted(by) == list(range(26)) and [len(by[b]) for b in sorted(by)] == [8] * 25 + [3]
    low = [min(r["review_id"] for r in by[b]) for b in sorted(by)]
    high = [max(r["review_id"] for r in by[b]) for b in sorted(by)]
    assert all(h <= n for h, n in zip(high, low[1:]))  # in id order
    for rows in by.values():
        assert len({len(r["input_ids"]) for r in rows}) == 1
        longest = max(sum(r["attention_mask"]) for r in rows)
        assert {len(r["input_ids"]) for r in rows} == {longest}
        for r in rows:
            real = sum(r["attention_mask"])
            assert r["input_ids"][0] == CLS_ID and r["input_ids"][real - 1] == SEP_ID
            assert r["input_ids"][real:] == [PAD_ID] * (longest - real)


def test_batches_of_nothing(spark):
    df = spark.createDataFrame([], "review_id long, ids array<int>")
    assert EN.encode_dynamic(df).collect() == []
    assert EN.batches(df.select("review_id", F.lit(1).alias("x")), 8, ["review_id"]).columns == ["review_id", "x", "batch_id"]
