"""Stream scoring equals batch scoring of the same reviews."""

from __future__ import annotations

from tests.conftest import SF_CHECK
from veritext.plans import all_queries as A
from veritext.plans.catalog_lexicon import lexicon_params
from veritext.schemas import REVIEW_COLUMNS
from veritext.sources import tables as TB
from veritext.streaming import scoring as ST


def test_stream_equals_batch(spark):
    streamed = A.QUERIES["score_stream"](spark, SF_CHECK)
    batch, rejected = ST.score_reviews(TB.reviews_chat(spark, SF_CHECK).select(*REVIEW_COLUMNS),
                                       lexicon_params(spark))
    s = sorted(tuple(r) for r in streamed.select(*ST.SCORED_COLUMNS).collect())
    b = sorted(tuple(r) for r in batch.select(*ST.SCORED_COLUMNS).collect())
    assert len(s) == len(b) > 0
    assert s == b
    assert rejected.count() == 0


def test_rejects_go_to_their_own_table(spark):
    df = spark.createDataFrame([(1, "x", 5.0, None, "   "), (2, "x", 9.0, None, "fine text"),
                                (3, "x", None, None, "ok")], "review_id long, category string, "
                               "rating double, label string, text_ string")
    scored, rejected = ST.score_reviews(df, lexicon_params(spark))
    assert {r["review_id"]: r["reject_reason"] for r in rejected.collect()} == {1: "blank", 2: "rating"}
    assert [r["review_id"] for r in scored.collect()] == [3]
