"""Registered queries, part 9: stream scoring."""

from __future__ import annotations

from veritext.plans.catalog_lexicon import lexicon_params
from veritext.plans.catalog_metrics import _HYB
from veritext.plans.registry import query
from veritext.plans.sql import with_views
from veritext.plans.sql_lexicon import lexicon_ctes
from veritext.schemas import REVIEW_COLUMNS
from veritext.session import scratch_path
from veritext.sources import tables as TB
from veritext.streaming import native as NT
from veritext.streaming import scoring as ST


def stage_arrivals(spark, sf, parts: int = 4) -> str:
    """Write the chat reviews as ``parts`` parquet files: the stream's arriving input."""
    src = scratch_path(spark, "arrivals")
    TB.reviews_chat(spark, sf).select(*REVIEW_COLUMNS).repartition(parts, "review_id").write.parquet(src)
    return src


# The stream's output equals the batch verdict over the same reviews: the oracle scores the chat
# reviews in SQL (clean-up, features, lexicon rules, both closed-form scores, blend, flag).
_STREAM_SQL = (with_views("features_chat") + lexicon_ctes("features_chat") + """
, score_table AS (
  SELECT f.review_id, a.sentiment_score,
         round(1.0 / (1.0 + exp(-(4.0 * punctuation_ct / greatest(char_length, 1) - 0.1))), 6) AS p_tree,
         round(1.0 / (1.0 + exp(-(((word_count % 17) - 8) / 4.0))), 6) AS p_text
  FROM features_chat f JOIN lexagg a ON f.review_id = a.review_id)
""" + _HYB + """
SELECT h.review_id, label_tree, confidence_tree, label_text, confidence_text, final_score, final_label,
       confidence, confidence < 0.7 AS is_uncertain, st.sentiment_score
FROM h JOIN score_table st ON h.review_id = st.review_id""")


@query("score_stream", _STREAM_SQL)
def q_score_stream(spark, sf):
    src = stage_arrivals(spark, sf)
    sink, rejects, ckpt = (scratch_path(spark, n) for n in ("scored", "rejected", "stream-ckpt"))
    q = ST.start_scoring(spark, src, sink, rejects, ckpt, lexicon_params(spark))
    q.awaitTermination()
    return ST.read_scored(spark, sink)


@query("score_stream_native", _STREAM_SQL)
def q_score_stream_native(spark, sf):
    """The plan on the stream itself; a second run with every file delivered again adds no row."""
    src = stage_arrivals(spark, sf)
    sink, ckpt = (scratch_path(spark, n) for n in ("scored", "stream-ckpt"))
    params = lexicon_params(spark)
    NT.start(spark, src, sink, ckpt, params).awaitTermination()
    spark.read.parquet(src).write.mode("append").parquet(src)  # all deliveries come again, in new files
    NT.start(spark, src, sink, ckpt, params).awaitTermination()
    return NT.read(spark, sink)[0]
