"""Registered queries, part 6: token encoding and the Python plug-in operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritext.constants import BATCH_SIZE, CLS_ID, MAX_SEQ_LEN, PAD_ID, SEP_ID, UNK_ID
from veritext.operators import encode as EN
from veritext.operators import features as FE
from veritext.operators import predict as PD
from veritext.plans.registry import query
from veritext.plans.sql import _q, clean_sql, tokens_sql, with_views
from veritext.session import scratch_path
from veritext.sources import fixtures as FX
from veritext.sources import tables as TB

_VOCAB_SQL = ", vocab(term, id) AS (VALUES " + ", ".join(
    f"({_q(t)}, {1000 + i})" for i, t in enumerate(FX.VOCAB_TERMS)) + ")"
_IDS_SQL = with_views("reviews_chat") + _VOCAB_SQL + f"""
, tk AS (SELECT review_id, list_slice({tokens_sql(clean_sql('text_'))}, 1, {MAX_SEQ_LEN - 2}) AS t
         FROM reviews_chat),
r AS (SELECT review_id, pos, t[pos] AS term FROM tk, unnest(generate_series(1, len(t))) AS g(pos)),
ids0 AS (SELECT r.review_id, list(CAST(coalesce(v.id, {UNK_ID}) AS INT) ORDER BY r.pos) AS ids
         FROM r LEFT JOIN vocab v ON r.term = v.term GROUP BY r.review_id),
ids AS (SELECT tk.review_id, coalesce(ids0.ids, CAST([] AS INT[])) AS ids
        FROM tk LEFT JOIN ids0 ON tk.review_id = ids0.review_id),
sq AS (SELECT review_id, list_concat([CAST({CLS_ID} AS INT)], ids, [CAST({SEP_ID} AS INT)]) AS seq FROM ids)
"""


def chat_ids(spark, sf):
    chat = TB.reviews_chat(spark, sf).transform(FE.with_clean_text)
    return EN.token_ids(chat, FX.vocab_df(spark))


@query("encode_tokens", _IDS_SQL + f"""
SELECT review_id, list_resize(seq, {MAX_SEQ_LEN}, {PAD_ID}) AS input_ids,
       list_resize(list_transform(seq, lambda x: CAST(1 AS INT)), {MAX_SEQ_LEN}, 0) AS attention_mask
FROM sq""")
def q_encode_tokens(spark, sf):
    return EN.encode_fixed(chat_ids(spark, sf))


@query("pad_to_longest", _IDS_SQL + f"""
SELECT review_id, batch_id, list_resize(seq, n, {PAD_ID}) AS input_ids,
       list_resize(list_transform(seq, lambda x: CAST(1 AS INT)), n, 0) AS attention_mask
FROM (SELECT *, max(len(seq)) OVER (PARTITION BY batch_id) AS n FROM
      (SELECT *, (row_number() OVER (ORDER BY review_id) - 1) // {BATCH_SIZE} AS batch_id FROM sq))""")
def q_pad_to_longest(spark, sf):
    return EN.encode_dynamic(chat_ids(spark, sf))


# ---- F1 / F2 / F4 --------------------------------------------------------------------------------

@query("map_batches", with_views("features_docs") + """
SELECT review_id, char_length, word_count, punctuation_ct FROM features_docs""")
def q_map_batches(spark, sf):
    docs = TB.documents_unlabelled(spark, sf).transform(FE.with_clean_text).select("review_id", "cleaned_text")
    return PD.map_batches(docs)


@query("apply_plugin", with_views("reviews_docs") + """
SELECT review_id, CAST(length(regexp_replace(coalesce(text_, ''), '[^0-9]', '', 'g')) AS BIGINT) AS digit_count
FROM reviews_docs""")
def q_apply_plugin(spark, sf):
    udf = PD.apply_plugin(PD.digit_count, "bigint")
    return TB.documents_unlabelled(spark, sf).select("review_id", udf("text_").alias("digit_count"))


_W = PD.LOGISTIC_WEIGHTS


@query("batch_predict", with_views("features_docs") + f"""
SELECT review_id, [round(1.0 - p, 6), round(p, 6)] AS probability
FROM (SELECT review_id, 1.0 / (1.0 + exp(-(
        CAST(char_length AS DOUBLE) * CAST({_W[0]!r} AS DOUBLE)
        + CAST(word_count AS DOUBLE) * CAST({_W[1]!r} AS DOUBLE)
        + CAST(punctuation_ct AS DOUBLE) * CAST({_W[2]!r} AS DOUBLE)
        + CAST({PD.LOGISTIC_BIAS!r} AS DOUBLE)))) AS p
      FROM features_docs)""")
def q_batch_predict(spark, sf):
    """The model's weights are saved, shipped and loaded by each worker."""
    f = TB.documents_unlabelled(spark, sf).transform(FE.text_features)
    model = PD.shipped_factory(spark, PD.save_weights(spark, scratch_path(spark, "logistic-model")))
    out = PD.batch_predict(f, ["char_length", "word_count", "punctuation_ct"], model)
    return out.select("review_id", F.transform("probability", lambda x: F.round(x, 6)).alias("probability"))
