"""Registered queries, part 2: tokens and the lexicon jobs (sentiment, word classes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritext.operators import features as FE
from veritext.operators import lexicon as LX
from veritext.operators import tagger as TG
from veritext.plans.registry import query
from veritext.plans.sql import tokens_sql, with_views
from veritext.plans.sql_lexicon import lexicon_ctes
from veritext.sources import fixtures as FX
from veritext.sources import tables as TB


def cleaned_docs(spark, sf):
    return TB.documents_unlabelled(spark, sf).transform(FE.with_clean_text)


def lexicon_params(spark):
    return dict(lexicon=FX.lexicon_df(spark), negations=FX.NEGATIONS, boosters=dict(FX.BOOSTERS),
                contrast=FX.CONTRAST, tag_lexicon=FX.tag_lexicon_df(spark),
                suffix_rules=FX.SUFFIX_RULES)


@query("tokens", with_views("features_docs") + f"""
SELECT review_id, CAST(len(t) AS BIGINT) AS n_tokens, t AS tokens
FROM (SELECT review_id, {tokens_sql('cleaned_text')} AS t FROM features_docs)""")
def q_tokens(spark, sf):
    t = LX.with_tokens(cleaned_docs(spark, sf))
    return t.select("review_id", F.size("tokens").cast("bigint").alias("n_tokens"), "tokens")


@query("sentiment", with_views("features_docs") + lexicon_ctes()
       + "SELECT review_id, sentiment_score FROM lexagg")
def q_sentiment(spark, sf):
    p = lexicon_params(spark)
    return LX.sentiment(cleaned_docs(spark, sf), p["lexicon"], p["negations"], p["boosters"],
                        p["contrast"])


@query("pos_counts", with_views("features_docs") + lexicon_ctes()
       + 'SELECT review_id, "VERB", "ADV", "NOUN" FROM lexagg')
def q_pos_counts(spark, sf):
    p = lexicon_params(spark)
    return LX.pos_counts(cleaned_docs(spark, sf), p["tag_lexicon"], p["suffix_rules"])


@query("hmm_tags")
def q_hmm_tags(spark, sf):
    """H13 / J4 by context: word classes of every review by a hidden Markov model of all reviews."""
    p = lexicon_params(spark)
    return TG.tagged(cleaned_docs(spark, sf), p["tag_lexicon"], p["suffix_rules"])
