"""Sentiment and word classes against a brute-force Python statement of the same rules."""

from __future__ import annotations

import math

import pytest

from tests.conftest import SF_SMALL
from tests.test_text import py_clean, py_tokens
from veritext.constants import (BOOSTER_DAMPING, CONTRAST_AFTER, CONTRAST_BEFORE,
                                EXCLAMATION_INCREMENT, EXCLAMATION_MAX, NEGATION_SCALAR,
                                NORMALIZATION_ALPHA, TAG_FEATURES)
from veritext.operators import lexicon as LX
from veritext.plans.catalog_lexicon import cleaned_docs
from veritext.sources import fixtures as FX
from veritext.sources import tables as TB


def py_sentiment(text, lexicon, negations, boosters, contrast):
    toks = py_tokens(text)
    cpos = min((i + 1 for i, t in enumerate(toks) if t in contrast), default=0)
    s, hits = 0.0, 0
    for i, t in enumerate(toks):
        if t not in lexicon:
            continue
        hits += 1
        v = lexicon[t]
        prev = [toks[i - k] if i - k >= 0 else None for k in (1, 2, 3)]
        b = sum(boosters.get(p, 0.0) * d for p, d in zip(prev, BOOSTER_DAMPING))
        v = v + (-b if v < 0 else b)
        if any(p in negations for p in prev if p is not None):
            v *= NEGATION_SCALAR
        pos = i + 1
        if cpos > 0 and pos < cpos:
            v *= CONTRAST_BEFORE
        elif cpos > 0 and pos > cpos:
            v *= CONTRAST_AFTER
        s += v
    if hits == 0:
        return 0.0
    amp = min(text.count("!"), EXCLAMATION_MAX) * EXCLAMATION_INCREMENT
    s = s + amp if s > 0 else (s - amp if s < 0 else s)
    return max(-1.0, min(1.0, s / math.sqrt(s * s + NORMALIZATION_ALPHA)))


def py_tags(text, tag_lexicon, rules):
    counts = dict.fromkeys(TAG_FEATURES, 0)
    for t in py_tokens(text):
        tag = tag_lexicon.get(t)
        if tag is None:
            for _, suffix, g in sorted(rules):
                if t.endswith(suffix):
                    tag = g
                    break
        if tag in counts:
            counts[tag] += 1
    return counts


@pytest.fixture(scope="module")
def docs(spark):
    rows = TB.documents_unlabelled(spark, SF_SMALL).select("review_id", "text_").collect()
    return {r["review_id"]: py_clean(r["text_"] or "") for r in rows}


def test_sentiment_equals_brute_force(spark, docs):
    got = LX.sentiment(cleaned_docs(spark, SF_SMALL), FX.lexicon_df(spark), FX.NEGATIONS,
                       dict(FX.BOOSTERS), FX.CONTRAST).collect()
    assert len(got) == len(docs)
    lex, boosters = dict(FX.LEXICON), dict(FX.BOOSTERS)
    nonzero = 0
    for r in got:
        want = py_sentiment(docs[r["review_id"]], lex, set(FX.NEGATIONS), boosters, set(FX.CONTRAST))
        assert abs(r["sentiment_score"] - want) <= 5e-5 + 1e-12, (r["review_id"], r["sentiment_score"], want)
        nonzero += r["sentiment_score"] != 0.0
    assert nonzero > len(docs) // 2  # the fixture lexicon fires on most documents


def test_rules_fire_on_a_handmade_text(spark):
    text = "the movie was not the best but with and le! it is the end"
    df = spark.createDataFrame([(1, text)], "review_id long, cleaned_text string")
    lex = {"the": 0.5, "best": 3.0, "with": 2.25, "le": 1.0, "end": -0.5}
    got = LX.sentiment(df, spark.createDataFrame(list(lex.items()), "term string, valence double"),
                       ["not"], {"is": 0.293}, ["but"]).collect()[0]["sentiment_score"]
    want = py_sentiment(text, lex, {"not"}, {"is": 0.293}, {"but"})
    assert abs(got - want) <= 5e-5 and got != 0.0


def test_pos_counts_equal_brute_force(spark, docs):
    got = LX.pos_counts(cleaned_docs(spark, SF_SMALL), FX.tag_lexicon_df(spark), FX.SUFFIX_RULES).collect()
    tl = dict(FX.TAG_LEXICON)
    total = 0
    for r in got:
        want = py_tags(docs[r["review_id"]], tl, FX.SUFFIX_RULES)
        assert {t: r[t] for t in TAG_FEATURES} == want, r["review_id"]
        total += sum(want.values())
    assert total > 0


def test_empty_text_keeps_its_row(spark):
    df = spark.createDataFrame([(1, ""), (2, "the end")], "review_id long, cleaned_text string")
    got = {r["review_id"]: r for r in LX.lexicon_scores(
        df, FX.lexicon_df(spark), FX.NEGATIONS, dict(FX.BOOSTERS), FX.CONTRAST, FX.tag_lexicon_df(spark),
        FX.SUFFIX_RULES).collect()}
    assert set(got) == {1, 2}
    assert got[1]["sentiment_score"] == 0.0 and got[1]["VERB"] == 0


def test_lexicon_beyond_the_broadcast_bound_joins_by_shuffle(spark, docs):
    """Above the planner's bound the lexicon is not broadcast; the result is the same."""
    c = cleaned_docs(spark, SF_SMALL)
    args = (FX.lexicon_df(spark), FX.NEGATIONS, dict(FX.BOOSTERS), FX.CONTRAST)
    want = sorted(tuple(r) for r in LX.sentiment(c, *args).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = LX.sentiment(c, *args)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert got == want


def test_duplicate_lexicon_terms_count_once(spark):
    df = spark.createDataFrame([(1, "the cat and the dog")], "review_id long, cleaned_text string")
    once = spark.createDataFrame([("the", 0.5), ("and", 1.5)], "term string, valence double")
    twice = once.unionByName(spark.createDataFrame([("the", 0.5)], "term string, valence double"))
    a = LX.sentiment(df, once).collect()[0]["sentiment_score"]
    b = LX.sentiment(df, twice).collect()[0]["sentiment_score"]
    assert a == b != 0.0


def test_two_deliveries_of_one_review_stay_two_rows(spark):
    one = spark.createDataFrame([(7, "and so it is")], "review_id long, cleaned_text string")
    lex = FX.lexicon_df(spark)
    single = [r["sentiment_score"] for r in LX.sentiment(one, lex).collect()]
    twice = [r["sentiment_score"] for r in LX.sentiment(one.unionByName(one), lex).collect()]
    assert single[0] != 0.0 and twice == single * 2


def test_word_lists_of_any_length(spark):
    df = spark.createDataFrame([(1, "w19999 and"), (2, "other and")], "review_id long, cleaned_text string")
    many = [f"w{i}" for i in range(20_000)]
    got = {r["review_id"]: r["sentiment_score"] for r in LX.sentiment(df, FX.lexicon_df(spark), many).collect()}
    assert got[1] < 0 < got[2]
