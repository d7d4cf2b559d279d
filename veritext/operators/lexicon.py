"""Lexicon jobs: rule-based sentiment (H8, J3, W5) and word-class counts.

Plan (one pass over the text, one shuffle of one row per review):

1. per review, the token array, its copies shifted by one, two and three places (the look-back a
   negation or booster rule needs) and the position of the first contrast word are built with array
   functions: no window, no sort;
2. ``posexplode_outer`` turns the zipped arrays into token rows (a review without tokens keeps one
   null row); the rules are plain row expressions from there on;
3. the token rows are left-joined to one merged ``(term, valence, tag)`` table;
4. one ``groupBy`` per input row (numbered before the explode, so two deliveries of one review stay two
   rows): partial aggregation collapses each review's tokens to one row
   inside the task, so the shuffle moves one small row per review whatever the text length.

Negation, booster and contrast words are parameters of any length: they become ``IN`` lists, which Spark
looks up by hash (boosters: one list per distinct strength). The lexicons are joins; the planner broadcasts
them while they are small and shuffles them beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.constants import (BOOSTER_DAMPING, CONTRAST_AFTER, CONTRAST_BEFORE,
                                EXCLAMATION_INCREMENT, EXCLAMATION_MAX, NEGATION_SCALAR,
                                NORMALIZATION_ALPHA, TAG_FEATURES)
from veritext.functions import text as T
from veritext.session import cut_lineage


def with_tokens(df: DataFrame, text_col: str = "cleaned_text") -> DataFrame:
    return df.withColumn("tokens", T.tokens(text_col))


def merged_lexicon(lexicon: DataFrame | None, tag_lexicon: DataFrame | None) -> DataFrame:
    """One row per term with its valence and tag, so text is read and joined once for both jobs. A term
    listed with different valences keeps the highest, with different tags the last by name.

    A union and one ``groupBy(term)`` (partial aggregation, one shuffle) rather than a full outer
    join: a term listed twice still yields one row, so no token is ever counted twice.
    """
    parts = []
    if lexicon is not None:
        parts.append(lexicon.select("term", F.col("valence").cast("double"),
                                    F.lit(None).cast("string").alias("tag")))
    if tag_lexicon is not None:
        parts.append(tag_lexicon.select("term", F.lit(None).cast("double").alias("valence"),
                                        F.col("tag").cast("string")))
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (u.filter(F.col("term").isNotNull())
             .groupBy("term").agg(F.max("valence").alias("valence"), F.max("tag").alias("tag")))


def prepared_lexicon(lexicon: DataFrame | None, tag_lexicon: DataFrame | None) -> DataFrame:
    """The merged lexicon built once and checkpointed, for reuse across many jobs (a stream's
    micro-batches): each use then skips the merge."""
    return cut_lineage(merged_lexicon(lexicon, tag_lexicon))


def suffix_tag(term: Column, rules: list[tuple[int, str, str]]) -> Column:
    """H13 fallback: the first rule (by priority) whose suffix ends the term, else null."""
    expr = F.lit(None).cast("string")
    for _, suffix, tag in sorted(rules, key=lambda r: r[0], reverse=True):
        expr = F.when(term.endswith(suffix), F.lit(tag)).otherwise(expr)
    return expr


def _shifted(toks: Column, k: int) -> Column:
    """The token array moved right by ``k`` (``k`` leading nulls, same length)."""
    n = F.size(toks)
    pad = F.array(*[F.lit(None).cast("string")] * k)
    return F.slice(F.concat(pad, toks), 1, n)


def _first_position(toks: Column, words: list[str]) -> Column:
    """1-based position of the first token in ``words``; 0 when none occurs."""
    if not words:
        return F.lit(0)
    return F.coalesce(F.array_position(F.transform(toks, lambda t: t.isin(*words)), True), F.lit(0))


def compound(s: Column, hits: Column, n_excl: Column) -> Column:
    """The sum of a review's valences, raised by exclamation marks and brought into -1..1; 0.0 without a hit."""
    amp = F.least(n_excl, F.lit(EXCLAMATION_MAX)) * EXCLAMATION_INCREMENT
    s = F.when(s > 0, s + amp).when(s < 0, s - amp).otherwise(s)
    return F.when(hits == 0, F.lit(0.0)).otherwise(
        F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + NORMALIZATION_ALPHA))), 4))


def lexicon_scores(df: DataFrame, lexicon: DataFrame | None = None,
                   negations: list[str] = (), boosters: dict[str, float] | None = None,
                   contrast: list[str] = ("but",), tag_lexicon: DataFrame | None = None,
                   suffix_rules: list[tuple[int, str, str]] = (), keep: list[str] = (),
                   text_col: str = "cleaned_text", merged: DataFrame | None = None) -> DataFrame:
    """Sentiment compound and VERB/ADV/NOUN counts per review, in one token pass.

    ``keep``: review-level columns carried through the aggregation (scalars; grouped on).
    ``merged``: a ``prepared_lexicon`` to use instead of merging ``lexicon`` and ``tag_lexicon``.
    The neighbours a rule looks at travel with each token as shifted copies of the token array
    (``arrays_zip``), so the rules are plain row expressions after the explode: no lambda, no window.
    """
    negations, boosters, contrast = list(negations), dict(boosters or {}), list(contrast)
    lex = merged if merged is not None else merged_lexicon(lexicon, tag_lexicon)
    by_strength: dict[float, list[str]] = {}
    for w, d in boosters.items():
        by_strength.setdefault(float(d), []).append(w)

    toks = F.col("tokens")
    split = with_tokens(df, text_col).select("review_id", text_col, *keep, "tokens")
    base = split.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", "review_id", *keep,
        (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("!"), F.lit("")))).alias("n_excl"),
        _first_position(toks, contrast).alias("contrast_pos"),
        F.arrays_zip(toks.alias("term"), _shifted(toks, 1).alias("p1"), _shifted(toks, 2).alias("p2"),
                     _shifted(toks, 3).alias("p3")).alias("tok"),
    )
    rows = base.select("_row", "review_id", *keep, "n_excl", "contrast_pos",
                       F.posexplode_outer("tok").alias("pos0", "t"))
    rows = rows.select("_row", "review_id", *keep, "n_excl", "contrast_pos", (F.col("pos0") + 1).alias("pos"),
                       F.col("t.term").alias("term"), F.col("t.p1").alias("p1"),
                       F.col("t.p2").alias("p2"), F.col("t.p3").alias("p3"))
    joined = rows.join(lex, "term", "left")

    def is_neg(p):
        return F.coalesce(F.col(p).isin(*negations), F.lit(False)) if negations else F.lit(False)

    def boost(p):
        expr = F.lit(0.0)
        for d, listed in by_strength.items():
            expr = F.when(F.col(p).isin(*listed), F.lit(d)).otherwise(expr)
        return expr

    # one column per rule step: each step reads the previous one several times, and separate
    # projections keep every step computed once per token; tokens without a valence need no look-back
    cp, v = F.col("contrast_pos"), F.col("valence")
    scored = (joined
              .withColumn("_neg", v.isNotNull() & (is_neg("p1") | is_neg("p2") | is_neg("p3")))
              .withColumn("_b", F.when(v.isNotNull(), boost("p1") * BOOSTER_DAMPING[0] + boost("p2") * BOOSTER_DAMPING[1]
                                       + boost("p3") * BOOSTER_DAMPING[2]))
              .withColumn("_v1", v + F.when(v < 0, -F.col("_b")).otherwise(F.col("_b")))
              .withColumn("_v2", F.when(F.col("_neg"), F.col("_v1") * NEGATION_SCALAR)
                                  .otherwise(F.col("_v1")))
              .withColumn("_v", F.when((cp > 0) & (F.col("pos") < cp), F.col("_v2") * CONTRAST_BEFORE)
                                 .when((cp > 0) & (F.col("pos") > cp), F.col("_v2") * CONTRAST_AFTER)
                                 .otherwise(F.col("_v2")))
              .withColumn("_tag", F.coalesce(F.col("tag"), suffix_tag(F.col("term"), list(suffix_rules)))))

    agg = scored.groupBy("_row", "review_id", *keep, "n_excl").agg(
        F.sum("_v").alias("_s"),
        F.count(F.col("valence")).alias("_hits"),
        *[F.count_if(F.col("_tag") == t).cast("bigint").alias(t) for t in TAG_FEATURES],
    )
    score = compound(F.col("_s"), F.col("_hits"), F.col("n_excl"))
    return agg.select("review_id", *keep, score.alias("sentiment_score"), *TAG_FEATURES)


def sentiment(df: DataFrame, lexicon: DataFrame, negations=(), boosters=None, contrast=("but",),
              text_col: str = "cleaned_text") -> DataFrame:
    """H8: ``(review_id, sentiment_score)``; 0.0 when no token is in the lexicon."""
    return lexicon_scores(df, lexicon, negations, boosters, contrast, text_col=text_col).select(
        "review_id", "sentiment_score")


def pos_counts(df: DataFrame, tag_lexicon: DataFrame, suffix_rules=(),
               text_col: str = "cleaned_text") -> DataFrame:
    """``(review_id, VERB, ADV, NOUN)``, absent tags 0."""
    return lexicon_scores(df, None, tag_lexicon=tag_lexicon, suffix_rules=suffix_rules,
                          text_col=text_col).select("review_id", *TAG_FEATURES)
