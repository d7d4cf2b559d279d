"""Scoring as a plan on the stream itself (R1, S9, S12): no ``foreachBatch``.

``readStream`` -> de-duplication of deliveries -> input checks, clean-up, features -> lexicon rules in array
form -> scores, blend, flag -> one file sink. Everything after the de-duplication is stateless, row by row:
the rules that the batch path computes over exploded tokens and one ``groupBy`` run here over each review's
token array in an Arrow UDF, with the lexicons as dictionaries of a checked size. A trained pair of models is
applied by ``PipelineModel.transform`` on the stream.

A review that is delivered again within ``DELAY`` (same id, a replayed file, a retried producer) adds no row:
its id is kept in watermarked state, in the state store of the checkpoint. The sink's log makes every
micro-batch appear once. Accepted and rejected reviews share the sink; ``reject_reason`` tells them apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.constants import BOOSTER_DAMPING, CONTRAST_AFTER, CONTRAST_BEFORE, NEGATION_SCALAR, TAG_FEATURES
from veritext.functions import text as T
from veritext.operators import features as FE
from veritext.operators import lexicon as LX
from veritext.operators import models as MO
from veritext.operators import rejects as RJ
from veritext.operators import scoring as SC
from veritext.schemas import REVIEWS
from veritext.streaming.scoring import SCORED_COLUMNS

DELAY = "1 day"
#: Terms of the lexicons together that are sent to the tasks; larger ones need the joins of ``scoring``.
MOST_TERMS = 500_000
_RULES = "s double, hits long, " + ", ".join(f"{t} long" for t in TAG_FEATURES)


def token_rules(spark: SparkSession, params: dict):
    """The lexicon rules as an Arrow UDF over a token array: sum of valences, hits and tag counts."""
    merged = LX.merged_lexicon(params["lexicon"], params["tag_lexicon"])
    n = merged.limit(MOST_TERMS + 1).count()
    if n > MOST_TERMS:
        raise ValueError(f"the lexicons have more than {MOST_TERMS} terms: score by veritext.streaming.scoring")
    lexicon = {r["term"]: (r["valence"], r["tag"]) for r in merged.collect()}  # at most MOST_TERMS rows
    negations, boosters = set(params["negations"]), dict(params["boosters"] or {})
    contrast = set(params["contrast"])
    suffixes = [(suffix, tag) for _, suffix, tag in sorted(params["suffix_rules"], key=lambda r: r[0])]

    def one(tokens) -> tuple:
        at = next((i for i, t in enumerate(tokens) if t in contrast), -1)
        total, hits, tags = 0.0, 0, dict.fromkeys(TAG_FEATURES, 0)
        for i, t in enumerate(tokens):
            valence, tag = lexicon.get(t, (None, None))
            if tag is None:
                tag = next((g for suffix, g in suffixes if t.endswith(suffix)), None)
            if tag in tags:
                tags[tag] += 1
            if valence is None:
                continue
            hits += 1
            before = [tokens[i - k] for k in (1, 2, 3) if i >= k]
            boost = sum(boosters.get(p, 0.0) * d for p, d in zip(before, BOOSTER_DAMPING))
            v = valence - boost if valence < 0 else valence + boost
            if any(p in negations for p in before):
                v *= NEGATION_SCALAR
            if at >= 0 and i != at:
                v *= CONTRAST_BEFORE if i < at else CONTRAST_AFTER
            total += v
        return (total, hits, *(tags[t] for t in TAG_FEATURES))

    @F.pandas_udf(_RULES)
    def rules(tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in tokens], columns=["s", "hits", *TAG_FEATURES])

    return rules


def with_lexicon(df: DataFrame, rules, text_col: str = "cleaned_text") -> DataFrame:
    """``df`` with sentiment_score and the tag counts, without moving a row."""
    text = F.col(text_col)
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    d = df.withColumn("_rules", rules(T.tokens(text_col))).withColumn("_marks", marks)
    compound = LX.compound(F.col("_rules.s"), F.col("_rules.hits"), F.col("_marks"))
    return d.withColumns({"sentiment_score": compound, **{t: F.col(f"_rules.{t}") for t in TAG_FEATURES}}).drop(
        "_rules", "_marks")


def scored(reviews: DataFrame, rules, models: tuple | None = None, delay: str = DELAY) -> DataFrame:
    """(review_id, reject_reason, verdict columns) of a stream or table of reviews, each id once."""
    once = (reviews.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", delay)
            .dropDuplicatesWithinWatermark(["review_id"]) if reviews.isStreaming
            else reviews.dropDuplicates(["review_id"]))
    checked = RJ.with_reject_reason(once)
    f = with_lexicon(FE.text_features(FE.with_defaults(checked)), rules)
    if models:
        out = SC.hybrid(MO.score_both(f, *models))
    else:
        out = SC.hybrid(SC.score_table(f.withColumn("label", F.lit(None).cast("string")),
                                       keep=["sentiment_score", "reject_reason"]))
    ok: Column = F.col("reject_reason").isNull()
    return out.select("review_id", "reject_reason", *(F.when(ok, F.col(c)).alias(c) for c in SCORED_COLUMNS[1:]))


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, params: dict,
          model_paths: tuple[str, str] | None = None, available_now: bool = True, delay: str = DELAY):
    """Starts the scoring of parquet files arriving in ``source``."""
    models = tuple(MO.load_model(p) for p in model_paths) if model_paths else None
    arriving = spark.readStream.schema(REVIEWS).parquet(source)
    w = scored(arriving, token_rules(spark, params), models, delay).writeStream.format("parquet").outputMode(
        "append").option("path", sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    """(scored rows, rejected rows with reason) of a sink."""
    rows = spark.read.parquet(sink)
    return (rows.filter("reject_reason IS NULL").select(*SCORED_COLUMNS),
            rows.filter("reject_reason IS NOT NULL").select("review_id", "reject_reason"))
