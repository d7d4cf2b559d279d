"""Continuous scoring of arriving reviews (R1, S9, S12) with Structured Streaming.

``readStream`` (declared schema) -> ``foreachBatch``: each micro-batch runs exactly the batch code
path (checks, clean-up, features, lexicon join, scores, blend) -> parquet sink, one directory per
batch id written with ``overwrite``, so a replayed batch (after a failure) replaces its own output
instead of duplicating it. The checkpoint lives in shared storage, so the query resumes after a
driver or executor loss. No streaming state is kept: every review is scored on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.operators import features as FE
from veritext.operators import lexicon as LX
from veritext.operators import models as MO
from veritext.operators import rejects as RJ
from veritext.operators import scoring as SC
from veritext.operators.featurize import featurize
from veritext.schemas import REVIEWS

SCORED_COLUMNS = ["review_id", "label_tree", "confidence_tree", "label_text", "confidence_text",
                  "final_score", "final_label", "confidence", "is_uncertain", "sentiment_score"]


def score_reviews(df: DataFrame, lexicon_params: dict, models: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Batch scoring of raw reviews: (scored accepted rows, rejected rows with reason). ``models``: a
    fitted (tree, text) pair; without it the closed-form scores stand in."""
    checked = RJ.with_reject_reason(df)
    rejected = RJ.rejected(checked).select("review_id", "reject_reason")
    ok = FE.with_defaults(RJ.accepted(checked))
    p = lexicon_params
    f = featurize(ok, p["lexicon"], p["tag_lexicon"], p["negations"], p["boosters"], p["contrast"],
                  p["suffix_rules"], keep_extra=["cleaned_text"] if models else [], merged=p.get("merged"))
    if models:
        scored = SC.hybrid(MO.score_both(f, *models))
    else:
        scored = SC.hybrid(SC.score_table(f.withColumn("label", F.lit(None).cast("string")),
                                          keep=["sentiment_score"]))
    return scored.select(*SCORED_COLUMNS), rejected


def batch_writer(sink: str, reject_sink: str, lexicon_params: dict,
                 models: tuple | None = None) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()  # one micro-batch feeds two writes
        try:
            scored, rejected = score_reviews(b, lexicon_params, models)
            scored.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
            rejected.write.mode("overwrite").parquet(f"{reject_sink}/batch_id={batch_id}")
        finally:
            b.unpersist()
    return write


def start_scoring(spark: SparkSession, source: str, sink: str, reject_sink: str, checkpoint: str,
                  lexicon_params: dict, max_files_per_trigger: int | None = None,
                  max_bytes_per_trigger: str | None = None, available_now: bool = True,
                  model_paths: tuple[str, str] | None = None):
    """Start the scoring stream over parquet files arriving in ``source``. A micro-batch takes all files
    there are, unless a trigger limit is given. ``model_paths``: saved tree and text pipelines."""
    models = tuple(MO.load_model(p) for p in model_paths) if model_paths else None
    # the parameter lexicons are merged once for the whole stream
    lexicon_params = dict(lexicon_params, merged=LX.prepared_lexicon(lexicon_params["lexicon"],
                                                                     lexicon_params["tag_lexicon"]))
    reader = spark.readStream.schema(REVIEWS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    stream = reader.parquet(source)
    w = (stream.writeStream.foreachBatch(batch_writer(sink, reject_sink, lexicon_params, models))
               .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_scored(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("batch_id")
