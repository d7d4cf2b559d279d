"""A training-data pipeline over ``documents``: one operator of ``veritext.llm`` per stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns the columns
of ``documents``; the last returns the encoded documents. ``run`` writes each stage as Parquet to the
shared folder and reads it again as the next one's input, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import bpe, lines, mixing, quality, simhash
from veritext.llm.common import table, written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie beyond a fence of their language and source go."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in their first document; n_chars follows the text."""
    kept = lines.dedup(docs, count_col=None).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest id."""
    return simhash.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): ids of each text, and whether they decode to it."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", digest, "text"), VOCABULARY)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup),
          ("mixing", source_mix), ("byte-level bpe", byte_bpe)]

#: SimHash and BPE have no SQL form; tests/llm holds run() against a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
