"""Scans of the provided parquet tables and the review stand-in views built on them.

The views are the Spark side of the definitions in ``FIXTURES.md``; the SQL side lives in
``veritext.plans.sql``. Column order of every view: review_id, category, rating, label, text_.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.schemas import REVIEW_COLUMNS

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _importable(spark: SparkSession) -> None:
    """Local workers find the package from any working folder; a cluster ships or installs it."""
    if spark.sparkContext.master.startswith("local["):
        spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a provided table, read in place. ``veritext.scan.partitions`` (unset by default) deals
    the rows of every scan to that many partitions: a setting for tables stored in one row group,
    which no scan setting can split."""
    _importable(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get("veritext.scan.partitions", None)
    return df.repartition(int(parts)) if parts else df


def _label_of_quality(q) -> F.Column:
    return F.when(q == 1, F.lit("OR")).when(q == 0, F.lit("CG"))


def documents_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as reviews without the label column (no join yet)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("category"),
        (F.col("doc_id") % 5 + 1).cast("double").alias("rating"),
        F.col("text").alias("text_"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("review_id"), _label_of_quality(F.col("quality")).alias("label"))


def attach_labels(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Left join of the label table on ``review_id``.

    The label table is three integers per row; the planner broadcasts it while its statistics are
    under ``spark.sql.autoBroadcastJoinThreshold`` and falls back to a sort-merge join beyond that
    (AQE may still convert at run time). Callers attach labels after reducing text to scalars, so a
    shuffle, when it happens, moves numbers rather than documents.
    """
    return df.join(doc_labels(spark, sf_dir), "review_id", "left")


def reviews_docs(spark: SparkSession, sf_dir: str,
                 before_labels: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``documents`` LEFT JOIN ``labels`` as reviews; ``before_labels`` runs on the label-free side."""
    base = documents_unlabelled(spark, sf_dir)
    if before_labels is not None:
        return attach_labels(spark, sf_dir, before_labels(base))
    out = attach_labels(spark, sf_dir, base)
    return out.select(*REVIEW_COLUMNS)


#: Ids of one conversation's turns: more than any conversation can hold.
TURNS = 1 << 32


def reviews_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations``: user turns are human (OR), assistant turns machine (CG), any
    other turn has no label."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("review_id"),
        F.lit("chat").alias("category"),
        (F.col("turn") % 5 + 1).cast("double").alias("rating"),
        F.when(F.col("role") == "user", F.lit("OR")).when(F.col("role") == "assistant", F.lit("CG")).alias("label"),
        F.col("text").alias("text_"),
    )


def reviews_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as unlabelled reviews (exercises tag and link removal)."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("review_id"),
        F.lit("unknown").alias("category"),
        F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("string").alias("label"),
        F.concat(F.col("html"), F.lit(" "), F.col("url")).alias("text_"),
    )
