"""Row-level feature operators (P1-P4, P6, P15, H5-H7, H12, H14). Each is ``DataFrame -> DataFrame``.

All of them are projections or filters: no shuffle, no Python worker, one whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.constants import DEFAULT_CATEGORY, DEFAULT_RATING, LABEL_MAP, NUMERIC_FEATURES
from veritext.functions import text as T


def with_clean_text(df: DataFrame, src: str = "text_", dst: str = "cleaned_text") -> DataFrame:
    """H1-H4, one projection per step.

    Each step's guard and regex both read the previous step; as separate columns every step is
    computed once per row (Catalyst does not inline a non-trivial column used more than once),
    where one nested expression would repeat the inner steps in every branch.
    """
    steps = [("_ct_lower", T.lower_text(F.coalesce(F.col(src), F.lit("")))),
             ("_ct_tags", T.remove_tags("_ct_lower")),
             ("_ct_links", T.remove_links("_ct_tags")),
             (dst, T.strip_ws("_ct_links"))]
    for name, expr in steps:
        df = df.withColumn(name, expr)
    return df.drop("_ct_lower", "_ct_tags", "_ct_links")


def text_features(df: DataFrame, text_col: str = "cleaned_text", pieces_col: str | None = None) -> DataFrame:
    """P2 / P6 / H5-H7 over cleaned text (cleaning first when the column is missing). ``pieces_col``: added
    column of the text's white-space pieces, for callers that use them again."""
    if text_col not in df.columns:
        df = with_clean_text(df, dst=text_col)
    if pieces_col:
        df = df.withColumn(pieces_col, T.ws_pieces(text_col))
    return df.withColumns({
        "char_length": T.char_length(text_col),
        "word_count": T.word_count(text_col, F.col(pieces_col) if pieces_col else None),
        "punctuation_ct": T.punctuation_count(text_col),
        "is_extreme_star": T.is_extreme_star("rating"),
    })


def raw_lengths(df: DataFrame) -> DataFrame:
    """H5-H6 over the raw review (profile stage); keeps ``label`` when present."""
    keep = ["review_id"] + (["label"] if "label" in df.columns else [])
    return df.select(
        *keep,
        T.char_length(F.coalesce(F.col("text_"), F.lit(""))).alias("char_length"),
        T.word_count(F.coalesce(F.col("text_"), F.lit(""))).alias("word_count"),
    )


def label_map(df: DataFrame, src: str = "label", dst: str = "y") -> DataFrame:
    """OR -> 1, CG -> 0, anything else -> null."""
    expr = F.lit(None).cast("int")
    for name, value in LABEL_MAP.items():
        expr = F.when(F.col(src) == name, F.lit(value)).otherwise(expr)
    return df.withColumn(dst, expr.cast("int"))


def numeric_block(df: DataFrame, include_sentiment: bool = False) -> DataFrame:
    """The numeric feature block, keyed. ``rating`` cast to double, booleans kept."""
    cols = [c for c in NUMERIC_FEATURES if include_sentiment or c != "sentiment_score"]
    return df.select("review_id", *cols)


def drop_empty(df: DataFrame, text_col: str = "cleaned_text", label_col: str = "label") -> DataFrame:
    """Text and label only, rows with a null in either dropped ('' counts as null)."""
    return (df.select("review_id", F.nullif(F.col(text_col), F.lit("")).alias(text_col), label_col)
              .dropna(subset=[text_col, label_col]))


def with_defaults(df: DataFrame) -> DataFrame:
    """Rating 5.0 and category ``unknown`` where absent."""
    return df.withColumns({
        "rating": F.coalesce(F.col("rating"), F.lit(DEFAULT_RATING)),
        "category": F.coalesce(F.col("category"), F.lit(DEFAULT_CATEGORY)),
    })
