"""Input checks (P5, P16): rows failing a check get a reason instead of raising."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.functions import text as T


def is_blank(text_col: str = "text_") -> F.Column:
    """P5: Python ``not text.strip()`` (null counts as blank)."""
    return F.coalesce(T.strip_ws(text_col), F.lit("")) == ""


def rating_ok(rating_col: str = "rating", lo: float = 1.0, hi: float = 5.0) -> F.Column:
    """The form's 1..5 domain; a null rating takes the default, so it passes."""
    r = F.col(rating_col)
    return r.isNull() | r.between(lo, hi)


def with_reject_reason(df: DataFrame, text_col: str = "text_", rating_col: str | None = "rating") -> DataFrame:
    """First failing check wins: ``blank``, then ``rating``; null when the row is accepted."""
    reason = F.when(is_blank(text_col), F.lit("blank"))
    if rating_col is not None:
        reason = reason.when(~rating_ok(rating_col), F.lit("rating"))
    return df.withColumn("reject_reason", reason)


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())
