"""Profile stage (T1, A1-A3, A5): first rows, null counts, label counts, box-plot statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.session import cut_lineage


def head(df: DataFrame, n: int = 5, key: str = "review_id") -> DataFrame:
    """Spark has no input order, so 'first' means smallest key. A top-n, not a full sort."""
    return df.orderBy(key).limit(n)


def null_counts(df: DataFrame) -> DataFrame:
    """A1: one aggregate pass, then unpivoted to (column_name, null_count)."""
    wide = df.select([F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "null_count")


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A2: counts per value, nulls excluded, most frequent first (ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias(name))
              .orderBy(F.desc(name), col))


#: Values per bin of the two-level running sum.
BIN = 1024


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """A5: quartiles (linear interpolation), whiskers at 1.5 IQR, outlier count, per group.

    Rows collapse to counts per (group, whole value) first, checkpointed, so the input is read once. A
    two-level running sum (totals per bin of values, then inside a bin) gives each value's ranks; the
    quartiles are the values at the ranks around them, and the fences are applied to the counts.
    """
    rows = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    counts = cut_lineage(rows.groupBy(by, F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_n")))
    counts = counts.withColumn("_bin", F.floor(F.col("_v") / BIN))
    bins = counts.groupBy(by, "_bin").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(by, "_bin", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"),
                       F.sum("_total").over(Window.partitionBy(by)).alias("n"))
    inside = Window.partitionBy(by, "_bin").orderBy("_v")
    ranked = counts.join(bins, [by, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def at(rank):  # value at a 0-based rank
        return F.min(F.when(F.col("_upto") > rank, F.col("_v"))).cast("double")

    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    place = {name: (F.col("n") - 1) * q for name, q in points.items()}
    near = ranked.groupBy(by).agg(F.max("n").alias("n"), *(
        e.alias(f"_{side}_{name}") for name, h in place.items()
        for side, e in (("lo", at(F.floor(h))), ("hi", at(F.ceil(h))))))
    quart = near.select(by, "n", *(
        (F.col(f"_lo_{name}") + (h - F.floor(h)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name)
        for name, h in place.items()))
    quart = (quart.withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
             .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    v = F.col("_v").cast("double")
    fits = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    second = counts.join(quart.select(by, "lower_fence", "upper_fence"), by).groupBy(by).agg(
        F.min(F.when(fits, v)).alias("whisker_low"), F.max(F.when(fits, v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~fits, F.col("_n"))), F.lit(0)).cast("bigint").alias("n_outliers"))
    return quart.join(second, by).withColumn("n", F.col("n").cast("bigint"))
