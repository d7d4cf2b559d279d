"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed hash. A source's budget is met by a threshold on the hash: sizes are summed by
source and hash bucket (a bounded histogram), the running sum finds the bucket that the budget ends in,
and only the rows of that boundary bucket are split into finer buckets, until one hash value is left. Rows
of one id and text share a hash; where the budget ends among such rows, a second hash, of the row's place in
the table, is refined the same way, so that as many of them are taken as the budget allows (which ones makes
no difference). No rows are sorted. Repeats use nested thresholds: a target of 2.4 times the source takes every row
twice and the rows below the threshold for 0.4 a third time, so a larger target always contains a
smaller one.

Defined results: a null text has size 0; a null id hashes by its text alone; a null source is a source of
its own, the last; an empty table gives an empty result; a source of size 0 has target 0; long texts are
read whole. Other columns pass through, whatever their names; clashing output columns replace theirs.
``mixed_rows`` reads its table twice and takes for granted that a row has the same place both times, as in
a scan of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import broadcast_if_small, words, written

MOST_REPEATS = 3
HASH_BITS = 60
LEVEL_BITS = 12


def _hash(key, text) -> F.Column:
    """60 bits of the MD5 of key and text: the same in every engine and run."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"),
                            F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _tie() -> F.Column:
    """60 bits that tell rows of one hash apart."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)


def source_targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights 1, 2, 3, repeating by the
    source's code-point order (null last); a target stops at ``most`` times its source, the excess goes
    to the others by weight. One row per source: the two windows hold one row per source.

    Resharing by weight ends at min(cap, level * weight); sources enter the cap in order of
    cap / weight, so the level follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_w", (F.row_number().over(by_name) - 1) % 3 + 1)
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double")
             / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))).cast("double"))
    # sources up to the first one whose cap holds its share are capped; its level is everyone's after it
    leveled = ranked.withColumn("_level", level)
    open_ = leveled.withColumn("_free", F.col("_cap") >= F.col("_level") * F.col("_w"))
    common = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (open_.withColumn("_common", common)
            .select("source", "source_size",
                    F.when(F.col("_free"), F.col("_common") * F.col("_w"))
                    .otherwise(F.col("_cap").cast("double")).alias("target")))


def _boundary(rows: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """(source, at, budget, whole): the value of ``key`` in which a source's budget ends, what is left of the
    budget there, and the size of all its rows. ``rows``: (source, key, size); ``budgets``: (source, budget)."""
    found, inside, shift = None, rows, HASH_BITS
    left = budgets.select(F.col("source").alias("_src"), "budget")
    while shift > 0:
        shift = max(0, shift - LEVEL_BITS)
        bucket = F.shiftright(key, shift)
        table = inside.groupBy("source", bucket.alias("_b")).agg(
            F.sum("size").alias("_s"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        table = (table.withColumn("_before", F.coalesce(F.sum("_s").over(upto), F.lit(0)))
                 .join(left, F.col("source").eqNullSafe(F.col("_src"))))
        # the bucket in which the budget ends, and what is left of the budget there
        edge = table.filter((F.col("_before") <= F.col("budget"))
                            & (F.col("_before") + F.col("_s") > F.col("budget")))
        edge = written(edge.select("source", "_b", "_s", "_lo", "_hi",
                                   (F.col("budget") - F.col("_before")).alias("budget")), "mix-edge")
        done = edge.filter(F.col("_lo") == F.col("_hi")).select(
            "source", F.col("_lo").alias("at"), "budget", F.col("_s").alias("whole"))
        found = done if found is None else found.unionByName(done)
        open_ = edge.filter(F.col("_lo") < F.col("_hi")).select(F.col("source").alias("_src"), "_b", "budget")
        if open_.isEmpty():
            break
        inside = inside.join(open_, F.col("source").eqNullSafe(F.col("_src")) & (bucket == F.col("_b")), "left_semi")
        left = open_.select("_src", "budget")
    return found


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut, tie_cut): take the rows of a source whose hash is below ``cut``, and those at ``cut`` whose
    tie is below ``tie_cut``; their sizes come as near to the budget as whole rows allow. ``rows``: (source, h,
    tie, size); ``budgets``: (source, budget)."""
    first = written(_boundary(rows, budgets, "h"), "mix-boundary")
    at = first.select(F.col("source").alias("_src"), "at")
    inside = rows.join(at, F.col("source").eqNullSafe(F.col("_src")) & (F.col("h") == F.col("at")), "left_semi")
    last = _boundary(inside, first.select("source", "budget"), "tie")
    nearer = F.when(F.col("whole") - F.col("budget") < F.col("budget"), F.col("at") + 1).otherwise(F.col("at"))
    last = last.select(F.col("source").alias("_src"), nearer.alias("tie_cut"))
    return first.join(last, F.col("source").eqNullSafe(F.col("_src")), "left").select(
        "source", F.col("at").alias("cut"), F.coalesce("tie_cut", F.lit(0)).alias("tie_cut"))


def _copies(most: int) -> F.Column:
    """Copies of a row of (h, tie) under its source's plan (repeats, cut, tie_cut)."""
    taken = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (F.col("tie") < F.col("tie_cut")))
    return F.least(F.col("repeats") + F.when(taken, 1).otherwise(0), F.lit(most))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        most: int = MOST_REPEATS) -> DataFrame:
    """``df`` without its text, with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``)."""
    drop = ("size", "source_size", "target", "copies", text_col)
    others = [c for c in df.columns if c not in drop]
    row = F.struct(*(F.col(c) for c in others)) if others else F.struct(F.lit(0))
    rows = df.select(row.alias("row"), F.size(words(F.col(text_col))).cast("long").alias("size"),
                     _hash(F.col(id_col), F.col(text_col)).alias("h"), _tie().alias("tie"), F.col(source_col).alias("source"))
    rows = written(rows, "mix-sizes")  # narrow; the texts are read once
    plan = _plan(rows, most).withColumnRenamed("source", "of")
    mixed = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return mixed.select(*(F.col("row")[c].alias(c) for c in others), "size", "source_size", "target",
                        _copies(most).cast("long").alias("copies"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               most: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    keys = [_hash(F.col(id_col), F.col(text_col)).alias("h"), _tie().alias("tie"), F.col(source_col).alias("source")]
    rows = df.select(F.size(words(F.col(text_col))).cast("long").alias("size"), *keys)
    plan = written(_plan(written(rows, "mix-sizes"), most), "mix-plan").withColumnRenamed("source", "of")
    whole = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"), *keys)
    out = whole.join(broadcast_if_small(plan, 256), F.col("source").eqNullSafe(F.col("of")))
    out = out.select("row", _copies(most).cast("int").alias("copies")).filter("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns))


def _plan(rows: DataFrame, most: int) -> DataFrame:
    """(source, source_size, target, repeats, cut, tie_cut)."""
    narrow = rows.select("source", "h", "tie", "size")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, most), "mix-targets")
    whole = F.floor(F.col("target") / F.col("source_size"))
    parts = targets.withColumn("repeats", F.when(F.col("source_size") > 0, F.least(whole, F.lit(most))).otherwise(0))
    parts = parts.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    cuts = thresholds(narrow, parts.select("source", "budget")).withColumnRenamed("source", "_s")
    return (parts.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("source", "source_size", "target", F.col("repeats").cast("long").alias("repeats"),
                    F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("tie_cut", F.lit(0)).alias("tie_cut")))
