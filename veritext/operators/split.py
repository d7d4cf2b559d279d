"""Reproducible splits and folds (M10, W1-W3) without a global sort.

Every row gets a seeded hash ``h = md5(review_id || ':' || seed)`` (hex). The hash split (M10) is a
threshold on its first 8 hex digits: a projection, no shuffle, identical in any SQL engine.

An exact-size or stratified split needs one row's rank only, that of the cut (``split_exact``).
Stratified folds need each row's *rank* in hash order within its label. A global ``row_number`` would pull a whole label (possibly a third of the table) into one
task. Instead:

1. count rows per ``(stratum, bucket)``, bucket = first ``bucket_digits`` hex digits of ``h``
   (partial aggregation; the result has at most strata x 16^digits rows);
2. a running sum over that small table gives each bucket's offset within its stratum;
3. rows join their bucket's offset and rank only *inside* their bucket (window partitioned by
   stratum and bucket: many small, evenly filled partitions because the hash is uniform; only narrow
   key columns are shuffled);
4. rank = offset + rank in bucket. The order is (h, review_id), the same total order as the SQL
   ``row_number() OVER (PARTITION BY stratum ORDER BY h, review_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


TEST_HASH_CUT = "33333333"  # 0x33333333 / 16^8 = 0.2


def seeded_hash(key: str = "review_id", seed: int = 42) -> F.Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def split_hash(df: DataFrame, seed: int = 42, key: str = "review_id",
               cut: str = TEST_HASH_CUT) -> DataFrame:
    """``split`` = test when the hash prefix is below the cut (about 20 %), else train."""
    h8 = F.substring(seeded_hash(key, seed), 1, 8)
    return df.withColumn("split", F.when(h8 < F.lit(cut), F.lit("test")).otherwise(F.lit("train")))


def hash_rank(df: DataFrame, strata: list[str], seed: int = 42, key: str = "review_id",
              bucket_digits: int = 4) -> DataFrame:
    """Adds ``rank`` (1-based, per stratum, hash order) and ``stratum_n`` without a global window."""
    h = df.withColumn("_h", seeded_hash(key, seed)) \
          .withColumn("_b", F.substring("_h", 1, bucket_digits))
    counts = h.groupBy(*strata, "_b").agg(F.count("*").alias("_cnt"))
    w = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(s).alias(f"_o_{s}") for s in strata], F.col("_b").alias("_o_b"),
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*strata)).alias("stratum_n"),
    )
    # Null-safe: a null label is a stratum. The planner broadcasts the offsets while they are small.
    cond = [F.col("_b") == F.col("_o_b")] + [F.col(s).eqNullSafe(F.col(f"_o_{s}")) for s in strata]
    joined = h.join(offsets, cond, "inner").drop("_o_b", *[f"_o_{s}" for s in strata])
    in_bucket = Window.partitionBy(*strata, "_b").orderBy("_h", key)
    return joined.withColumn("rank", F.col("_off") + F.row_number().over(in_bucket)) \
                 .drop("_h", "_b", "_off")


def split_exact(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, strata: list[str] = (),
                key: str = "review_id", bucket_digits: int = 4) -> DataFrame:
    """Exactly ``ceil(fraction * n)`` test rows per stratum, the first ones in hash order.

    Counts per (stratum, hash bucket) give the bucket that the cut falls into, and only that bucket's keys
    are ranked, to find the cut itself. The split is then a comparison with the cut of the row's stratum:
    the rows of ``df`` are not moved. One cut per stratum comes to the driver (strata are label values).
    """
    strata = list(strata)
    names = [f"_s{i}" for i in range(len(strata))]
    h = seeded_hash(key, seed)
    keys = df.select(*(F.col(s).alias(n) for s, n in zip(strata, names)), F.col(key).alias("_key"), h.alias("_h"))
    keys = keys.withColumn("_b", F.substring("_h", 1, bucket_digits))
    counts = keys.groupBy(*names, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*names, "_b", "_n", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
                           F.ceil(F.sum("_n").over(Window.partitionBy(*names)) * F.lit(test_fraction)).alias("_want"))
    edge = counts.filter((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") >= F.col("_want")))
    edge = edge.select(*(F.col(n).alias(f"{n}_e") for n in names), F.col("_b").alias("_edge"),
                       (F.col("_want") - F.col("_before")).alias("_left"))
    same = [F.col("_b") == F.col("_edge"), *(F.col(n).eqNullSafe(F.col(f"{n}_e")) for n in names)]
    rank = F.row_number().over(Window.partitionBy(*names, "_b").orderBy("_h", "_key"))
    cuts = (keys.join(edge, same).withColumn("_rank", rank).filter(F.col("_rank") == F.col("_left"))
            .select(*names, "_h", "_key").collect())
    test = F.lit(False)
    for cut in cuts:
        here = (h < cut["_h"]) | ((h == cut["_h"]) & (F.col(key) <= cut["_key"]))
        for s, n in zip(strata, names):
            here = here & F.col(s).eqNullSafe(F.lit(cut[n]))
        test = test | here
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def fold_assign(df: DataFrame, k: int = 5, seed: int = 42, strata: list[str] = ("y",),
                key: str = "review_id") -> DataFrame:
    """Stratified k folds, ``fold = (rank - 1) % k``; fold sizes differ by at most one per stratum."""
    r = hash_rank(df, list(strata), seed, key)
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "stratum_n")
