"""Token encoding for the text model (J8, H10, H11): ids, special tokens, truncation, padding.

The reference's sub-word tokenizer is re-aimed as a word vocabulary table. Truncation to the
model's 512 positions is part of the encoder's definition (the model has 512 positions); cleaning
and tokenizing always run on the whole text.

Plan: tokens beyond the 510 that fit are dropped *before* exploding, so each review contributes at
most 510 token rows; the planner broadcasts the vocabulary while it is small and shuffles it beyond that;
one ``groupBy`` per input row (numbered before the explode, so two deliveries of one review stay two rows)
puts the ids back in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.constants import BATCH_SIZE, CLS_ID, MAX_SEQ_LEN, PAD_ID, SEP_ID, UNK_ID
from veritext.functions import text as T
from veritext.session import scratch_path


def token_ids(df: DataFrame, vocab: DataFrame, text_col: str = "cleaned_text",
              max_len: int = MAX_SEQ_LEN) -> DataFrame:
    """``(review_id, ids)``: vocabulary ids of the first ``max_len - 2`` tokens, UNK for misses."""
    base = df.select("review_id", F.monotonically_increasing_id().alias("_row"),
                     F.slice(T.tokens(text_col), 1, max_len - 2).alias("t"))
    rows = base.select("_row", "review_id", F.posexplode_outer("t").alias("pos", "term"))
    v = vocab.select("term", F.col("id").cast("int").alias("id"))
    j = rows.join(v, "term", "left")
    item = F.when(F.col("pos").isNotNull(),
                  F.struct("pos", F.coalesce(F.col("id"), F.lit(UNK_ID)).alias("id")))
    g = j.groupBy("_row", "review_id").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    return g.select("review_id", F.transform("_p", lambda x: x["id"]).alias("ids"))


def with_specials(ids) -> F.Column:
    return F.concat(F.array(F.lit(CLS_ID)), ids, F.array(F.lit(SEP_ID)))


def pad_to(arr, length, value) -> F.Column:
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(length - F.size(arr), F.lit(0))))


def encode_fixed(ids: DataFrame, max_len: int = MAX_SEQ_LEN) -> DataFrame:
    """``[CLS] ids [SEP]`` padded with PAD to ``max_len``; mask 1 for real positions."""
    seq = with_specials(F.col("ids"))
    ones = F.array_repeat(F.lit(1), F.size(seq))
    return ids.select("review_id",
                      pad_to(seq, F.lit(max_len), PAD_ID).alias("input_ids"),
                      pad_to(ones, F.lit(max_len), 0).alias("attention_mask"))


def batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``df`` with ``batch_id``: rows numbered in ``order`` (ties in no particular order), ``size`` at a time.

    No task sees more than its range of the order: rows are sorted by ranges, a range's rows are numbered
    where they are, and the running sum of the ranges' counts (one row per partition) gives the offsets.
    """
    spark = df.sparkSession
    # the unique last column lets a range end inside a run of equal keys
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "batches")
    ranged = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")
    at = F.monotonically_increasing_id()  # partition number above bit 33, row of the partition below
    ranged.drop("_tie").select("*", F.shiftright(at, 33).alias("_part"),
                               at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = rows.join(offsets, F.col("_part") == F.col("_p"))
    return numbered.withColumn("batch_id", F.expr(f"(_off + _place) div {size}")).drop("_p", "_off", "_part", "_place")


def encode_dynamic(ids: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Batches of ``batch_size`` reviews in id order, each padded to its longest sequence (the collator's
    ``padding=True``)."""
    d = batches(ids.select("review_id", with_specials(F.col("ids")).alias("_seq")), batch_size, ["review_id"])
    d = d.withColumn("_n", F.max(F.size("_seq")).over(Window.partitionBy("batch_id")))  # batch_size rows each
    ones = F.array_repeat(F.lit(1), F.size("_seq"))
    return d.select("review_id", "batch_id",
                    pad_to(F.col("_seq"), F.col("_n"), PAD_ID).alias("input_ids"),
                    pad_to(ones, F.col("_n"), 0).alias("attention_mask"))
