"""Helpers the corpus operators share: words, table scans, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.session import scratch_path
from veritext.sources.tables import table  # noqa: F401  (re-exported for the operators' queries)

#: Separators of words: ASCII white space only. ``bytes.split()`` uses the same set.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), "")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (no repeated evaluation)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps restart from the files."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which a side is broadcast on purpose, after its rows are counted.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast hint for a written table of rows of at most ``row_bytes``; beyond BROADCAST_BYTES the
    join stays a shuffle join, whose skew adaptive execution splits."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: Bits of one piece of a bitmap, as Spark's bitmap functions make them.
PIECE_BITS = 1 << 15


def bitmap(df: DataFrame, bit_col: str, bits: int) -> DataFrame:
    """(bucket, map): a bitmap of the numbers of ``bit_col`` (0 to 2**bits - 1), in pieces of 4 KB: whatever the
    rows, at most 2**(bits - 15) pieces."""
    return df.groupBy(F.expr(f"{bit_col} div {PIECE_BITS}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col(bit_col) % PIECE_BITS).alias("map"))


def bit_is_set(df: DataFrame, pieces: DataFrame, bit_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: whether the bit of ``bit_col`` is set in a bitmap of fixed size, which is broadcast."""
    piece = pieces.select(F.col("bucket").alias("_bucket"), F.col("map").alias("_map"))
    place = F.col(bit_col) % PIECE_BITS
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.expr(f"({bit_col} % {PIECE_BITS}) div 8") + 1).cast("int"), F.lit(1))), 16, 10)
    flag = F.expr("shiftright(_byte, _shift)").bitwiseAND(F.lit(1)) == 1
    joined = df.join(F.broadcast(piece), F.expr(f"{bit_col} div {PIECE_BITS}") == F.col("_bucket"), "left")
    joined = joined.withColumn("_byte", byte.cast("int")).withColumn("_shift", (place % 8).cast("int"))
    return joined.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_bucket", "_map", "_byte", "_shift")
