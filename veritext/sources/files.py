"""File sources and sinks (S1-S5, S11): CSV with declared schema and charset, JSON contract and
run tables. Writers go to shared storage (``spark.checkpoint.dir`` on a cluster); readers have a declared
schema (``veritext.sources.infer`` reads CSV of unknown types).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',  # RFC 4180 doubling, as pandas writes it
    "multiLine": "true",  # reviews contain line breaks
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with an explicit schema and charset (``encoding='ISO-8859-1'``...)."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("encoding", encoding).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> str:
    """S3: header CSV without an index column (there is none in Spark)."""
    df.write.mode(mode).options(**CSV_OPTIONS).option("encoding", encoding).csv(path)
    return path


def write_reviews(df: DataFrame, path: str, partition_by: str | None = "category",
                  mode: str = "overwrite") -> str:
    """Default sink for processed reviews: parquet, partitioned by category for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def replace_categories(df: DataFrame, path: str, partition_by: str = "category") -> str:
    """Writes the partitions that ``df`` has rows of, and leaves all others of the folder as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines (one record per row)."""
    df.write.mode(mode).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON with a declared schema; ``multi_line`` for whole-file documents."""
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)
