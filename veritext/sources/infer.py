"""CSV of unknown types (S1): every row takes part in the inference, and malformed rows are kept apart.

Types form a lattice, long < double < text and boolean < text; a column's type is the least one that all its
values have (empty ones have any; a column without values is text). It comes from one aggregate of mergeable
flags over all rows of the raw text columns, so it does not depend on which rows come first. A row whose
number of fields is not that of the header is malformed: it takes no part and goes to the rejects, as read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.session import scratch_path
from veritext.sources.files import CSV_OPTIONS

CORRUPT = "_corrupt_record"
_LONG = r"^[+-]?[0-9]{1,18}$"
_DOUBLE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$"
_BOOLEAN = r"^([tT]rue|[fF]alse|TRUE|FALSE)$"


def raw_csv(spark: SparkSession, path: str, names: list[str], header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, and the whole record of malformed rows."""
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(CORRUPT, T.StringType())])
    options = {**CSV_OPTIONS, "header": str(header).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
               "encoding": encoding, "enforceSchema": "true"}
    return spark.read.schema(schema).options(**options).csv(path)


def _all(c: str, pattern: str) -> Column:
    return F.coalesce(F.bool_and(F.col(c).rlike(pattern)), F.lit(False))


def inferred(raw: DataFrame, names: list[str]) -> dict[str, str]:
    """The type of each column: one row of flags comes back, whatever the table."""
    good = raw.filter(F.col(CORRUPT).isNull())
    flags = good.agg(*(f.alias(f"{i}_{k}") for i, c in enumerate(names) for k, f in (
        ("long", _all(c, _LONG)), ("double", _all(c, _DOUBLE)), ("boolean", _all(c, _BOOLEAN))))).first()
    kinds = (("long", "bigint"), ("double", "double"), ("boolean", "boolean"))
    return {c: next((t for k, t in kinds if flags[f"{i}_{k}"]), "string") for i, c in enumerate(names)}


def read_csv_inferred(spark: SparkSession, path: str, names: list[str], header: bool = True,
                      encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects): rejects have the record as read and the reason ``malformed``."""
    parsed = raw_csv(spark, path, names, header, encoding)
    kept = scratch_path(spark, "parsed-csv")  # the file is parsed once, for the inference and for both results
    parsed.write.parquet(kept)
    raw = spark.read.schema(parsed.schema).parquet(kept)
    types = inferred(raw, names)
    typed = raw.filter(F.col(CORRUPT).isNull()).select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))
    rejects = raw.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"), F.lit("malformed").alias("reject_reason"))
    return typed, rejects
