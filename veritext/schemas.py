"""Declared schemas (no inference anywhere) and the small dimension tables built from constants."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veritext.constants import CATEGORY_MAPPING, FEATURE_CONTRACT

REVIEW_COLUMNS = ["review_id", "category", "rating", "label", "text_"]

# Raw reviews as the reference reads them, plus our key.
REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("rating", T.DoubleType(), True),
    T.StructField("label", T.StringType(), True),
    T.StructField("text_", T.StringType(), True),
])

CONTRACT = T.StructType([
    T.StructField("position", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])

CATEGORY_DIM = T.StructType([
    T.StructField("display", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
])

_LOG_RECORD = T.StructType([
    T.StructField("epoch", T.DoubleType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("grad_norm", T.DoubleType()),
    T.StructField("eval_accuracy", T.DoubleType()),
    T.StructField("eval_f1", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("eval_precision", T.DoubleType()),
    T.StructField("eval_recall", T.DoubleType()),
    T.StructField("eval_runtime", T.DoubleType()),
    T.StructField("eval_samples_per_second", T.DoubleType()),
    T.StructField("eval_steps_per_second", T.DoubleType()),
])

RUN_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("best_metric", T.DoubleType()),
    T.StructField("best_model_checkpoint", T.StringType()),
    T.StructField("log_history", T.ArrayType(_LOG_RECORD)),
])
LOG_RECORD = _LOG_RECORD

RUN_METRICS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("test_auc_score", T.DoubleType()),
    T.StructField("num_features", T.IntegerType()),
    T.StructField("label_mapping", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("training_samples", T.LongType()),
    T.StructField("test_samples", T.LongType()),
])


def local_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A table of literal rows whose size the planner knows (a local relation, by way of Arrow), so joins
    with it are broadcast from the start."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [[] for _ in wanted.fields]
    table = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, wanted.fields)],
                     names=wanted.names)
    return spark.createDataFrame(table, wanted)


def contract_df(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    names = names or FEATURE_CONTRACT
    return local_table(spark, list(enumerate(names)), CONTRACT)


def category_dim(spark: SparkSession) -> DataFrame:
    return local_table(spark, CATEGORY_MAPPING, CATEGORY_DIM)
