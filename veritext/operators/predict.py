"""Python plug-in operators (F1, F2, F4, S8): Arrow-batched, never row-at-a-time.

* ``apply_plugin``: a user's pandas function over a column as a scalar ``pandas_udf``;
* ``map_batches``: a batched table function as ``mapInPandas``;
* ``batch_predict``: a preloaded model per Python worker via ``predict_batch_udf``: the model
  factory runs once per worker process and is reused for every batch; ``shipped_factory`` loads a saved one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.constants import PUNCTUATION


def apply_plugin(fn: Callable[[pd.Series], pd.Series], return_type: str) -> Callable[..., Column]:
    """wrap a pandas Series -> Series function as a vectorized UDF."""
    return F.pandas_udf(fn, return_type)


def digit_count(s: pd.Series) -> pd.Series:
    """Example plug-in: ASCII digits per text."""
    return s.fillna("").str.count(r"[0-9]").astype("int64")


_PUNCT_RE = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"


def python_text_stats(batches: Iterator[pd.DataFrame], text_col: str = "cleaned_text") -> Iterator[pd.DataFrame]:
    """F2 body: the reference's per-row Python definitions, applied per Arrow batch."""
    for pdf in batches:
        t = pdf[text_col].fillna("")
        yield pd.DataFrame({
            "review_id": pdf["review_id"],
            "char_length": t.str.len().astype("int64"),
            "word_count": t.str.split().str.len().astype("int64"),
            "punctuation_ct": t.str.count(_PUNCT_RE).astype("int64"),
        })


def map_batches(df: DataFrame, fn=python_text_stats,
                schema: str = "review_id bigint, char_length bigint, word_count bigint, punctuation_ct bigint"
                ) -> DataFrame:
    """batched table function over Arrow record batches."""
    return df.mapInPandas(fn, schema)


# ---- F4 / S8 -------------------------------------------------------------------------------------

LOGISTIC_WEIGHTS = (0.001, -0.01, 0.05)
LOGISTIC_BIAS = -0.2


def numpy_logistic_factory(weights=LOGISTIC_WEIGHTS, bias=LOGISTIC_BIAS):
    """A model factory: returns ``predict(batch) -> [p(class 0), p(class 1)]`` per row."""
    def make_predict_fn():
        w = np.asarray(weights, dtype=np.float64)  # 'loaded' once per Python worker

        def predict(x: np.ndarray) -> np.ndarray:
            z = x[:, 0] * w[0] + x[:, 1] * w[1] + x[:, 2] * w[2] + bias
            p = 1.0 / (1.0 + np.exp(-z))
            return np.stack([1.0 - p, p], axis=1)
        return predict
    return make_predict_fn


def save_weights(spark: SparkSession, path: str, weights=LOGISTIC_WEIGHTS, bias=LOGISTIC_BIAS) -> str:
    """S7 for a Python model: its numbers as one JSON row in the shared folder."""
    spark.createDataFrame([(list(weights), float(bias))], "weights array<double>, bias double").coalesce(1).write.mode(
        "overwrite").json(path)
    return path


def shipped_factory(spark: SparkSession, path: str):
    """A factory whose model is read from a saved folder. Its part file is a file of the session, copied
    to each executor once; each Python worker loads it once, when it makes its predict function.

    The file is shipped, not the folder: Spark ships no local folder from a cluster's driver."""
    part = spark.read.text(path).select("_metadata.file_path").first()[0]
    spark.sparkContext.addFile(part)
    name = part.rsplit("/", 1)[-1]  # has an id of its own, so that no two models share a name

    def make_predict_fn():
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            saved = json.loads(f.readline())
        return numpy_logistic_factory(saved["weights"], saved["bias"])()
    return make_predict_fn


def batch_predict(df: DataFrame, inputs: list[str], make_predict_fn=None, batch_size: int = 1024,
                  out: str = "probability") -> DataFrame:
    """``out`` = ARRAY<DOUBLE> probability pair from a per-worker model over Arrow batches."""
    make_predict_fn = make_predict_fn or numpy_logistic_factory()
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                            batch_size=batch_size, input_tensor_shapes=[[len(inputs)]])
    return df.withColumn(out, udf(F.array(*[F.col(c).cast("double") for c in inputs])))
