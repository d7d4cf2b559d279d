"""Model training and evaluation with Spark ML.

Every estimator is a ``pyspark.ml`` stage; fitting runs as distributed jobs over the checkpointed
feature table. Model outputs have no SQL oracle, so the metric operators stay separate
(``veritext.operators.metrics``) and are applied to the scored rows.
"""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.constants import NUMERIC_FEATURES, TAG_FEATURES
from veritext.functions.text import WS_RUN_PATTERN
from veritext.operators.matrix import dummy_stages
from veritext.session import cut_lineage, written

BASE_FEATURES = NUMERIC_FEATURES + TAG_FEATURES


def matrix_stages(features: list[str] = BASE_FEATURES, category_col: str = "category") -> list:
    """A13 + M8 as estimators: the sparse dummy block and one assembled vector."""
    asm = VectorAssembler(inputCols=list(features) + ["_cat_vec"], outputCol="features", handleInvalid="error")
    return [*dummy_stages(category_col), asm]


def prepared(df: DataFrame, features: list[str] = BASE_FEATURES, label: str = "y", texts: bool = False) -> DataFrame:
    """Numeric casts and labelled rows only, checkpointed to the shared folder before the iterative fits:
    an executor lost during the training jobs costs a re-read, not a re-run of clean-up and lexicon joins.
    The estimators keep what they iterate over in memory themselves, and release it. ``texts``: the rows hold
    texts, which passes over the numbers are not to read: written by column."""
    cols = {c: F.col(c).cast("double") for c in features}
    rows = df.filter(F.col(label).isNotNull()).withColumns(cols).withColumn(label, F.col(label).cast("double"))
    return written(rows, "prepared") if texts else cut_lineage(rows)


def gbt(max_iter: int = 100, max_depth: int = 4, seed: int = 42, step_size: float = 0.1,
        label: str = "y", **kw) -> GBTClassifier:
    """M1: boosted trees with log loss (the reference: 100 trees, depth 4, seed 42)."""
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                         stepSize=step_size, seed=seed, lossType="logistic", **kw)


def fit_trees(train: DataFrame, features: list[str] = BASE_FEATURES, **gbt_args) -> PipelineModel:
    return Pipeline(stages=matrix_stages(features) + [gbt(**gbt_args)]).fit(train)


def positive_probability(scored: DataFrame, out: str = "p_pos") -> DataFrame:
    """Column 1 of the probability vector."""
    return scored.withColumn(out, vector_to_array("probability")[1])


def score(model: PipelineModel, df: DataFrame, keep: list[str] = ("review_id", "y")) -> DataFrame:
    """M2: class and positive-class probability per row."""
    s = positive_probability(model.transform(df))
    return s.select(*keep, F.col("prediction").cast("int").alias("pred"), "p_pos")


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the assembled vector's slots, from the ML attribute metadata."""
    meta = model.transform(df.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in meta.values() for a in group)
    return [n.replace("_cat_vec_", "category_", 1) for _, n in slots]


def gain_importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Normalized gain importance per slot (sums to 1)."""
    imp = model.stages[-1].featureImportances.toArray()
    return [(n, float(v)) for n, v in zip(names, imp)]


_SPLIT = re.compile(r"If \(feature (\d+) ")


def split_counts(model: PipelineModel, names: list[str]) -> list[tuple[str, int]]:
    """Number of splits on each slot over all trees (the importance plot's default)."""
    counts = [0] * len(names)
    for tree in model.stages[-1].trees:
        for m in _SPLIT.finditer(tree.toDebugString):
            counts[int(m.group(1))] += 1
    return list(zip(names, counts))


def saved_split_counts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A12 from the saved form: (feature, splits) of the tree stage's node rows, those without a split left out."""
    nodes = spark.read.parquet(f"{path}/stages/*GBTClassifier*/data").select("nodeData.split.featureIndex")
    slot = F.get(F.array(*(F.lit(n) for n in names)), F.col("featureIndex")).alias("feature")
    return nodes.filter("featureIndex >= 0").groupBy(slot).agg(F.count(F.lit(1)).alias("splits"))


def fit_text(train: DataFrame, text_col: str = "cleaned_text", num_features: int = 1 << 18,
             max_iter: int = 50, reg: float = 0.01) -> PipelineModel:
    """M6 re-aimed: word tokens -> hashed term frequencies -> IDF -> logistic regression.

    Frequencies are written once: the two estimators pass over them three times, and would split and hash every
    text each time."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=WS_RUN_PATTERN, toLowercase=True)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    counts = written(tf.transform(tok.transform(train.select("y", text_col))).select("y", "_tf"), "term-counts")
    idf = IDF(inputCol="_tf", outputCol="features").fit(counts)
    lr = LogisticRegression(featuresCol="features", labelCol="y", maxIter=max_iter, regParam=reg)
    return PipelineModel([tok, tf, idf, lr.fit(idf.transform(counts))])


def score_both(df: DataFrame, tree: PipelineModel, text: PipelineModel, text_col: str = "cleaned_text") -> DataFrame:
    """M9: ``p_tree`` and ``p_text`` of two fitted models over the same rows, in one pass. ``df`` has the
    matrix columns and the cleaned text; works on a stream's micro-batches as on tables."""
    made = ("_cat_idx", "_cat_vec", "_words", "_tf", "features", "rawPrediction", "probability", "prediction")
    cast = df.withColumns({c: F.col(c).cast("double") for c in BASE_FEATURES})
    scored = positive_probability(tree.transform(cast), "p_tree").drop(*made)
    return positive_probability(text.transform(scored), "p_text").drop(*made)


def auc_of(scored: DataFrame, label: str = "y", raw: str = "rawPrediction") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw,
                                         metricName="areaUnderROC").evaluate(scored)


def save_model(model: PipelineModel, path: str) -> str:
    """``PipelineModel`` directory (replaces the pickle)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Loaded once on the driver; executors receive the fitted stages with the plan."""
    return PipelineModel.load(path)
