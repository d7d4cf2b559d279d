"""Text classifier trained in rounds (M6): logistic regression over hashed words, evaluated after every
round, stopped after ``patience`` rounds without gain, its best round restored.

Words become slots (the first 32 bits of their md5, modulo ``SLOTS``), written once as one array per review;
slots weigh by their inverse document frequency in the training rows, over the root of the review's number
of words (long reviews would else drown the bias). A round is one pass: each task sums the
gradient of its training rows per slot, and the confusion counts and the loss of its validation rows; a
``groupBy`` adds them. The driver holds the weights and the optimiser's two moments, ``SLOTS`` numbers each
whatever the data, takes a step (Adam) and writes the round's weights to the shared folder. Sums are whole
multiples of 2**-32, so that they do not depend on the order in which tasks finish.

The log has one record per round in the shape of the run log, so ``runs.early_stop`` and ``runs.best_record``
apply to it; training itself stops by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions import text as T
from veritext.operators import metrics as ME
from veritext.session import scratch_path

SLOTS = 1 << 18
TRAIN, VALIDATION, TEST = "train", "validation", "test"
_UNIT = float(1 << 32)
#: Sums beside those of the slots.
_BIAS, _LOSS, _ROWS, _TP, _FP, _FN, _TN, _EVAL_LOSS = range(-1, -9, -1)


@dataclass(frozen=True)
class Rounds:
    max_rounds: int = 30
    patience: int = 2
    learning_rate: float = 0.1
    l2: float = 1e-4
    decay: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8


@dataclass
class TextModel:
    idf: np.ndarray
    weights: np.ndarray
    bias: float = 0.0


def word_slots(text: Column, slots: int = SLOTS) -> Column:
    """One slot per word, repeats kept."""
    def slot(w: Column) -> Column:
        return (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % slots).cast("int")

    return F.transform(T.words(text), slot)


def prepared(df: DataFrame, text_col: str = "cleaned_text", slots: int = SLOTS) -> DataFrame:
    """(review_id, y, part, slots) of the labelled rows, written: the words are hashed once for all rounds."""
    rows = df.filter(F.col("y").isNotNull()).select(
        "review_id", F.col("y").cast("double").alias("y"), "part", word_slots(F.col(text_col), slots).alias("slots"))
    path = scratch_path(df.sparkSession, "text-slots")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def slot_weights(train: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """ln((rows + 1) / (rows with the slot + 1)) per slot."""
    held = train.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"))
    n = np.zeros(slots)
    for r in held.toLocalIterator():  # at most ``slots`` rows
        n[r["slot"]] = r["n"]
    return np.log((train.count() + 1) / (n + 1))


def _flat(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All slots of a batch, the row each belongs to, and its value there."""
    lengths = np.diff(column.offsets.to_numpy())
    at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return at, np.repeat(np.arange(len(column)), lengths), idf[at] / np.sqrt(np.repeat(lengths, lengths))


def _margins(column: pa.Array, model: TextModel) -> np.ndarray:
    at, row, value = _flat(column, model.idf)
    return model.bias + np.bincount(row, value * model.weights[at], len(column))


def _pass(rows: DataFrame, model: TextModel) -> dict[int, float]:
    """Sums by slot of the training gradient, and those beside, at the model's weights."""
    size = len(model.idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, beside = np.zeros(size), dict.fromkeys(range(_EVAL_LOSS, 0), 0.0)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            train = np.array(batch.column(1).to_pylist()) == TRAIN
            m = _margins(batch.column(2), model)
            p = 0.5 * (1 + np.tanh(m / 2))
            loss = np.logaddexp(0, np.where(y > 0.5, -m, m))
            at, row, value = _flat(batch.column(2), model.idf)
            off = np.where(train, p - y, 0.0)
            gradient += np.bincount(at, value * off[row], size)
            beside[_BIAS] += off.sum()
            beside[_LOSS] += loss[train].sum()
            beside[_ROWS] += train.sum()
            says, is_one = (p > 0.5) & ~train, (y > 0.5) & ~train
            beside[_TP] += (says & is_one).sum()
            beside[_FP] += (says & ~is_one).sum()
            beside[_FN] += (~says & is_one).sum()
            beside[_TN] += (~says & ~is_one & ~train).sum()
            beside[_EVAL_LOSS] += loss[~train].sum()
        held = np.flatnonzero(gradient)
        names = np.concatenate([held, list(beside)]).astype(np.int32)
        sums = np.rint(np.concatenate([gradient[held], list(beside.values())]) * _UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], names=["slot", "part"])

    used = rows.filter(F.col("part").isin(TRAIN, VALIDATION)).select("y", "part", "slots")
    sums = used.mapInArrow(run, "slot int, part long").groupBy("slot").agg(
        (F.sum(F.col("part").cast("decimal(20,0)")).cast("double") / _UNIT).alias("sum"))
    return {r["slot"]: r["sum"] for r in sums.toLocalIterator()}  # at most ``slots`` rows and nine


def gradient(rows: DataFrame, model: TextModel, l2: float = 0.0) -> tuple[np.ndarray, float, dict[int, float]]:
    """Mean gradient of the training loss by slot and by the bias, and all sums of the pass."""
    sums = _pass(rows, model)
    n = max(sums.get(_ROWS, 0.0), 1.0)
    g = np.zeros(len(model.idf))
    at = np.array([s for s in sums if s >= 0], np.int64)
    g[at] = np.array([sums[s] for s in at.tolist()]) / n
    return g + l2 * model.weights, sums.get(_BIAS, 0.0) / n, sums


def _record(number: int, sums: dict[int, float]) -> dict:
    """One record of the run log: the evaluation of the validation rows."""
    tp, fp, fn, tn = (sums.get(k, 0.0) for k in (_TP, _FP, _FN, _TN))
    n = tp + fp + fn + tn

    def share(a: float, b: float) -> float:
        return a / b if b else 0.0

    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return {"epoch": float(number), "step": number, "loss": round(share(sums.get(_LOSS, 0.0), sums.get(_ROWS, 0.0)), 6),
            "eval_accuracy": round(share(tp + tn, n), 6), "eval_precision": round(precision, 6),
            "eval_recall": round(recall, 6), "eval_f1": round(share(2 * precision * recall, precision + recall), 6),
            "eval_loss": round(share(sums.get(_EVAL_LOSS, 0.0), n), 6), "n": int(n)}


def fit_rounds(rows: DataFrame, settings: Rounds = Rounds(), slots: int = SLOTS) -> tuple[list[dict], str]:
    """Trains on the rows of ``prepared``: (one record per round, folder of the rounds' weights)."""
    spark = rows.sparkSession
    path = scratch_path(spark, "text-rounds")
    train = rows.filter(F.col("part") == TRAIN)
    model = TextModel(slot_weights(train, slots), np.zeros(slots))
    one, two = np.zeros(slots + 1), np.zeros(slots + 1)
    log: list[dict] = []
    best, without = -1.0, 0
    g, g_bias, _ = gradient(rows, model, settings.l2)
    for number in range(1, settings.max_rounds + 1):
        whole = np.append(g, g_bias)
        a, b = settings.decay
        one, two = a * one + (1 - a) * whole, b * two + (1 - b) * whole * whole
        step = settings.learning_rate * (one / (1 - a ** number)) / (np.sqrt(two / (1 - b ** number)) + settings.eps)
        model = TextModel(model.idf, model.weights - step[:-1], model.bias - float(step[-1]))
        save_round(spark, path, number, model)
        # the pass that evaluates these weights also gives the next round's gradient
        g, g_bias, sums = gradient(rows, model, settings.l2)
        log.append(_record(number, sums))
        gained = log[-1]["eval_f1"] > best
        best, without = (log[-1]["eval_f1"], 0) if gained else (best, without + 1)
        if without >= settings.patience:
            break
    return log, path


def save_round(spark: SparkSession, path: str, number: int, model: TextModel) -> None:
    held = np.flatnonzero(model.weights)
    frame = pd.DataFrame({"slot": np.append(held, -1).astype("int32"), "weight": np.append(model.weights[held], model.bias),
                          "idf": np.append(model.idf[held], 0.0)})
    spark.createDataFrame(frame, "slot int, weight double, idf double").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/round={number}")


def load_round(spark: SparkSession, path: str, number: int, slots: int = SLOTS) -> TextModel:
    model = TextModel(np.zeros(slots), np.zeros(slots))
    for r in spark.read.parquet(f"{path}/round={number}").toLocalIterator():
        if r["slot"] < 0:
            model.bias = r["weight"]
        else:
            model.weights[r["slot"]], model.idf[r["slot"]] = r["weight"], r["idf"]
    return model


def best_round(log: list[dict]) -> int:
    """The round of the highest F1, the first of equals."""
    return max(log, key=lambda r: (r["eval_f1"], -r["step"]))["step"]


def score(model: TextModel, rows: DataFrame) -> DataFrame:
    """(review_id, y, pred, p_pos) of rows of ``prepared``."""
    id_type = rows.schema["review_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 0.5 * (1 + np.tanh(_margins(batch.column(2), model) / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)],
                                             names=["review_id", "y", "p_pos"])

    scored = rows.select("review_id", "y", "slots").mapInArrow(run, f"review_id {id_type}, y double, p_pos double")
    return scored.select("review_id", F.col("y").cast("int").alias("y"),
                         (F.col("p_pos") > 0.5).cast("int").alias("pred"), "p_pos")


def evaluate(model: TextModel, rows: DataFrame, part: str = TEST) -> DataFrame:
    return ME.binary_metrics(score(model, rows.filter(F.col("part") == part)))
