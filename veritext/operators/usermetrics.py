"""Metrics of the user's own (F3): a callback with mergeable state, applied per group.

A metric is an object with ``start() -> state``, ``add(state, y, p) -> state`` over arrays of labels and
probabilities, ``merge(state, state) -> state`` and ``finish(state) -> {name: value}``; a state is an array of
doubles of fixed size. Each task adds its own rows, whatever their group; the states of a group are merged in
two levels, first by tasks' shares, so that no task sees the rows of a group, nor more than a share of its
states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that meet in one task of the first level: about the root of as many tasks as there may be.
SHARE = 256


class BrierAndCorrelation:
    """Mean squared error of the probability, and Matthews' correlation of the class p > 0.5; 0 when
    undefined."""

    def start(self) -> np.ndarray:
        return np.zeros(6)  # rows, squared error, true and false positives, false and true negatives

    def add(self, state: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        says, good = p > 0.5, y > 0.5
        return state + np.array([len(y), ((p - y) ** 2).sum(), (says & good).sum(), (says & ~good).sum(),
                                 (~says & good).sum(), (~says & ~good).sum()])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, state: np.ndarray) -> dict[str, float]:
        n, off, tp, fp, fn, tn = state
        root = float(np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
        return {"brier": float(off / n) if n else 0.0, "mcc": float((tp * tn - fp * fn) / root) if root else 0.0}


def evaluate(df: DataFrame, metric, group: str, y: str = "y", p: str = "p_pos") -> DataFrame:
    """(group, metric, value) per value of ``group``; rows without label or probability count nowhere."""
    kind = df.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            frame = batch.to_pandas()
            for key, rows in frame.groupby("g", dropna=False, sort=False):
                key = None if pd.isna(key) else key
                held[key] = metric.add(held.get(key, metric.start()), rows["y"].to_numpy(), rows["p"].to_numpy())
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), batch_type), pa.array([task // SHARE] * len(held), pa.int32()),
             pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], names=["g", "share", "state"])

    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        F.col(group).alias("g"), F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
    batch_type = rows.schema["g"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    batch_type = to_arrow_type(batch_type)

    def merged(states: pd.Series) -> np.ndarray:
        total = metric.start()
        for s in states:
            total = metric.merge(total, np.asarray(s, float))
        return total

    def first_level(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": frame["g"].iloc[:1], "state": [merged(frame["state"]).tolist()]})

    def last_level(frame: pd.DataFrame) -> pd.DataFrame:
        values = metric.finish(merged(frame["state"]))
        return pd.DataFrame({"g": [frame["g"].iloc[0]] * len(values), "metric": list(values), "value": list(values.values())})

    states = rows.mapInArrow(partial, f"g {kind}, share int, state array<double>")
    shares = states.groupBy("g", "share").applyInPandas(first_level, f"g {kind}, state array<double>")
    out = shares.groupBy("g").applyInPandas(last_level, f"g {kind}, metric string, value double")
    return out.withColumnRenamed("g", group)
