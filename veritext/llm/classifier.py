"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes ``FEATURES``: lengths, shares of symbols, digits, capitals and marks, repetition of
words, lines and word windows, and entropies. The statistics are written once; the texts are not read again.
They are standardised by the mean and deviation of the training rows and mapped to ``WIDTH`` cosines with
fixed random frequencies, whose products approximate a Gaussian kernel of width ``BANDWIDTH``. Each task
sums the normal equations of its own training rows, their cells are added by a ``groupBy``, and the ridge
solution of the WIDTH x WIDTH system gives a raw score. A fourth of the training texts (by a hash of their
statistics, so that copies stay together) is left out of that fit; their raw scores, counted into ``BINS``
bins, are pooled to a rising step curve (isotonic regression), joined linearly between the middles of its
steps. All training rows are used, and what reaches the driver is of fixed size.

Defined results: the label of a training row is the mean of its labels (copies of a row count each; null
labels count nowhere); without labelled training rows every score is 0.5, without rows left for the
calibration the raw score is cut to 0..1; null and empty texts have statistics of zero and are scored like
any other; rows repeat as they came; an empty table gives an empty result; a long text is read whole, in
time proportional to its length. Columns other than the named ones keep out of the way: results hold only
the columns of ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import written

FEATURES = ("words", "bytes", "word_bytes", "word_spread", "longest_word", "symbols", "digits", "capitals", "marks",
            "high_bytes", "distinct_words", "commonest_word", "repeated_windows", "repeated_lines", "line_words",
            "byte_entropy", "word_entropy")
WIDTH = 192
BANDWIDTH = 3.0
RIDGE = 1e-3
SEED = 17
BINS = 4096
#: Range of raw scores that the bins cover; scores beyond fall into the first or last.
RANGE = (-0.5, 1.5)
#: Standardised statistics are held within this many deviations.
REACH = 6.0
WINDOW = 5

_KINDS = np.zeros(256, np.int64)  # 1 symbols, 2 digits, 3 capitals, 4 other ASCII marks, 5 bytes beyond ASCII
_KINDS[128:] = 5
for _c in range(0x21, 0x7F):
    _KINDS[_c] = 3 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 0 if chr(_c).isalpha() else 4
for _c in b"#*$%&|<>{}[]=+^~\\_@":
    _KINDS[_c] = 1


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def statistics_of(text: bytes) -> list[float]:
    """``FEATURES`` of one UTF-8 text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    held = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, weights=held, minlength=6)
    held[[9, 10, 11, 12, 13, 32]] = 0
    solid = int(held.sum())
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    counts = np.bincount(ids)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0.0
    if len(ids) > WINDOW:
        with np.errstate(over="ignore"):
            mixed = ids[:-WINDOW + 1].astype(np.uint64)
            for k in range(1, WINDOW):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k:len(ids) - WINDOW + 1 + k].astype(np.uint64)
        repeated = 1 - len(np.unique(mixed)) / len(mixed)
    n = len(words)
    return [float(np.log1p(n)), float(np.log1p(solid)), solid / n, float(sizes.std()), float(np.log1p(sizes.max())),
            kinds[1] / solid, kinds[2] / solid, kinds[3] / solid, kinds[4] / solid, kinds[5] / solid,
            float(np.log(len(counts)) / np.log(n)) if n > 1 else 1.0, counts.max() / n, repeated,
            1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), _entropy(held),
            _entropy(counts) / float(np.log2(n)) if n > 1 else 1.0]


def statistics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``stats`` (array<double>) per row."""
    types = [df.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary())
            rows = [statistics_of(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(rows, pa.list_(pa.float64()))],
                names=[*(f"k{i}" for i in range(len(keep))), "stats"])

    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(types)), "stats array<double>"])
    made = df.select(*keep, text_col).mapInArrow(run, schema)
    return made.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "stats")


@dataclass
class Classifier:
    """``curve``: raw scores and calibrated shares of label 1, both rising; None without calibration rows."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return mapped(stats, self.mean, self.spread) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.clip(raw if self.curve is None else np.interp(raw, *self.curve), 0.0, 1.0)


def mapped(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray, width: int = WIDTH,
           bandwidth: float = BANDWIDTH, seed: int = SEED) -> np.ndarray:
    """Random Fourier features (the last one constant): their products approximate
    exp(-|x - y|^2 / (2 * bandwidth^2)) of the standardised statistics."""
    rng = np.random.default_rng(seed)
    x = np.clip((stats - mean) / spread, -REACH, REACH)
    waves = rng.standard_normal((stats.shape[1], width)) / bandwidth
    shift = rng.uniform(0, 2 * np.pi, width)
    return np.hstack([np.cos(x @ waves + shift) * np.sqrt(2.0 / width), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(FEATURES))


def _normal_equations(rows: DataFrame, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over the rows (stats, y)."""
    size = WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size + 1)), False
        for batch in batches:
            if batch.num_rows:
                z = mapped(_matrix(batch.column(0)), model.mean, model.spread)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                total += z.T @ np.hstack([z, y[:, None]])
                seen = True
        if seen:
            cells = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)],
                                             names=["cell", "part"])

    sums = rows.select("stats", "y").mapInArrow(run, "cell int, part double").groupBy("cell").agg(
        F.sum("part").alias("part"))
    total = np.zeros(size * (size + 1))
    for r in sums.toLocalIterator():  # size * (size + 1) numbers, whatever the rows
        total[r["cell"]] = r["part"]
    total = total.reshape(size, size + 1)
    return total[:, :size], total[:, size]


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (x rising, n rows, y of them positive) as rising steps, given by the
    middle of each and its share."""
    steps: list[list[float]] = []  # rows, positives, sum of x
    for a, b, c in zip(n, y, x):
        steps.append([float(a), float(b), float(a * c)])
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last)]
    return np.array([s[2] / s[0] for s in steps]), np.array([s[1] / s[0] for s in steps])


def _curve(rows: DataFrame, model: Classifier) -> tuple[np.ndarray, np.ndarray] | None:
    low, high = RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch.column(0)))
                at = np.clip(((raw - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)
                n += np.bincount(at, minlength=BINS)
                good += np.bincount(at, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=BINS)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(good[held])],
                                         names=["bin", "n", "good"])

    bins = rows.select("stats", "y").mapInArrow(run, "bin int, n double, good double").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()  # at most BINS rows
    if not bins:
        return None
    middle = low + (np.array([r["bin"] for r in bins]) + 0.5) * (high - low) / BINS
    return isotonic(middle, np.array([r["n"] for r in bins]), np.array([r["good"] for r in bins]))


def fit(rows: DataFrame) -> Classifier:
    """The classifier of the training rows (stats, y), y from 0 to 1."""
    rows = rows.filter(F.col("y").isNotNull()).select("stats", F.col("y").cast("double").alias("y"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("stats"), F.lit(4)))
    learn, calibrate = rows.filter("_part <> 0"), rows.filter("_part = 0")
    one = [F.col("stats")[i] for i in range(len(FEATURES))]
    m = learn.agg(F.count(F.lit(1)), *(F.avg(c) for c in one), *(F.stddev_pop(c) for c in one)).first()
    if not m[0]:
        learn = rows  # too few rows to leave some out
        m = learn.agg(F.count(F.lit(1)), *(F.avg(c) for c in one), *(F.stddev_pop(c) for c in one)).first()
        if not m[0]:
            return Classifier(np.zeros(len(one)), np.ones(len(one)), None)
    spread = np.array(m[1 + len(one):])
    model = Classifier(np.array(m[1:1 + len(one)]), np.where(spread > 1e-9, spread, 1.0), None)
    zz, zy = _normal_equations(learn, model)
    n = float(m[0])
    ridge = RIDGE * np.eye(len(zz))
    ridge[-1, -1] = 1e-12  # the constant is not shrunk
    model.weights = np.linalg.solve(zz / n + ridge / WIDTH, zy / n)
    model.curve = _curve(calibrate, model)
    return model


def score(rows: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) per row with ``stats``."""
    types = [rows.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(_matrix(batch.column(len(keep)))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(got)],
                                             names=[*(f"k{i}" for i in range(len(keep))), "score"])

    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(types)), "score double"])
    scored = rows.select(*keep, "stats").mapInArrow(run, schema)
    return scored.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "score")


def classify(df: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """(id, trains, score): every row of ``df`` scored by a model of the rows that ``trains`` (a condition on
    ``df``) lets in and ``labels`` (id, label) marks."""
    source = df.select(F.col(id_col).alias("id"), F.coalesce(trains, F.lit(False)).alias("trains"),
                       F.col(text_col).alias("text"))
    stats = written(statistics(source, "text", ("id", "trains")), "quality-statistics")
    marks = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
             .filter("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.avg("_y").alias("y")))
    rows = stats.filter("trains").join(marks, F.col("id") == F.col("_id")).select("stats", "y")
    model = fit(written(rows, "quality-training"))
    return score(stats, model, ("id", "trains")).withColumnRenamed("id", id_col)
