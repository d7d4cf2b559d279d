"""Second-order boosted trees with L1 and L2 on leaf weights.

Spark ML's boosting has no leaf regularisation, so the search axes ``reg_alpha`` and ``reg_lambda`` need a
trainer of their own. It is a histogram method. Numeric features are cut at quantiles of all training rows
(at equal first hessians these are the weighted quantiles), the category column has one slot per fitted
value ("is this value" against all others, as a 0/1 column would split), and each row becomes a short array
of bin numbers, written once. For every level of a tree, each task applies the trees so far to its rows and
sums gradient and hessian per (model, node, feature, bin); a ``groupBy`` adds the cells, windows over the
bins of one node and feature give the gain of every cut, and one best split per node comes to the driver.
Sums are whole multiples of 2**-32, so a result does not depend on the order in which tasks finish.

Several models (parameter sets, folds) are trained over the same rows in one go: a pass serves one level of
all of them. What depends on rows stays in tasks; the driver holds trees, cuts and category names. Margins
are written to the shared folder every ``STATE_EVERY`` trees of all models, so that neither the work of a task nor the
loss of one grows with the number of trees.

A search has more models than there are cores, so its models and not its rows are dealt to tasks: each takes the
packed bins of all rows, trains its models by the same sums, cuts and order of ties, and returns their areas alone.
What a task holds per row lies in mapped files of its temp folder beyond ``MAPPED`` bytes. Up to ``IN_TASK`` rows,
where a pass costs more than its work, single fits are trained the same way; the trees are those of the passes.

With G, H the sums of a node, T(G) = sign(G) * max(|G| - reg_alpha, 0): a leaf weighs
-learning_rate * T(G) / (H + reg_lambda), and a cut gains half of the sum over both children of
T(G)^2 / (H + reg_lambda), less the same of the node, less gamma. Ties go to the earlier feature, then the
lower bin. A missing number goes to the side that gains more (right when equal); a missing or unknown
category is none of the values.
"""

from __future__ import annotations

import dataclasses
import json
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.session import scratch_path

MAX_BINS = 64
#: Trees, of all models, that a pass applies to its rows before the margins are written again.
STATE_EVERY = 10
#: Models trained in one pass over the rows.
TOGETHER = 64
#: Rows up to which single fits are trained inside one task; sums of as many rows are exact in doubles.
IN_TASK = 1 << 20
#: Margins that a task works on at once (models times rows), rows at once, and bytes an array may take in memory.
AT_ONCE, CHUNK, MAPPED = 1 << 17, 1 << 18, 1 << 26
#: A split has to gain more than rounding may show.
LEAST_GAIN = 1e-6
_CELL = ["model", "node", "feature", "bin", "g", "h"]
_UNIT = float(1 << 32)


@dataclass(frozen=True)
class Settings:
    """The search axes; the defaults are those of the usual boosting libraries."""

    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0


@dataclass
class Space:
    """Fitted bins: ``cuts`` per numeric feature (a value belongs to the first cut that is not below it) and
    the values of the category column, in order; ``slots`` limits the features that trees may use."""

    numeric: list[str]
    cuts: list[list[float]]
    category: str | None = None
    labels: list[str] = field(default_factory=list)
    slots: list[str] | None = None

    def names(self) -> list[str]:
        """Names of all slots: numeric features, then ``category_<value>``."""
        return [*self.numeric, *(f"category_{v}" for v in self.labels)]

    def only(self, slots: Sequence[str]) -> Space:
        """The same bins, with trees limited to ``slots``."""
        return dataclasses.replace(self, slots=list(slots))


@dataclass
class Tree:
    """Nodes by number, the root first. ``feature`` is -1 in a leaf; ``code`` is the last bin of the left
    child, or the category that goes right."""

    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, weight: float, cover: float) -> int:
        for values, value in ((self.feature, -1), (self.code, 0), (self.missing_left, False), (self.left, -1),
                              (self.right, -1), (self.weight, weight), (self.gain, 0.0), (self.cover, cover)):
            values.append(value)
        return len(self.feature) - 1

    def nodes_of(self, bins: np.ndarray, numeric: int) -> np.ndarray:
        """The node each row ends in."""
        at = np.zeros(len(bins), np.int64)
        feature, code = np.array(self.feature), np.array(self.code)
        left, right, missing = np.array(self.left), np.array(self.right), np.array(self.missing_left)
        # level by level: a split takes the rows of its node, whose numbers are the only ones read
        parts = [(0, np.arange(len(bins)))]
        while parts:
            node, rows = parts.pop()
            if feature[node] < 0 or not len(rows):
                at[rows] = node
                continue
            value = bins[rows, feature[node]]
            if feature[node] >= numeric:
                goes = value != code[node]
            else:
                goes = value <= code[node]
                if not missing[node]:
                    goes &= value >= 0
            parts += [(left[node], rows[goes]), (right[node], rows[~goes])]
        return at

    def values(self, bins: np.ndarray, numeric: int) -> np.ndarray:
        return np.array(self.weight)[self.nodes_of(bins, numeric)]


@dataclass
class Ensemble:
    space: Space
    settings: Settings
    trees: list[Tree]

    def margins(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[:trees]:
            out += tree.values(bins, len(self.space.numeric))
        return out


# -- bins -----------------------------------------------------------------------------------------


def fit_space(df: DataFrame, numeric: Sequence[str], category: str | None = "category",
              max_bins: int = MAX_BINS) -> Space:
    """Cuts at the quantiles i / max_bins of each numeric feature (never above its greatest value), and the
    sorted values of the category column."""
    shares = [i / max_bins for i in range(1, max_bins + 1)]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in numeric)).first()
    cuts = [sorted({float(v) for v in row[c] or [] if v is not None and v == v}) for c in numeric]
    labels = []
    if category is not None and not df.filter(F.col(category).isNotNull()).isEmpty():
        labels = list(StringIndexer(inputCol=category, outputCol="_i", stringOrderType="alphabetAsc",
                                    handleInvalid="skip").fit(df.select(category)).labels)
    return Space(list(numeric), cuts, category, labels)


def binned(df: DataFrame, space: Space, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``bins`` (int32 per numeric feature, then one for the category; -1: missing)."""
    types = [df.schema[c].dataType.simpleString() for c in keep]
    allowed = None if space.slots is None else set(space.slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {v: i for i, v in enumerate(space.labels) if allowed is None or f"category_{v}" in allowed}
        for batch in batches:
            n, k = batch.num_rows, len(keep)
            bins = np.full((n, len(space.numeric) + 1), -1, np.int32)
            for j, cuts in enumerate(space.cuts):
                x = batch.column(k + j).to_numpy(zero_copy_only=False).astype(np.float64)
                known = ~np.isnan(x)
                bins[known, j] = np.searchsorted(np.array(cuts), x[known], side="left")
            if space.category is not None:
                bins[:, -1] = [codes.get(v, -1) for v in batch.column(k + len(space.numeric)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(k)), _packed(bins)],
                names=[*(f"k{i}" for i in range(k)), "bins"])

    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(types)), "bins binary"])
    columns = [*(F.col(c) for c in keep), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(space.numeric))]
    if space.category is not None:
        columns.append(F.col(space.category).alias("xc"))
    out = df.select(*columns).mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "bins")


def _numbers(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of equally many numbers, packed in a binary column."""
    if not len(column):
        return np.zeros((0, width), dtype)
    column = column.cast(pa.large_binary())
    start = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype, len(column) * width, int(start)).reshape(len(column), width)


def _packed(rows: np.ndarray) -> pa.Array:
    """A binary value per row of numbers."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return _numbers(column, np.int32, width)


# -- gains: plain columns, the same for a pass over tasks' sums and for any other table of cells ------


def shrunk(g: Column, alpha: Column) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))


def leaf_weight(g: Column, h: Column, alpha: Column, lam: Column, rate: Column) -> Column:
    return -rate * shrunk(g, alpha) / (h + lam)


def _worth(g: Column, h: Column, alpha: Column, lam: Column) -> Column:
    t = shrunk(g, alpha)
    return F.when(h + lam > 0, t * t / (h + lam)).otherwise(0.0)


def candidates(cells: DataFrame, settings: Sequence[Settings], numeric: int) -> DataFrame:
    """Every cut of every node: (model, node, feature, code, missing_left, gl, hl, gr, hr, g, h, gain) from
    (model, node, feature, bin, g, h); gain is null where a child is too light.

    The windows hold the cells of one node and feature: bins, or fitted categories."""
    def of(name: str) -> Column:
        return F.get(F.array(*(F.lit(float(getattr(s, name))) for s in settings)), F.col("model"))

    every = Window.partitionBy("model", "node", "feature")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    is_number = F.col("feature") < numeric
    c = cells.select(
        "model", "node", "feature", "bin", "g", "h",
        *(F.sum(v).over(every).alias(f"all_{v}") for v in "gh"),
        *(F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col(v))).over(every), F.lit(0.0)).alias(f"none_{v}") for v in "gh"),
        *(F.coalesce(F.sum(F.when(F.col("bin") >= 0, F.col(v))).over(upto), F.lit(0.0)).alias(f"upto_{v}") for v in "gh"))
    sides = F.when(is_number & (F.col("none_h") > 0), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    c = c.withColumn("missing_left", F.explode(sides))
    for v in "gh":
        number = F.col(f"upto_{v}") + F.when(F.col("missing_left"), F.col(f"none_{v}")).otherwise(0.0)
        c = c.withColumn(f"{v}l", F.when(is_number, number).otherwise(F.col(f"all_{v}") - F.col(v)))
        c = c.withColumn(f"{v}r", F.col(f"all_{v}") - F.col(f"{v}l"))
    a, b = of("reg_alpha"), of("reg_lambda")
    gain = 0.5 * (_worth(F.col("gl"), F.col("hl"), a, b) + _worth(F.col("gr"), F.col("hr"), a, b)
                  - _worth(F.col("all_g"), F.col("all_h"), a, b)) - of("gamma")
    heavy = ((F.col("bin") >= 0) & (F.col("hl") > 0) & (F.col("hr") > 0) & (F.col("hl") >= of("min_child_weight"))
             & (F.col("hr") >= of("min_child_weight")))
    return c.select("model", "node", "feature", F.col("bin").alias("code"), "missing_left", "gl", "hl", "gr", "hr",
                    F.col("all_g").alias("g"), F.col("all_h").alias("h"), F.when(heavy, gain).alias("gain"))


def best_splits(cuts: DataFrame) -> DataFrame:
    """One row per (model, node): its sums and the best cut (null where nothing gains)."""
    good = F.col("gain") > LEAST_GAIN
    order = F.when(good, F.struct("gain", -F.col("feature"), -F.col("code"), ~F.col("missing_left")))
    cut = F.struct("feature", "code", "missing_left", "gl", "hl", "gr", "hr", "gain")
    return cuts.groupBy("model", "node").agg(F.max("g").alias("g"), F.max("h").alias("h"),
                                             F.max_by(cut, order).alias("cut"))


# -- training -------------------------------------------------------------------------------------


def _probability(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * margin))


def _cells(state: DataFrame, width: int, fresh: list[list[Tree]], growing: list[tuple[Tree, list[int]] | None],
           held_out: list[int | None]) -> DataFrame:
    """(model, node, feature, bin, g, h): sums over the training rows of each open node."""
    numeric = width - 1

    def merged(parts: list[tuple]) -> list[tuple]:
        frame = pd.DataFrame({c: np.concatenate(v) for c, v in zip(_CELL, zip(*parts))})
        frame = frame.groupby(_CELL[:4], sort=False, as_index=False).sum()
        return [tuple(frame[c].to_numpy() for c in _CELL)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            bins, y = _rows(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False)
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            margins = _numbers(batch.column(3), np.float64, len(growing))
            # the cells of this batch: (feature, bin) by number, the same for all models and nodes
            found = [np.unique(bins[:, f], return_inverse=True) for f in range(width)]
            first = np.concatenate([[0], np.cumsum([len(b) for b, _ in found])])
            feature, value = np.repeat(np.arange(width), np.diff(first)), np.concatenate([b for b, _ in found])
            cell, size = np.stack([at + k for (_, at), k in zip(found, first)], axis=1), int(first[-1])
            for model, grown in enumerate(growing):
                if grown is None:
                    continue
                tree, open_nodes = grown
                place = np.full(len(tree.feature), -1)
                place[open_nodes] = np.arange(len(open_nodes))
                node = place[tree.nodes_of(bins, numeric)]
                used = node >= 0
                if held_out[model] is not None:
                    used &= fold != held_out[model]
                rows = np.flatnonzero(used)
                margin = margins[rows, model].copy()
                for before in fresh[model]:
                    margin += before.values(bins[rows], numeric)
                p = _probability(margin)
                g, h = np.rint((p - y[rows]) * _UNIT), np.rint(p * (1 - p) * _UNIT)
                key = (node[rows, None] * size + cell[rows]).ravel()
                some = np.flatnonzero(np.bincount(key))
                # whole numbers below 2**53 in a batch: exact in doubles
                sums = [np.bincount(key, np.repeat(v, width))[some].astype(np.int64) for v in (g, h)]
                at = some % max(size, 1)
                out.append((np.full(len(some), model, np.int32), np.array(open_nodes, np.int32)[some // max(size, 1)],
                            feature[at].astype(np.int32), value[at].astype(np.int32), *sums))
            if out:
                out = merged(out)  # what a task holds grows with its cells, not with its rows
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out[0]], names=_CELL)

    parts = state.mapInArrow(run, "model int, node int, feature int, bin int, g long, h long")
    exact = [(F.sum(F.col(v).cast("decimal(20,0)")).cast("double") / _UNIT).alias(v) for v in "gh"]
    # dealt as the windows of ``candidates`` need them, so that the cells move once
    return parts.repartition("model", "node", "feature").groupBy(*_CELL[:4]).agg(*exact)


def _advanced(state: DataFrame, width: int, fresh: list[list[Tree]]) -> DataFrame:
    """The state with the margins of ``fresh`` added, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _rows(batch.column(0), width)
            margins = _numbers(batch.column(3), np.float64, len(fresh)).copy()
            for model, trees in enumerate(fresh):
                for tree in trees:
                    margins[:, model] += tree.values(bins, width - 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), _packed(margins)],
                names=["bins", "y", "fold", "margins"])

    return _written(state.mapInArrow(run, state.schema))


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "boosting")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _base(rows: DataFrame, space: Space, label: str, fold: str | None) -> DataFrame:
    """(_y, _fold, bins) of the labelled rows, written."""
    labelled = rows.filter(F.col(label).isNotNull()).select(
        "*", F.col(label).cast("double").alias("_y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("_fold"))
    return _written(binned(labelled, space, ["_y", "_fold"]))


def fit_many(rows: DataFrame, space: Space, jobs: Sequence[tuple[Settings, int | None]], label: str = "y",
             fold: str | None = None) -> list[Ensemble]:
    """One ensemble per (settings, fold left out); ``rows`` has the label (0/1, null rows are left out), the
    features of ``space`` and, if folds are left out, the ``fold`` column."""
    if not jobs:
        return []
    base = _base(rows, space, label, fold)
    if 0 < base.limit(IN_TASK + 1).count() <= IN_TASK:
        trained = _dealt(base, space, jobs, [()] * len(jobs), trees=True).select("job", "trees").collect()  # one row per job
        trees = {r["job"]: [Tree(**t) for t in json.loads(r["trees"])] for r in trained}
        return [Ensemble(space, s, trees[i]) for i, (s, _) in enumerate(jobs)]
    out: list[Ensemble] = []
    for at in range(0, len(jobs), TOGETHER):
        out += _fit(base, space, list(jobs[at:at + TOGETHER]))
    return out


def _fit(base: DataFrame, space: Space, jobs: list[tuple[Settings, int | None]]) -> list[Ensemble]:
    width = len(space.numeric) + 1
    settings, held_out = [s for s, _ in jobs], [f for _, f in jobs]
    state = base.select("bins", F.col("_y").alias("y"), F.col("_fold").alias("fold"),
                        F.lit(b"\0" * 8 * len(jobs)).alias("margins"))
    names = space.names()
    allowed = set(names if space.slots is None else space.slots)
    barred = [i for i, n in enumerate(space.numeric) if n not in allowed]
    done: list[list[Tree]] = [[] for _ in jobs]
    fresh: list[list[Tree]] = [[] for _ in jobs]
    for _ in range(max((s.n_estimators for s in settings), default=0)):
        growing: list[tuple[Tree, list[int]] | None] = []
        for model, s in enumerate(settings):
            tree = Tree()
            growing.append((tree, [tree.add(0.0, 0.0)]) if len(done[model]) < s.n_estimators else None)
        trees = [g[0] if g else None for g in growing]
        for level in range(max(s.max_depth for s in settings)):
            growing = [g if g and g[1] and level < s.max_depth else None for g, s in zip(growing, settings)]
            if not any(growing):
                break
            cells = _cells(state, width, fresh, growing, held_out)
            if barred:
                cells = cells.filter(~F.col("feature").isin(barred))
            opened: dict[int, list[int]] = {}
            found = best_splits(candidates(cells, settings, len(space.numeric))).collect()  # one row per open node
            for r in sorted(found, key=lambda r: (r["model"], r["node"])):
                opened.setdefault(r["model"], []).extend(_grow(trees[r["model"]], settings[r["model"]], r))
            growing = [(g[0], sorted(opened.get(i, []))) if g else None for i, g in enumerate(growing)]
        for model, tree in enumerate(trees):
            if tree is not None:
                done[model].append(tree)
                fresh[model].append(tree)
        if sum(map(len, fresh)) >= STATE_EVERY and any(len(d) < s.n_estimators for d, s in zip(done, settings)):
            state, fresh = _advanced(state, width, fresh), [[] for _ in jobs]
    return [Ensemble(space, s, trees) for s, trees in zip(settings, done)]


def _grow(tree: Tree, s: Settings, best) -> list[int]:
    """Splits a node by its best cut; the new nodes."""
    def weight(g: float, h: float) -> float:
        t = np.sign(g) * max(abs(g) - s.reg_alpha, 0.0)
        return float(-s.learning_rate * t / (h + s.reg_lambda)) if h + s.reg_lambda > 0 else 0.0

    node, cut = best["node"], best["cut"]
    tree.weight[node], tree.cover[node] = weight(best["g"], best["h"]), best["h"]
    if cut is None:
        return []
    tree.feature[node], tree.code[node], tree.missing_left[node] = cut["feature"], cut["code"], cut["missing_left"]
    tree.gain[node] = cut["gain"]
    tree.left[node] = tree.add(weight(cut["gl"], cut["hl"]), cut["hl"])
    tree.right[node] = tree.add(weight(cut["gr"], cut["hr"]), cut["hr"])
    # a node too light for two children is a leaf
    return [n for n in (tree.left[node], tree.right[node]) if tree.cover[n] >= 2 * s.min_child_weight]


# -- training inside a task --------------------------------------------------------------------------


def _room(shape: tuple, dtype=np.float64) -> np.ndarray:
    """An array, in a mapped file if it is large."""
    if int(np.prod(shape)) * np.dtype(dtype).itemsize <= MAPPED:
        return np.empty(shape, dtype)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype, "w+", shape=shape)


def _dealt(base: DataFrame, space: Space, jobs: Sequence[tuple[Settings, int | None]], marks: Sequence[Sequence[int]],
           trees: bool = False) -> DataFrame:
    """(job, n, role, num, n_pos, n_neg, trees): for each job and each of its ``marks``, its trees' number ``n``, the
    parts of the area on the fold left out (test) and on the others (train); or its trees, as text."""
    width, numeric = len(space.numeric) + 1, len(space.numeric)
    allowed = None if space.slots is None else set(space.slots)
    features = [f for f in range(width) if f == numeric or allowed is None or space.numeric[f] in allowed]
    groups = min(len(jobs), 4 * base.sparkSession.sparkContext.defaultParallelism)
    heaviest = sorted(range(len(jobs)), key=lambda i: -jobs[i][0].n_estimators * jobs[i][0].max_depth)
    dealt = [heaviest[k::groups] for k in range(groups)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fold = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                bins = np.ascontiguousarray(_rows(batch.column(2), width)[:, features].T)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (bins, y, fold)],
                                                 names=["bins", "y", "fold"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "bins", "y", "fold"))):
                if g != group and held:
                    yield from trained(group, held)
                    held = []
                group = g
                held.append(row)
        if held:
            yield from trained(group, held)

    def trained(group: int, held: list) -> Iterator[pa.RecordBatch]:
        rows = sum(len(y) for _, y, _ in held) // 8
        codes, y, fold = _room((len(features), rows), np.int32), _room((rows,)), _room((rows,), np.int32)
        a = 0
        while held:
            x, y_, fold_ = held.pop()
            b = a + len(y_) // 8
            codes[:, a:b] = np.frombuffer(x, np.int32).reshape(len(features), -1) + 1  # 0: missing
            y[a:b], fold[a:b] = np.frombuffer(y_), np.frombuffer(fold_, np.int32)
            a = b
        step = max(1, AT_ONCE // rows)
        for at in range(0, len(dealt[group]), step):
            part = dealt[group][at:at + step]
            grown: list[list[Tree]] = [[] for _ in part]
            for n, margins, new in _rounds(codes, y, fold, [jobs[i] for i in part], features, numeric, trees):
                areas = []
                for k, i in enumerate(part):
                    if trees and n <= jobs[i][0].n_estimators:
                        grown[k].append(new[k])
                    if n in marks[i]:
                        areas += [(i, n, *x) for x in _areas(margins[k], y, fold == jobs[i][1])]
                if areas:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*areas)), pa.nulls(len(areas), pa.string())],
                                                     names=DEALT_NAMES)
            for k, i in enumerate(part) if trees else ():
                text = json.dumps([dataclasses.asdict(t) for t in grown[k]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([len(grown[k])]), *(pa.nulls(1, t) for t in (pa.string(), pa.float64(), pa.int64(),
                                                                                        pa.int64())), pa.array([text])],
                    names=DEALT_NAMES)

    rows = base.select("_y", "_fold", "bins").mapInArrow(blocks, "bins binary, y binary, fold binary")
    rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return (rows.repartitionByRange(groups, "group").sortWithinPartitions("group")
            .mapInArrow(run, "job long, n long, role string, num double, n_pos long, n_neg long, trees string"))


DEALT_NAMES = ["job", "n", "role", "num", "n_pos", "n_neg", "trees"]


def _areas(margin: np.ndarray, y: np.ndarray, left_out: np.ndarray) -> Iterator[tuple]:
    """(role, sum over positives of the negatives below and half of those beside them, positives, negatives)."""
    for role, used in (("test", left_out), ("train", ~left_out)):
        if used.any():
            p, at = np.unique(_probability(margin[used]), return_inverse=True)
            pos = np.bincount(at, y[used].astype(np.int64), len(p)).astype(np.int64)
            neg = np.bincount(at, (1 - y[used]).astype(np.int64), len(p)).astype(np.int64)
            twice = int((pos * (2 * (np.cumsum(neg) - neg) + neg)).sum())
            yield role, twice / 2, int(pos.sum()), int(neg.sum())


def _rounds(codes: np.ndarray, y: np.ndarray, fold: np.ndarray, jobs: Sequence[tuple[Settings, int | None]],
            features: Sequence[int], numeric: int, trees: bool) -> Iterator[tuple[int, np.ndarray, list[Tree | None]]]:
    """After each round of all jobs: the number of trees, the margins (models, rows) and, if asked for, the new trees.

    ``codes`` (features, rows) holds bins from 1 up, 0 where a value is missing."""
    m, n = len(jobs), len(y)
    of = {f.name: np.array([float(getattr(s, f.name)) for s, _ in jobs]) for f in dataclasses.fields(Settings)}
    sizes = [int(c.max()) + 1 for c in codes]
    parts = [(a, min(a + CHUNK, n)) for a in range(0, n, CHUNK)]
    margin, g, h, value = (_room((m, n)) for _ in range(4))
    at, used = _room((m, n), np.int64), _room((m, n), bool)
    margin[:] = 0.0
    for k, (_, f) in enumerate(jobs):
        used[k] = True if f is None else fold != f

    def weight(model, g_, h_):
        total = h_ + of["reg_lambda"][model]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = -of["learning_rate"][model] * _shrunk(g_, of["reg_alpha"][model]) / total
        return np.where(total > 0, w, 0.0)

    for done in range(int(of["n_estimators"].max(initial=0))):
        live = np.flatnonzero(of["n_estimators"] > done)
        new = [Tree() if i in live else None for i in range(m)] if trees else [None] * m
        for tree in new:
            if tree is not None:
                tree.add(0.0, 0.0)
        place = np.full(m, -1)
        place[live] = np.arange(len(live))
        for a, b in parts:
            p = _probability(margin[:, a:b])
            g[:, a:b] = np.rint((p - y[a:b]) * _UNIT)
            h[:, a:b] = np.where(used[:, a:b], np.rint(p * (1 - p) * _UNIT), -1.0)  # below 0: a row of the fold left out
            value[:, a:b] = 0.0
            at[:, a:b] = place[:, None]
        model, node = live, np.zeros(len(live), np.int64)
        for level in range(int(of["max_depth"].max())):
            deeper = of["max_depth"][model] > level
            if not deeper.all():
                place = np.where(deeper, np.cumsum(deeper) - 1, -1)
                for a, b in parts:
                    here = at[:, a:b]
                    at[:, a:b] = np.where(here >= 0, place[here], -1)
                model, node = model[deeper], node[deeper]
            if not len(model):
                break
            best = _best(codes, g, h, at, parts, sizes, features, numeric, model, of)
            own = weight(model, best["g"], best["h"])
            if level == 0:
                for a, b in parts:
                    here = at[:, a:b]
                    value[:, a:b] = np.where(here >= 0, own[here], 0.0)
            split = np.flatnonzero(best["row"] >= 0)
            sides = [(best["gl"][split], best["hl"][split])]
            sides.append((best["g"][split] - sides[0][0], best["h"][split] - sides[0][1]))
            child = np.stack([weight(model[split], *side) for side in sides], axis=1).ravel()
            cover = np.stack([side[1] for side in sides], axis=1).ravel()
            of_model = np.repeat(model[split], 2)
            heavy = cover >= 2 * of["min_child_weight"][of_model]
            to = np.where(heavy, np.cumsum(heavy) - 1, -1)
            first = np.full(len(model), -1)
            first[split] = 2 * np.arange(len(split))
            for a, b in parts:
                here = at[:, a:b].ravel()
                some = np.flatnonzero(here >= 0)
                some = some[first[here[some]] >= 0]
                was = here[some]
                code = codes[best["row"][was], a + some % (b - a)]
                cut = best["code"][was]
                left = np.where(best["number"][was], np.where(code > 0, code <= cut, best["missing"][was]), code != cut)
                got = first[was] + ~left
                values, here = value[:, a:b].ravel(), np.full(len(here), -1)
                values[some], here[some] = child[got], to[got]
                value[:, a:b], at[:, a:b] = values.reshape(m, -1), here.reshape(m, -1)
            numbers = _record_level(new, model, node, best, own, split, child, cover) if trees else np.zeros(2 * len(split), int)
            model, node = of_model[heavy], numbers[heavy]
        margin += value
        yield done + 1, margin, new


def _record_level(new: list[Tree | None], model, node, best, own, split, child, cover) -> np.ndarray:
    """Adds a level's splits to the trees; the children's numbers."""
    for i in range(len(model)):
        tree = new[model[i]]
        tree.weight[node[i]], tree.cover[node[i]] = float(own[i]), float(best["h"][i])
    out = []
    for k, i in enumerate(split):
        tree, at = new[model[i]], int(node[i])
        tree.feature[at], tree.code[at] = int(best["feature"][i]), int(best["code"][i]) - 1
        tree.missing_left[at], tree.gain[at] = bool(best["missing"][i]), float(best["gain"][i])
        tree.left[at] = tree.add(float(child[2 * k]), float(cover[2 * k]))
        tree.right[at] = tree.add(float(child[2 * k + 1]), float(cover[2 * k + 1]))
        out += [tree.left[at], tree.right[at]]
    return np.array(out, np.int64)


def _shrunk(g: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _gains(gl, hl, g, h, model, of: dict) -> np.ndarray:
    """``candidates`` on arrays: -inf where a child is too light."""
    alpha, lam = of["reg_alpha"][model], of["reg_lambda"][model]

    def worth(g_, h_):
        t = _shrunk(g_, alpha)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h_ + lam > 0, t * t / (h_ + lam), 0.0)

    hr = h - hl
    gain = 0.5 * (worth(gl, hl) + worth(g - gl, hr) - worth(g, h)) - of["gamma"][model]
    least = of["min_child_weight"][model]
    return np.where((hl > 0) & (hr > 0) & (hl >= least) & (hr >= least), gain, -np.inf)


def _best(codes, g, h, at, parts, sizes, features, numeric: int, model: np.ndarray, of: dict) -> dict[str, np.ndarray]:
    """Sums and best cut of each open node; ``row`` is the place of its feature in ``codes``, -1 where nothing gains."""
    k = len(model)
    out = {"gain": np.full(k, LEAST_GAIN), "row": np.full(k, -1), "code": np.zeros(k, np.int64), "missing": np.zeros(k, bool),
           "gl": np.zeros(k), "hl": np.zeros(k), "g": np.zeros(k), "h": np.zeros(k)}

    def chunk(a: int, b: int):
        """(where it lies, node, row, sums) of the training rows in open nodes."""
        h_, node = h[:, a:b].ravel(), at[:, a:b].ravel()
        some = np.flatnonzero((node >= 0) & (h_ >= 0))
        return a, b, node[some], some % (b - a), g[:, a:b].ravel()[some], h_[some]

    held = [chunk(*part) for part in parts] if len(parts) == 1 else None

    def chunks():
        return held or (chunk(*part) for part in parts)

    def sums(f: int, size: int, count: bool) -> list[np.ndarray]:
        total = [np.zeros(k * size, np.int64) for _ in range(2 + count)]
        for a, b, node, row, g_, h_ in chunks():
            key = node * size + codes[f, a:b][row]
            for t, v in zip(total, (g_, h_)):
                t += np.bincount(key, v, k * size).astype(np.int64)
            if count:
                total[2] += np.bincount(key, minlength=k * size)
        return total

    def cells(f: int, size: int) -> tuple[np.ndarray, ...]:
        """(key, g, h) of the cells that occur, in order."""
        got: list[np.ndarray] = []
        for a, b, node, row, g_, h_ in chunks():
            where = node * size + codes[f, a:b][row]
            if k * size <= 4 * len(where):
                key = np.flatnonzero(np.bincount(where))
                here = [key, *(np.bincount(where, v)[key].astype(np.int64) for v in (g_, h_))]
            else:
                key, where = np.unique(where, return_inverse=True)
                here = [key, *(np.bincount(where, v, len(key)).astype(np.int64) for v in (g_, h_))]
            if got:
                key, where = np.unique(np.concatenate([got[0], here[0]]), return_inverse=True)
                both = [np.zeros(len(key), np.int64) for _ in range(2)]
                for t, x, y in zip(both, got[1:], here[1:]):
                    np.add.at(t, where, np.concatenate([x, y]))
                here = [key, *both]
            got = here
        return got[0], got[1] / _UNIT, got[2] / _UNIT

    def take(top, where, code, missing, gl, hl, f):
        for name, v in (("gain", top), ("code", code), ("missing", missing), ("gl", gl), ("hl", hl), ("row", f)):
            out[name][where] = v

    for f, feature in enumerate(features):
        size = sizes[f]
        if feature < numeric:
            none = bool((codes[f] == 0).any())
            g_, h_, *n = (x.reshape(k, size) for x in sums(f, size, none))
            out["g"], out["h"] = g_.sum(axis=1) / _UNIT, h_.sum(axis=1) / _UNIT
            gl, hl = (np.cumsum(x[:, 1:], axis=1) / _UNIT for x in (g_, h_))
            if not gl.shape[1]:
                continue
            if none:  # a cut with the missing values on its right, then the same with them on its left
                gl, hl = (np.stack([x, x + v[:, :1] / _UNIT], axis=2) for x, v in ((gl, g_), (hl, h_)))
                gain = _gains(gl, hl, out["g"][:, None, None], out["h"][:, None, None], model[:, None, None], of)
                gain[n[0][:, 1:] == 0] = -np.inf  # only values that occur are cut at
                gain[:, :, 1][h_[:, 0] == 0] = -np.inf
                gain, gl, hl = (x.reshape(k, -1) for x in (gain, gl, hl))
            else:
                gain = _gains(gl, hl, out["g"][:, None], out["h"][:, None], model[:, None], of)
            top = gain.argmax(axis=1)
            node = np.flatnonzero(gain[np.arange(k), top] > out["gain"])
            top = top[node]
            take(gain[node, top], node, top // (1 + none) + 1, (top % 2 > 0) & none, gl[node, top], hl[node, top], f)
        else:
            key, g_, h_ = cells(f, size)
            if not len(key):
                continue
            owner, code = key // size, key % size
            start = np.append(0, np.flatnonzero(np.diff(owner)) + 1)
            out["g"][owner[start]], out["h"][owner[start]] = np.add.reduceat(g_, start), np.add.reduceat(h_, start)
            gl, hl = out["g"][owner] - g_, out["h"][owner] - h_
            gain = np.where(code > 0, _gains(gl, hl, out["g"][owner], out["h"][owner], model[owner], of), -np.inf)
            top = np.maximum.reduceat(gain, start)
            first = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(start, len(key)))))
            node, where = np.unique(owner[first], return_index=True)
            first = first[where]
            better = gain[first] > out["gain"][node]
            node, first = node[better], first[better]
            take(gain[first], node, code[first], False, gl[first], hl[first], f)
    out["feature"] = np.array(features)[out["row"]]
    out["number"] = out["feature"] < numeric
    return out


def fit(rows: DataFrame, space: Space, settings: Settings = Settings(), label: str = "y") -> Ensemble:
    return fit_many(rows, space, [(settings, None)], label)[0]


# -- scoring --------------------------------------------------------------------------------------


def probabilities(df: DataFrame, models: Sequence[tuple[Ensemble, int | None]], keep: Sequence[str],
                  out: str = "p_pos") -> DataFrame:
    """``keep`` columns and ``out`` (array<double>): the positive-class probability under the first ``n``
    trees of each (ensemble, n). All ensembles share one set of bins."""
    if not models:
        return df.select(*keep, F.array().cast("array<double>").alias(out))
    space = dataclasses.replace(models[0][0].space, slots=None)  # a tree only reads the slots it splits on
    types = [df.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(keep)
            bins = _rows(batch.column(k), len(space.numeric) + 1)
            p = np.stack([_probability(m.margins(bins, n)) for m, n in models], axis=1)
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(models))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(k)), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))],
                names=[*(f"k{i}" for i in range(k)), "p"])

    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(types)), "p array<double>"])
    scored = binned(df, space, keep).mapInArrow(run, schema)
    return scored.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("p").alias(out))


def score(model: Ensemble, df: DataFrame, keep: Sequence[str] = ("review_id", "y")) -> DataFrame:
    """M2: class and positive-class probability per row."""
    one = probabilities(df, [(model, None)], keep, "_p")
    return one.select(*keep, (F.col("_p")[0] > 0.5).cast("int").alias("pred"), F.col("_p")[0].alias("p_pos"))


# -- the saved form ---------------------------------------------------------------------------------

NODES = ("tree int, node int, feature string, cut double, category string, missing_left boolean, left int, "
         "right int, weight double, gain double, cover double, code int")


def node_table(spark: SparkSession, model: Ensemble) -> DataFrame:
    """One row per node; ``feature`` is null in a leaf, ``cut`` set for numbers, ``category`` for values."""
    numeric, rows = len(model.space.numeric), []
    for t, tree in enumerate(model.trees):
        for i, f in enumerate(tree.feature):
            code = tree.code[i]
            value = model.space.labels[code] if f >= numeric else None
            name = None if f < 0 else model.space.numeric[f] if f < numeric else f"category_{value}"
            cut = model.space.cuts[f][code] if 0 <= f < numeric else None
            rows.append((t, i, name, cut, value, tree.missing_left[i], tree.left[i], tree.right[i], tree.weight[i],
                         tree.gain[i], tree.cover[i], code))
    return spark.createDataFrame(rows, NODES)


def save(spark: SparkSession, model: Ensemble, path: str) -> str:
    """The node table and, beside it, one row of settings and bins."""
    node_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = json.dumps({"settings": dataclasses.asdict(model.settings), "space": dataclasses.asdict(model.space)})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load(spark: SparkSession, path: str) -> Ensemble:
    """The ensemble of a saved folder."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    space = Space(**meta["space"])
    place = {n: i for i, n in enumerate(space.numeric)}
    settings = Settings(**meta["settings"])
    trees = []
    for r in spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "node").toLocalIterator():
        if r["node"] == 0:
            trees.append(Tree())
        tree = trees[-1]
        i = tree.add(r["weight"], r["cover"])
        tree.gain[i], tree.left[i], tree.right[i] = r["gain"], r["left"], r["right"]
        tree.code[i], tree.missing_left[i] = r["code"], r["missing_left"]
        if r["feature"] is not None:
            tree.feature[i] = len(space.numeric) if r["category"] is not None else place[r["feature"]]
    return Ensemble(space, settings, trees)


def importances(nodes: DataFrame) -> DataFrame:
    """A11 / A12 from a saved node table: (feature, splits, importance), the mean gain of a feature's splits,
    normalised to sum 1."""
    per = nodes.filter("feature IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("splits"), F.avg("gain").alias("_mean"))
    whole = F.sum("_mean").over(Window.partitionBy())  # one row per feature
    return per.select("feature", "splits", (F.col("_mean") / whole).alias("importance"))


# -- search ---------------------------------------------------------------------------------------


def grid(axes: dict[str, Sequence]) -> list[Settings]:
    """All combinations, the first axis slowest."""
    sets: list[dict] = [{}]
    for name, values in axes.items():
        sets = [{**s, name: v} for s in sets for v in values]
    return [Settings(**s) for s in sets]


def search(rows: DataFrame, space: Space, sets: Sequence[Settings], folds: int = 5, fold: str = "fold",
           label: str = "y") -> DataFrame:
    """M3: (param_id, fold, test_auc, train_auc) of every set, by ROC AUC on the fold left out and on the others.

    Sets that differ only in their number of trees share one fit: the shorter one is its beginning."""
    from veritext.operators import metrics as ME

    longest: dict[Settings, int] = {}
    for s in sets:
        kind = dataclasses.replace(s, n_estimators=0)
        longest[kind] = max(longest.get(kind, 0), s.n_estimators)
    jobs = [(dataclasses.replace(k, n_estimators=n), f) for k, n in longest.items() for f in range(folds)]
    place = {(dataclasses.replace(s, n_estimators=0), f): i for i, (s, f) in enumerate(jobs)}
    asked = [(p, s.n_estimators, f, place[dataclasses.replace(s, n_estimators=0), f])
             for p, s in enumerate(sets, 1) for f in range(folds)]
    marks: list[set[int]] = [set() for _ in jobs]
    for _, n, _, job in asked:
        marks[job].add(n)
    scored = _written(_dealt(_base(rows, space, label, fold), space, jobs, marks))
    auc = F.round(ME._div(F.col("num"), F.col("n_pos") * F.col("n_neg")), 6)
    wide = scored.withColumn("auc", auc).groupBy("job", "n").pivot("role", ["test", "train"]).agg(F.first("auc"))
    names = rows.sparkSession.createDataFrame(asked, "param_id int, n long, fold int, job long")
    return names.join(wide, ["job", "n"]).select("param_id", "fold", F.col("test").alias("test_auc"),
                                                 F.col("train").alias("train_auc"))
