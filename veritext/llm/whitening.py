"""Embedding whitening by spectrum slicing.

Every component c of a vector becomes the whole number x = floor(scale * c) + OFFSET. Counts, sums and the
Gram matrix of the x-vectors are mergeable aggregates: each task sums its own rows, cells are added by a
``groupBy``, and only the d x d matrix of a d-dimensional table reaches the driver, whatever the number of
rows. All of them are exact: vectors are centred at the whole number next to the mean before they are
multiplied, products are summed as whole numbers of any size (limbs of 40 bits), and the covariance
V = (n * G - T T') / n^2, with G and T the products and sums of the centred vectors, is rounded once.

The spectrum is sliced: the inertia of the LDL' factors of V - shift * I (Bunch-Kaufman pivots) counts the
eigenvalues above a shift, bisection on that count isolates each of the leading eigenvalues in an interval
of its own, Rayleigh quotient iteration from inside the interval converges cubically, and counts on both
sides of what it found certify its number. Eigenvalues that rounding cannot tell apart are taken together,
as a basis of their common space. Whitened vectors are projections of x - S/n over sqrt(eigenvalue); their
covariance is summed in one more pass and held against the identity.

Defined results: a vector that is null, or holds a null or non-finite entry, or one whose x has no long
value (2**62 and more), takes no part. All vectors of a table should have one length: the most frequent
one counts (the longer of equals), others take no part. A null id stays a row. Rows that repeat count as
often as they occur. There are as many components as asked for, but no more than eigenvalues above
``RANK`` of the trace: equal vectors, a single vector, empty vectors or an empty table have no component
and give an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Share of the trace below which an eigenvalue counts as zero: rounding leaves it no four digits.
RANK = 2.0 ** -36
_LIMIT = float(1 << 62)
_LIMB = 40
_EXACT = 1 << 53


@dataclass
class Whitening:
    """A fitted model: ``centre`` is the whole number next to each mean of floor(scale * c), ``rest`` the
    sum of what is left (|rest| <= n / 2); ``vectors`` holds one unit eigenvector per column."""

    n: int
    dim: int
    scale: int
    centre: list
    rest: list
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]


def _vectors(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, floor(scale * c) as int64 rows) of the vectors that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # null lists have no values
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    c = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    for d in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == d)
        at = (ends[rows] - d)[:, None] + np.arange(d)[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            z = np.floor(c[at] * scale)
            good = (np.isfinite(z) & (np.abs(z) < _LIMIT) & ~holes[at]).all(axis=1)
        yield int(d), rows[good], z[good].astype(np.int64)


def _limbs(cells: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(cell, limb, part): whole numbers of any size as parts of 40 bits that add up in longs."""
    for cell, value in cells.items():
        limb, low = 0, (1 << _LIMB) - 1
        while value:
            last = -(1 << _LIMB) < value < (1 << _LIMB)
            part = value if last else value & low
            yield cell, limb, part
            value, limb = (0 if last else value >> _LIMB), limb + 1


def _whole(rows: list) -> dict[int, int]:
    out: dict[int, int] = {}
    for r in rows:
        out[r["cell"]] = out.get(r["cell"], 0) + (r["part"] << (_LIMB * r["limb"]))
    return out


def _batch(dims: list, cells: Iterator) -> pa.RecordBatch:
    parts = list(cells)
    return pa.RecordBatch.from_arrays(
        [pa.array(dims * len(parts) if len(dims) == 1 else dims, pa.int32()),
         pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int32()),
         pa.array([p[2] for p in parts], pa.int64())], names=["dim", "cell", "limb", "part"])


_CELLS = "dim int, cell long, limb int, part long"


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("dim", "cell", "limb").agg(F.sum("part").alias("part"))


def _sums(vectors: DataFrame, scale: int) -> DataFrame:
    """Per length: the number of vectors (cell -1) and the sum at each place (cells from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, rows, z in _vectors(batch.column(0), scale):
                if not len(rows):
                    continue
                small = int(np.abs(z).max(initial=0)) * len(z) < 1 << 62
                total = z.sum(axis=0).astype(object) if small else z.astype(object).sum(axis=0)
                n, before = held.get(d, (0, 0))
                held[d] = (n + len(rows), before + total)
        for d, (n, total) in held.items():
            yield _batch([d], _limbs({-1: n, **{i: int(v) for i, v in enumerate(total)}}))

    return _summed(vectors.mapInArrow(run, _CELLS))


def _products(u: np.ndarray) -> np.ndarray:
    """u'u in whole numbers of any size."""
    most = int(np.abs(u).max(initial=0)) ** 2 * max(len(u), 1)
    if most < _EXACT:  # every partial sum is a double
        f = u.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most < 1 << 62:
        return (u.T @ u).astype(object)
    big = u.astype(object)
    return big.T @ big


def _gram(vectors: DataFrame, scale: int, dim: int, centre: list) -> DataFrame:
    """Upper cells i * dim + j of the products of the centred vectors, and their sums (cells -1 - i)."""
    upper = [(i * dim + j, i, j) for i in range(dim) for j in range(i, dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, gram, total = np.array(centre, np.int64), None, None
        for batch in batches:
            for d, rows, z in _vectors(batch.column(0), scale):
                if d != dim or not len(rows):
                    continue
                u = z - middle
                g, s = _products(u), u.astype(object).sum(axis=0)
                gram, total = (g, s) if gram is None else (gram + g, total + s)
        if gram is not None:
            yield _batch([dim], _limbs({**{cell: int(gram[i, j]) for cell, i, j in upper},
                                        **{-1 - i: int(v) for i, v in enumerate(total)}}))

    return _summed(vectors.mapInArrow(run, _CELLS))


# -- the spectrum of a symmetric matrix ---------------------------------------------------------


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``a`` above ``shift``: positive pivots of LDL' of a - shift * I."""
    m, k, above = a - shift * np.eye(len(a)), 0, 0
    ratio = (1 + 17 ** 0.5) / 8
    while k < len(m):
        step = 1
        if k + 1 < len(m):
            column = np.abs(m[k + 1:, k])
            r = k + 1 + int(column.argmax())
            most, own = float(column.max()), abs(float(m[k, k]))
            if own < ratio * most:
                row = np.abs(m[r, k:])
                row[r - k] = 0
                widest = float(row.max())
                if own * widest < ratio * most * most:
                    at = k if abs(float(m[r, r])) >= ratio * widest else k + 1
                    step = 1 if at == k else 2
                    if at != r:
                        m[[at, r]] = m[[r, at]]
                        m[:, [at, r]] = m[:, [r, at]]
        if step == 1:
            pivot = float(m[k, k])
            above += pivot > 0
            if pivot:
                v = m[k + 1:, k].copy()
                m[k + 1:, k + 1:] -= np.outer(v, v) / pivot
        else:  # such a block has one eigenvalue on each side of zero
            above += 1
            c = m[k + 2:, k:k + 2].copy()
            change = c @ np.linalg.solve(m[k:k + 2, k:k + 2], c.T)
            m[k + 2:, k + 2:] -= (change + change.T) / 2  # symmetric to the last bit
        k += step
    return above


def _step(a: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    eye = np.eye(len(a))
    for nudge in (0.0, 1e-15, 1e-13):
        try:
            y = np.linalg.solve(a - (shift + nudge * max(abs(shift), np.abs(a).max())) * eye, x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    return x


def _aside(x: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """``x`` orthogonal to the vectors found so far, of length one."""
    for _ in range(2):
        for v in known:
            x = x - v * (v @ x)
    return x / np.linalg.norm(x)


def _quotient(a: np.ndarray, low: float, high: float, known: list[np.ndarray],
              rng: np.random.Generator) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration for the one eigenvalue between ``low`` and ``high``; None if it leaves."""
    x = _aside(rng.standard_normal(len(a)), known)
    for _ in range(2):
        x = _aside(_step(a, (low + high) / 2, x), known)
    value, best, held = float(x @ a @ x), np.inf, None
    for _ in range(12):
        residual = float(np.linalg.norm(a @ x - value * x))
        if residual < best:
            best, held = residual, (value, x)
        elif best < np.inf:
            break
        x = _aside(_step(a, value, x), known)
        value = float(x @ a @ x)
    value, x = held
    close = best <= 1e-12 * np.abs(a).max() * len(a)
    return (value, x) if low < value <= high and close else None


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of the symmetric ``a``, falling, and unit eigenvectors as columns."""
    size = float(np.abs(a).sum(axis=1).max(initial=0.0))
    least = 64 * np.finfo(float).eps * size  # closer than this, counts cannot tell
    counts = {-size - least: len(a), size + least: 0}
    rng, values, found = np.random.default_rng(11), [], []
    while len(found) < k:
        number = len(found) + 1
        low = max(s for s, c in counts.items() if c >= number)
        high = min(s for s, c in counts.items() if c < number)
        alone = counts[low] == number and counts[high] == number - 1
        got = _quotient(a, low, high, found, rng) if alone else None
        if got is not None:
            values.append(got[0])
            found.append(got[1])
        elif high - low <= least:  # a group that rounding cannot split: any basis of its space
            group = counts[low] - len(found)
            basis = [rng.standard_normal(len(a)) for _ in range(group)]
            for _ in range(4):
                fresh: list[np.ndarray] = []
                for x in basis:
                    fresh.append(_aside(_step(a, (low + high) / 2, x), found + fresh))
                basis = fresh
            basis.sort(key=lambda x: -float(x @ a @ x))
            values += [float(x @ a @ x) for x in basis]
            found += basis
        else:
            middle = (low + high) / 2
            counts[middle] = count_above(a, middle)
    values, found = values[:k], found[:k]
    for number, value in enumerate(values, 1):
        if count_above(a, value + 2 * least) >= number or count_above(a, value - 2 * least) < number:
            raise ArithmeticError(f"eigenvalue {number} is not certified by its counts")
    return np.array(values), np.array(found).T.reshape(len(a), len(values))


# -- fitting and applying -------------------------------------------------------------------------


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """The whitening of all vectors of ``df`` that take part."""
    vectors = df.select(vector_col)
    sums = written(_sums(vectors, scale), "whiten-sums")
    most = (sums.filter("cell = -1").groupBy("dim").agg(
        F.sum(F.col("part") * F.pow(F.lit(2.0), F.col("limb") * _LIMB)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first())
    empty = Whitening(0, 0, scale, [], [], 0.0, np.zeros(0), np.zeros((0, 0)))
    if most is None or most["dim"] == 0:
        return empty
    dim = most["dim"]
    cells = _whole(sums.filter(F.col("dim") == dim).collect())  # one number per place of a vector
    n = cells.pop(-1)
    total = [cells.get(i, 0) for i in range(dim)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    gram = _whole(_gram(vectors, scale, dim, centre).collect())  # dim * (dim + 1) / 2 cells
    v = np.zeros((dim, dim))
    trace = 0
    for i in range(dim):
        for j in range(i, dim):
            exact = n * gram.get(i * dim + j, 0) - rest[i] * rest[j]
            v[i, j] = v[j, i] = exact / (n * n)
            trace += exact if i == j else 0
    trace = trace / (n * n)
    k = min(components, count_above(v, RANK * trace)) if trace > 0 else 0
    values, axes = leading(v, k)
    return Whitening(n, dim, scale, centre, rest, trace, values, axes)


def _projected(model: Whitening, z: np.ndarray) -> np.ndarray:
    u = (z - np.array(model.centre, np.int64)).astype(np.float64)
    return (u - np.array([r / model.n for r in model.rest])) @ (model.vectors / np.sqrt(model.values))


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.values)
    if k == 0:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for d, rows, z in _vectors(batch.column(0), model.scale):
                if d == model.dim and len(rows):
                    p = _projected(model, z)  # of centred vectors: their mean is zero up to rounding
                    second += p.T @ p
                    first += p.sum(axis=0)
        cells = np.concatenate([second.ravel(), first])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)],
                                         names=["cell", "part"])

    sums = df.select(vector_col).mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part"))
    cells = {r["cell"]: r["part"] for r in sums.collect()}  # k * (k + 1) numbers
    second = np.array([cells[i] for i in range(k * k)]).reshape(k, k) / model.n
    mean = np.array([cells[k * k + i] for i in range(k)]) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def transform(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of every vector that takes part; deviation is
    the exact sum over places of (n * x - S)^2, null beyond 38 digits."""
    rest = max((abs(r) for r in model.rest), default=0)
    id_type = df.schema[id_col].dataType.simpleString()

    def deviations(z: np.ndarray) -> pa.Array:
        u = z - np.array(model.centre, np.int64)
        most = model.n * int(np.abs(u).max(initial=0)) + rest
        kind = np.int64 if most * most * model.dim < 1 << 63 else object
        far = u.astype(kind) * model.n - np.array(model.rest, kind)
        total = (far * far).sum(axis=1)
        if kind is object:
            return pa.array([Decimal(v) if v < 10 ** 38 else None for v in total], pa.decimal128(38, 0))
        return pa.array(total).cast(pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for d, rows, z in _vectors(batch.column(1), model.scale):
                if d != model.dim or k == 0 or not len(rows):
                    continue
                flat = pa.array(_projected(model, z).ravel())
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), deviations(z), whitened],
                                                 names=["id", "deviation", "whitened"])

    out = df.select(id_col, vector_col).mapInArrow(run, f"id {id_type}, deviation decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("id", id_col)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(df, vector_col, components, scale)
    error = identity_error(df, model, vector_col)
    shares = F.array(*(F.lit(s) for s in model.explained)) if model.explained else F.array().cast("array<double>")
    rows = transform(df, model, id_col, vector_col).select(
        F.col(id_col), "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    return rows.select(
        F.col(id_col), (F.col("_place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("_place")).alias("explained"), F.lit(error).alias("identity_error"))
