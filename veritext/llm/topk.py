"""Exact top-k inner products over norm-sorted vectors.

Vectors (whole numbers: floor(scale * x)) are range-partitioned by descending length and packed into
blocks. Queries are packed too. The block of longest vectors gives every query a first k-th best score;
then each query block meets the vector blocks that can still matter: as blocks are sorted by length, they are
a prefix of the list of block lengths. Pairs meet by equi-joins on block numbers, the vectors' join last, so
that a block of vectors moves once and its rotation is computed once for all queries. Within a pair of blocks,
vectors are taken by descending length until |q| * |v| falls below the query's k-th best; the others are
rotated by the singular vectors of their block, the leading coordinates give partial sums, and Cauchy-Schwarz
on the residual coordinates bounds the rest. What the bound cannot exclude is scored exactly in whole numbers.
Bounds carry a margin above their rounding error and never exclude an equal score, so results are exact and
ties go to the smaller id.

Defined results: a vector that is null, or holds a null or non-finite component or one whose whole number has
no long value (2**62 and more), and a row with a null id take no part; vectors only meet vectors of their own
length (an empty one scores 0); a query's candidates are all rows but its own, also those that share its id,
and rows that repeat a query each answer for themselves; scores are exact, as decimal(38,0); an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import written

SCALE = 256
V_BLOCK = 4096
Q_BLOCK = 2048
#: Queries of a block that are scored at once.
SLICE = 256
#: Share of a block's squared length that the leading rotated coordinates hold.
LEADING = 0.7
#: One pair in so many left by the bounds: from there on one matrix product scores them, below it each pair alone.
DENSE = 16
_LIMIT = float(1 << 62)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id long, row long, dim int, norm double, v binary): the rows that take part, components as int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, dims, norms, data = [], [], [], [], []
            for key, row, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key is None or not item.is_valid or item.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(item.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if not (np.isfinite(x) & (np.abs(x) < _LIMIT)).all():
                    continue
                ids.append(key)
                rows.append(row)
                dims.append(len(x))
                norms.append(float(np.linalg.norm(x)))
                data.append(x.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(dims, pa.int32()),
                 pa.array(norms, pa.float64()), pa.array(data, pa.binary())], names=["id", "row", "dim", "norm", "v"])

    return df.select(F.col(id_col).cast("long"), F.monotonically_increasing_id(), vector_col).mapInArrow(
        run, "id long, row long, dim int, norm double, v binary")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` neighbours of one dimension: (block, dim, top_norm, ids, rows, norms, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def block(take: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made], pa.int64()), pa.array([take[0][2]], pa.int32()),
                 pa.array([max(r[3] for r in take)], pa.float64()),
                 *(pa.array([np.array([r[i] for r in take], np.int64).tobytes()], pa.binary()) for i in (0, 1)),
                 pa.array([np.array([r[3] for r in take], np.float64).tobytes()], pa.binary()),
                 pa.array([b"".join(r[4] for r in take)], pa.binary())],
                names=["block", "dim", "top_norm", "ids", "rows", "norms", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "dim", "norm", "v"))):
                if held and (len(held) == size or held[0][2] != row[2]):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return rows.mapInArrow(run, "block long, dim int, top_norm double, ids binary, rows binary, norms binary, data binary")


def _by_norm(rows: DataFrame, size: int) -> DataFrame:
    order = [F.col("dim"), F.col("norm").desc(), F.col("id"), F.col("row")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _packed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), size)


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(n, dim)


def rotation(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(axes, rotated vectors, number of leading coordinates) of a block."""
    fv = v.astype(np.float64)
    values, axes = np.linalg.eigh(fv.T @ fv)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    lead = int(np.searchsorted(np.cumsum(values), LEADING * values.sum())) + 1
    return axes, fv @ axes, min(max(lead, 1), v.shape[1])


def block_scores(q: np.ndarray, v: np.ndarray, q_norm: np.ndarray, v_norm: np.ndarray, least: np.ndarray,
                 turned: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, exact score) of every pair that reaches ``least`` of its query (less a margin); ``v`` by
    descending length, ``turned`` its rotation."""
    margin = 1e-9 * q_norm * (v_norm[0] if len(v_norm) else 0.0) + 1e-6
    reach = least - margin  # bounds below this cannot tie or beat the k-th best
    counts = np.array([np.searchsorted(-v_norm * qn, -r, side="right") for qn, r in zip(q_norm, reach)], np.int64)
    most = int(counts.max(initial=0))
    if most == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    dim = v.shape[1]
    if dim:
        axes, rv, lead = turned if turned is not None else rotation(v)
        rq, rv = q.astype(np.float64) @ axes, rv[:most]
        bound = rq[:, :lead] @ rv[:, :lead].T
        bound += np.linalg.norm(rq[:, lead:], axis=1)[:, None] * np.linalg.norm(rv[:, lead:], axis=1)[None, :]
    else:
        bound = np.zeros((len(q), most))
    able = (bound >= reach[:, None]) & (np.arange(most)[None, :] < counts[:, None])
    i, j = np.nonzero(able)
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(dim, 1)
    if largest < 1 << 53 and DENSE * len(i) > able.size:  # every sum is a whole number that a double holds
        scores = (q.astype(np.float64) @ v[:most].astype(np.float64).T)[i, j].astype(np.int64)
    else:
        kind = np.int64 if largest < 1 << 62 else object
        scores = np.empty(len(i), kind)
        for at in range(0, len(i), 1 << 15):
            part = slice(at, at + (1 << 15))
            scores[part] = (q[i[part]].astype(kind) * v[j[part]].astype(kind)).sum(axis=1)
    enough = scores.astype(np.float64) >= reach[i]
    i, j, scores = i[enough], j[enough], scores[enough]
    return i, j, scores


_FOUND = "q_block long, q_row int, query_id long, vec_id long, row long, score decimal(38,0)"


def _pair_top(pairs: DataFrame, k: int) -> DataFrame:
    """(q_block, q_row, query_id, vec_id, row, score): the k best of each query within each pair of blocks.
    Rows of one vector block stand together, so its rotation serves all of them."""

    def best(r: dict, block: tuple) -> pa.RecordBatch:
        v, vi, vr, vn, turned = block
        qi, qr, qn = (np.frombuffer(r[c], t) for c, t in (("q_ids", np.int64), ("q_rows", np.int64), ("q_norms", np.float64)))
        q, least = _matrix(r["q_data"], len(qi), r["dim"]), np.array(r["least"], np.float64)
        found = []
        for at in range(0, len(q), SLICE):
            i, j, s = block_scores(q[at:at + SLICE], v, qn[at:at + SLICE], vn, least[at:at + SLICE], turned)
            i = i + at
            other = qr[i] != vr[j]
            i, j, s = i[other], j[other], s[other]
            order = sorted(range(len(i)), key=lambda x: (i[x], -s[x], vi[j[x]])) if s.dtype == object else np.lexsort((vi[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            found.append((i[rank < k], j[rank < k], [int(x) for x in s[rank < k]]))
        i, j = (np.concatenate([f[c] for f in found]) for c in (0, 1))
        score = pa.array([Decimal(x) for f in found for x in f[2]], pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), r["q_block"], np.int64)), pa.array(i.astype(np.int32)), pa.array(qi[i]), pa.array(vi[j]),
             pa.array(vr[j]), score], names=["q_block", "q_row", "query_id", "vec_id", "row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if r["block"] != now:
                    vn = np.frombuffer(r["norms"], np.float64)
                    order = np.argsort(-vn, kind="stable")
                    v = _matrix(r["data"], len(vn), r["dim"])[order]
                    now, block = r["block"], (v, *(np.frombuffer(r[c], np.int64)[order] for c in ("ids", "rows")), vn[order],
                                              rotation(v) if r["dim"] else None)
                yield best(r, block)

    return pairs.select("block", "dim", "q_block", "q_ids", "q_rows", "q_norms", "q_data", "least", "ids", "rows", "norms",
                        "data").mapInArrow(run, _FOUND)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, v_block: int = V_BLOCK, q_block: int = Q_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row with ``is_query`` (a condition
    on ``id``), all other rows being candidates; ``score`` is decimal(38,0)."""
    rows = written(quantised(df, id_col, vector_col, scale), "topk-vectors")
    blocks = written(_by_norm(rows, v_block), "topk-blocks")
    queries = written(_by_norm(rows.filter(is_query), q_block), "topk-queries").select(
        F.col("block").alias("q_block"), "dim", F.col("top_norm").alias("q_norm"), F.col("ids").alias("q_ids"),
        F.col("rows").alias("q_rows"), F.col("norms").alias("q_norms"), F.col("data").alias("q_data"))

    # the block of longest vectors of each dimension: one per dimension
    lead = blocks.groupBy("dim").agg(F.max(F.struct("top_norm", F.negative("block").alias("b"))).alias("m"))
    lead = lead.select((-F.col("m.b")).alias("block"))
    start = blocks.join(lead, "block").drop("top_norm")
    none = F.array_repeat(F.lit(float("-inf")), (F.octet_length("q_ids") / 8).cast("int"))
    first = written(_pair_top(queries.withColumn("least", none).join(start, "dim"), k), "topk-first")

    # k-th best so far, per query row; fewer than k leave it open
    known = first.groupBy("q_block", "q_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    known = known.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct(  # one block's rows
        "q_row", F.when(F.col("n") >= k, F.col("s").cast("double")).otherwise(float("-inf"))))).alias("_m"))
    least = F.transform(F.sequence(F.lit(0), (F.octet_length("q_ids") / 8 - 1).cast("int")),
                        lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(float("-inf"))))
    aimed = written(queries.join(known.withColumnRenamed("q_block", "_qb"), F.col("q_block") == F.col("_qb"), "left")
                    .withColumn("least", least).drop("_qb", "_m"), "topk-aimed")

    # blocks by falling length, one list per dimension: a query block needs a prefix of it
    by_length = blocks.join(lead, "block", "left_anti").groupBy(F.col("dim").alias("_dim")).agg(F.sort_array(F.collect_list(
        F.struct("top_norm", "block")), asc=False).alias("by_length"))
    asks = aimed.select("q_block", "dim", "q_norm", F.array_min("least").alias("_least")).join(
        by_length, F.col("dim") == F.col("_dim"))
    matters = F.filter("by_length", lambda b: F.col("q_norm") * b["top_norm"] * (1 + 1e-9) + 1e-6 >= F.col("_least"))
    meet = asks.select("q_block", F.explode(matters).alias("b")).select("q_block", F.col("b.block").alias("block"))
    pairs = meet.join(aimed, "q_block").join(blocks.drop("dim", "top_norm"), "block").sortWithinPartitions("block")
    rest = _pair_top(pairs, k)

    best = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id", "row")
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
