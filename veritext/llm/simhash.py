"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within ``max_bits`` differing bits are linked; connected documents are one component.

* Equal fingerprints are one node (pre-aggregated), so a group of copies of any size costs one row.
* The upper nodes of the index are masked bit patterns that a group of fingerprints shares. Bits split
  into ``max_bits + 1`` blocks: two linked fingerprints agree on at least one whole block, so each is
  put under one upper node per block. A node with more than ``NODE_MAX`` members is refined: the bits
  that its pattern leaves open are split again in the same way, until every node is small enough.
  The differences are all within the open bits, so no link is lost at any level, and nothing is capped.
* Below an upper node, fingerprints are sorted by Gray rank. Runs of neighbours agree on further bits;
  those shared bits are factored into inner nodes. A search adds up the differences along the path and
  drops a whole group once they exceed ``max_bits``.
* A node reports a tree over its connected members instead of its pairs, and the trees are contracted
  to components by rounds of joins. No links, components or fingerprints come to the driver.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows and ids keep a row each; a
component whose ids are all null has a null id; an empty table gives an empty result; a long text is read
whole, eight bytes per word. Of the other columns only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.common import written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
NODE_MAX = 1024
#: Members of an inner node, and of its parent in inner nodes.
FAN = 16
#: Children per node of the trees that stand for connected members.
TREE = 8


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text: a bit is set if it is in over half the shingles' hashes."""
    w = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) < shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the text replaced by ``fp`` (long)."""
    names = [c for c in df.columns if c not in (text_col, "fp")]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            fps = [fingerprint_of(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps, pa.int64())],
                                             names=[*names, "fp"])

    return df.select(*names, text_col).mapInArrow(run, schema)


# -- the index --------------------------------------------------------------------------------


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def split_mask(taken: int, parts: int) -> list[int]:
    """Blocks that the bits outside ``taken`` split into."""
    open_ = [i for i in range(64) if not taken >> i & 1]
    cut = [len(open_) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in open_[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _under(rows: DataFrame, masks: dict[int, int], parts: int) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` (fp, node) put under each child of their node: (fp, node, pattern). ``masks``: the mask
    of each node number that occurs, at most ``parts ** level`` of them."""
    children = {n: [(n * parts + 1 + k, m | b) for k, b in enumerate(split_mask(m, parts))] for n, m in masks.items()}
    table = F.create_map(*(x for n, cs in children.items() for x in (
        F.lit(n), F.array(*(F.struct(F.lit(c).alias("node"), F.lit(_signed(m)).cast("long").alias("mask"))
                            for c, m in cs)))))
    out = rows.withColumn("_c", F.explode(F.element_at(table, F.col("node"))))
    out = out.select("fp", F.col("_c.node").alias("node"), F.col("fp").bitwiseAND(F.col("_c.mask")).alias("pattern"))
    return out, {c: m for cs in children.values() for c, m in cs}


def links(fps: DataFrame, max_bits: int = MAX_BITS, node_max: int = NODE_MAX) -> DataFrame:
    """(a, b): trees over the connected members of every upper node. ``fps``: distinct (fp)."""
    parts = max_bits + 1
    rows, masks = fps.select("fp", F.lit(0).alias("node")), {0: 0}
    small = None
    while True:
        rows, masks = _under(rows, masks, parts)
        open_bits = max(64 - m.bit_count() for m in masks.values())
        if 1 << open_bits <= node_max:  # a node holds distinct fingerprints: it cannot be larger
            fits, large = rows, None
        else:
            sizes = rows.groupBy("node", "pattern").count().filter(F.col("count") > node_max)
            large = written(sizes.select(F.col("node").alias("_n"), F.col("pattern").alias("_p")), "simhash-large")
            numbers = [r[0] for r in large.select("_n").distinct().collect()]  # at most parts ** level
            inside = (F.col("node") == F.col("_n")) & (F.col("pattern") == F.col("_p"))
            fits = rows.join(large, inside, "left_anti") if numbers else rows
        small = fits if small is None else small.unionByName(fits)
        if large is None or not numbers:
            break
        rows = rows.join(large, inside, "left_semi").select("fp", "node")
        masks = {n: masks[n] for n in numbers}
    ordered = (small.repartition("node", "pattern").withColumn("_gray", gray_rank(F.col("fp")))
               .sortWithinPartitions("node", "pattern", F.shiftrightunsigned("_gray", 1), "_gray"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "pattern", "fp")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            if not len(change):
                rest = now
                continue
            yield _edges(now[2][:change[-1]], change, max_bits)
            rest = [x[change[-1]:] for x in now]
        if rest is not None and len(rest[2]):
            yield _edges(rest[2], np.array([len(rest[2])]), max_bits)

    return ordered.select("node", "pattern", "fp").mapInArrow(run, "a long, b long")


def _edges(fp: np.ndarray, ends: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Tree edges of consecutive groups of ``fp`` that end at ``ends``."""
    x = fp.view(np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    a, b = [], []

    def tree(members: np.ndarray) -> None:
        at = np.arange(1, len(members))
        a.append(members[at])
        b.append(members[(at - 1) // TREE])

    # small groups: compare neighbours at each distance, all groups at once
    little = sizes <= FAN
    group = np.repeat(np.arange(len(ends)), sizes)
    base = np.flatnonzero(np.repeat(little & (sizes > 1), sizes))
    pairs = []
    for d in range(1, int(sizes[little].max(initial=1))):
        i = base[base + d < len(x)]
        i = i[group[i] == group[i + d]]
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= max_bits]
        pairs.append(np.stack([i, i + d], axis=1))
    if pairs and (pairs := np.concatenate(pairs)).size:
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        for i, j in pairs.tolist():
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
        nodes = np.array(sorted(parent))
        roots = np.array([find(v) for v in nodes.tolist()])
        order = np.argsort(roots, kind="stable")
        for members in np.split(nodes[order], np.flatnonzero(np.diff(roots[order])) + 1):
            tree(fp[members])
    for k in np.flatnonzero(~little):
        for members in _connected(x[starts[k]:ends[k]], max_bits):
            tree(fp[starts[k]:ends[k]][members])
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cat(a), pa.int64()), pa.array(cat(b), pa.int64())], names=["a", "b"])


def _nodes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, pattern) shared by each run of FAN neighbours."""
    at = np.arange(0, len(x), FAN)
    both, any_ = np.bitwise_and.reduceat(x, at), np.bitwise_or.reduceat(x, at)
    return ~(both ^ any_), both


def _connected(x: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    """Index sets of the connected members of one Gray-sorted group (two or more members each)."""
    n = len(x)
    mask, pattern = _nodes(x)
    up = np.arange(0, len(mask), FAN)  # the bits that all inner nodes of a run share move up
    first = np.repeat(pattern[up], np.diff(np.append(up, len(mask))))
    top_mask = np.bitwise_and.reduceat(mask & ~(pattern ^ first), up)
    top_pattern = pattern[up]
    extra = mask & ~np.repeat(top_mask, np.diff(np.append(up, len(mask))))
    open_ = np.ones(n, bool)
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        found, todo = [seed], [seed]
        while todo:
            q = x[todo.pop()]
            above = np.bitwise_count((q ^ top_pattern) & top_mask)
            tops = np.flatnonzero(above <= max_bits)
            inner = (tops[:, None] * FAN + np.arange(FAN)).ravel()
            so_far = np.repeat(above[tops], FAN)
            so_far, inner = so_far[inner < len(mask)], inner[inner < len(mask)]
            inner = inner[so_far + np.bitwise_count((q ^ pattern[inner]) & extra[inner]) <= max_bits]
            rows = (inner[:, None] * FAN + np.arange(FAN)).ravel()
            rows = rows[rows < n]
            rows = rows[open_[rows]]
            rows = rows[np.bitwise_count(x[rows] ^ q) <= max_bits]
            open_[rows] = False
            found.extend(rows.tolist())
            todo.extend(rows.tolist())
        if len(found) > 1:
            yield np.array(sorted(found))


# -- components -------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): each round points a node at the neighbour (or
    itself) of least hash and contracts the graph; the rounds' maps are then composed."""
    left = written(edges.filter("a <> b").distinct(), "simhash-edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(maps)
        both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
            left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        best = both.groupBy("v").agg(F.min(F.struct(F.xxhash64("w", F.lit(turn)), "w")).alias("m"))
        own = F.struct(F.xxhash64("v", F.lit(turn)).alias("col1"), F.col("v").alias("w"))
        to = written(best.select("v", F.when(F.col("m") < own, F.col("m.w")).otherwise(F.col("v")).alias("p")),
                     "simhash-map")
        maps.append(to)
        ta, tb = to.toDF("va", "pa"), to.toDF("vb", "pb")
        step = left.join(ta, F.col("a") == F.col("va")).join(tb, F.col("b") == F.col("vb"))
        step = step.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left = written(step.distinct(), "simhash-edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = maps[-1].toDF("node", "root")
    for m in reversed(maps[:-1]):
        up = out.toDF("_n", "_r")
        out = m.join(up, F.col("p") == F.col("_n"), "left").select(
            F.col("v").alias("node"), F.coalesce("_r", "p").alias("root"))
    return written(out, "simhash-components")


def _placed(docs: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of every fingerprint of ``docs``."""
    nodes = docs.select("fp").distinct()
    roots = components(links(nodes, max_bits))
    return written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("_root")), "simhash-placed")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id): 16 hex digits, and the smallest id reachable by links."""
    docs = written(fingerprints(df.select(id_col, text_col), text_col, shingle), "simhash-fingerprints")
    placed = _placed(docs, max_bits)
    least = docs.groupBy("fp").agg(F.min(id_col).alias("_least")).join(placed, F.col("fp") == F.col("_fp"))
    named = least.groupBy("_root").agg(F.min("_least").alias("component_id")).withColumnRenamed("_root", "_r")
    named = placed.join(named, F.col("_root") == F.col("_r")).select("_fp", "component_id")
    return docs.join(named, F.col("fp") == F.col("_fp")).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``df`` per component: the one of smallest id (a null id comes last, then by the hash of
    the text)."""
    row = F.col("row")
    rows = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"))  # no name of the input is in the way
    rows = rows.select("row", row[id_col].alias("id"), F.xxhash64(row[text_col]).alias("version"), row[text_col].alias("text"))
    docs = written(fingerprints(rows.select("id", "version", "text"), "text", shingle), "simhash-fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "version"))
    placed = _placed(docs, max_bits)
    best = docs.groupBy("fp").agg(first.alias("m")).join(placed, F.col("fp") == F.col("_fp"))
    best = best.groupBy("_root").agg(F.min("m").alias("m")).select(F.col("m.id").alias("_id"), F.col("m.version").alias("_v"))
    times = docs.groupBy(F.col("id").alias("_i"), F.col("version").alias("_w")).agg(F.count(F.lit(1)).alias("times"))
    best = written(best.join(times, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_v") == F.col("_w"))).select(
        "_id", "_v", "times"), "simhash-representatives")
    kept = rows.select("row", "id", "version").join(best, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v")))
    # equal rows are one document; only such rows are moved again
    once = kept.filter("times = 1").unionByName(kept.filter("times > 1").dropDuplicates(["id", "version"]))
    return once.select(*(row[c].alias(c) for c in df.columns))
