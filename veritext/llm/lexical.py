"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

The items of a query set are searched in all documents. A document's terms are counted once into a compact
index (ids and counts of the terms that the items ask for), written to the shared folder; the number of
documents, of terms, and of documents per term follow from it by mergeable sums. Each task then takes the
documents of its files in blocks of bounded size, turns a block into postings, and evaluates the items
term at a time, rarest term first: a posting adds its part to its document's accumulator, or creates it.
Once all terms still to come, each at its greatest part within the block, cannot lift a new document to the
k-th best partial score (of this block, or final in an earlier block of the task), no accumulator is
created any more; the survivors are still updated by all remaining terms, so that their scores are exact.
A new document that could only tie with the k-th best is still let in, as ties go to the smaller id. The k
best of each task meet in one ranking per item.

The query set is taken in blocks of ``QUERY_TERMS`` different (item, term) pairs at about most, which are
sent to the tasks; a larger query set is more passes over the documents, never a larger broadcast.

Defined results: a null or empty text has no term and scores nothing; rows of documents are documents, also
if they share an id; a null id ranks after all others; rows of one item id (null is one item) are one item,
and its different texts add up (a repeated row of an item changes nothing); an item without a term, or
whose terms no document holds, has no rows; an empty table on either side gives an empty result. Texts are
read whole, one at a time. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import written

K = 20
#: Different (item, term) pairs per pass over the documents, at about most.
QUERY_TERMS = 200_000
#: Documents and postings per block of a task.
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 2_000_000
_SAFE = 1 << 62

_TERM = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
#: A-Z lower-cased, and every byte that no term holds made a blank.
_FOLDED = bytes((chr(c).lower().encode()[0] if c < 0x80 else c) if c in _TERM else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_FOLDED).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def asked(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, reps): the terms of each item, and how often its texts hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, reps = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                counts: dict[bytes, int] = {}
                for t in terms(text):
                    counts[t] = counts.get(t, 0) + 1
                ids += [key] * len(counts)
                found += counts.keys()
                reps += counts.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()),
                                              pa.array(reps, pa.int64())], names=["item", "term", "reps"])

    distinct = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).distinct()
    return distinct.mapInArrow(run, "item long, term binary, reps long").groupBy("item", "term").agg(
        F.sum("reps").alias("reps"))


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, ids, tfs): number of terms per document, and ids (int32) and counts (int64) of asked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for text in _texts(batch.column(1)):
                found = terms(text)
                sizes.append(len(found))
                known = [vocabulary[t] for t in found if t in vocabulary]
                at, n = np.unique(np.array(known, np.int32), return_counts=True)
                ids.append(at.tobytes())
                tfs.append(n.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array(tfs, pa.binary())], names=["doc", "n", "ids", "tfs"])

    return docs.mapInArrow(run, "doc long, n long, ids binary, tfs binary")


def _document_counts(index: DataFrame, size: int) -> np.ndarray:
    """Documents per term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["id", "df"])

    out = np.zeros(size, np.int64)
    counts = index.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df"))
    for r in counts.toLocalIterator():  # one row per term of a block of the query set
        out[r["id"]] = r["df"]
    return out


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) per term."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """75 + 25 n N div L per document."""
    if 25 * int(n.max(initial=0)) * docs < _SAFE:
        return 75 + 25 * n * docs // total
    return np.array([75 + 25 * int(v) * docs // total for v in n], np.int64)


class Block:
    """The postings of some documents: per term, document places and score parts, and the greatest part."""

    def __init__(self, ids: np.ndarray, tfs: np.ndarray, place: np.ndarray, m: np.ndarray, weight: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.terms, starts = np.unique(ids[order], return_index=True)
        self.ends = np.append(starts, len(order))
        self.place = place[order]
        tf = tfs[order]
        self.part = weight[ids[order]] * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.place]))
        self.most = np.maximum.reduceat(self.part, starts) if len(order) else np.zeros(0, np.int64)
        self.size = len(m)

    def best(self, item: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(document places, exact scores) of all that may be among the ``k`` best, given ``floor``, the k-th
        best score known so far. ``item``: (term, repeats), rarest first."""
        wanted = np.array([t for t, _ in item], self.terms.dtype)
        at = np.searchsorted(self.terms, wanted)
        here = [(int(a), r) for a, w, (_, r) in zip(at, wanted, item) if a < len(self.terms) and self.terms[a] == w]
        bound = [r * int(self.most[a]) for a, r in here]
        left, reached = sum(bound), 0
        score, live, creating = np.zeros(self.size, np.int64), np.zeros(self.size, bool), True
        for (a, reps), most in zip(here, bound):
            if creating and left < max(floor, reached):
                # the k-th best partial score is only looked up where it could decide
                kth = floor
                alive = score[live]
                if len(alive) >= k:
                    kth = max(kth, int(np.partition(alive, len(alive) - k)[len(alive) - k]))
                creating = left >= kth
            docs, part = self.place[self.ends[a]:self.ends[a + 1]], self.part[self.ends[a]:self.ends[a + 1]]
            if creating:
                live[docs] = True
            else:
                old = live[docs]
                docs, part = docs[old], part[old]
            score[docs] += reps * part
            left, reached = left - most, reached + most
        found = np.flatnonzero(live & (score > 0))
        return found, score[found]


def _ranked(index: DataFrame, queries: list[tuple], weight: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(item, doc, score): the ``k`` best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)
        held: list = []

        def search() -> None:
            ids = np.frombuffer(b"".join(r[2] for r in held), np.int32)
            tfs = np.frombuffer(b"".join(r[3] for r in held), np.int64)
            place = np.repeat(np.arange(len(held)), [len(r[2]) // 4 for r in held])
            none = np.array([r[0] is None for r in held])
            names = np.array([r[0] or 0 for r in held], np.int64)
            block = Block(ids, tfs, place, lengths(np.array([r[1] for r in held], np.int64), docs, total), weight)
            for i, (_, item) in enumerate(queries):
                name, null, score = keep[i]
                floor = int(score[-1]) if len(score) == k else 0
                found, got = block.best(item, k, floor)
                name, null = np.append(name, names[found]), np.append(null, none[found])
                score = np.append(score, got)
                order = np.lexsort((name, null, -score))[:k]
                keep[i] = name[order], null[order], score[order]

        postings = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "ids", "tfs"))):
                if not row[2]:
                    continue
                held.append(row)
                postings += len(row[2]) // 4
                if len(held) == BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    search()
                    held, postings = [], 0
        if held:
            search()
        for (item, _), (name, null, score) in zip(queries, keep):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(score), pa.int64()), pa.array(name, mask=null), pa.array(score)],
                    names=["item", "doc", "score"])

    return index.mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item, rank, doc, score): the ``k`` highest-scoring documents of each item."""
    wanted = written(asked(items, item_col, item_text_col), "search-items")
    passes = max(1, -(-wanted.count() // query_terms))
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = None
    for number in range(passes):
        part = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == number)
        rows = part.collect()  # one block of the query set
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        index = written(_index(source, vocabulary), "search-index")
        size = index.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not vocabulary or not size["docs"]:
            continue
        df = _document_counts(index, len(vocabulary))
        by_item: dict = {}
        for r in rows:
            term = vocabulary[bytes(r["term"])]
            if df[term]:
                by_item.setdefault(r["item"], []).append((term, int(r["reps"])))
        queries = [(item, sorted(held, key=lambda t: (df[t[0]], t[0]))) for item, held in by_item.items()]
        best = _ranked(index, queries, weights(df, size["docs"]), size["docs"], size["terms"], k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, doc long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item", "rank", "doc", "score")
