"""Substring dedup by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one document. Words covered by a window that also starts in
a document with a smaller id are removed; windows are judged on the input.

* Every window has an anchor, the ``GRAM`` consecutive words in it of least hash: equal windows have
  equal anchors wherever they stand. Anchors are pre-aggregated to the first and last document that
  holds them; only windows whose anchor occurs in two or more documents can repeat.
* Windows of one anchor occurrence form a passage, and equal passages are pre-aggregated (by hash) to the
  first document that holds them. The different passages that share an anchor are a reference shard: in
  order of their documents, each is streamed through the suffix automaton of the earlier ones, whose states know the
  first document of their words. The matching statistics (longest match at each word, and its state)
  give every window of the passage its first document; then the passage joins the automaton.
* A shard holds ``SHARD`` passages at most, of 21 words each (a passage has at most 9 windows). An anchor
  with more wordings has no automaton: the windows of its passages are dealt by anchor and hash of their 13
  words and pre-aggregated to their first document, so that no task holds a frequent anchor.
* The windows' first documents go back to all passages of the same words, and from there to the texts.

An automaton of the whole corpus could be broadcast only piece by piece, every document meeting every
piece; dealing passages and automata by anchor needs one pass instead. What is broadcast has a fixed size:
the anchors that repeat as a bitmap of 2**``ANCHOR_BITS`` bits (one plan at every size: a bit that another
anchor set lets a passage through that the later joins drop again), and the documents with hits as one of
2**``HIT_BITS``, so that only their texts are moved to meet their spans.

Defined results: a null or empty text has no words; rows with one id are one document, so copies of a row
remove nothing from each other; null ids come after all others and are one document; an empty table
gives an empty result; long texts are read whole, in time proportional to their length. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.common import bit_is_set, bitmap, written
from veritext.llm.wordarrays import Words, mix, sequence_hash, split_words, text_batches, texts_of

WINDOW = 13
GRAM = 5
#: Bits of the bitmaps that are broadcast: 32 MB of anchors, 4 MB of documents with hits.
ANCHOR_BITS = 28
HIT_BITS = 25
#: Passages that one automaton is built of; anchors with more are dealt by window.
SHARD = 1 << 10
_LAST = (1 << 63) - 1


def anchors(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, first word of its anchor, anchor hash), windows within one text."""
    n = len(w.hash)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    g = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        g = mix(g + w.hash[j:n - gram + 1 + j])
    starts = n - window + 1
    best, at = g[:starts].copy(), np.zeros(starts, np.int8)
    for j in range(1, window - gram + 1):
        less = g[j:starts + j] < best
        best[less] = g[j:starts + j][less]
        at[less] = j
    ends = np.repeat(w.first[1:], np.diff(w.first))[:starts]
    s = np.flatnonzero(np.arange(starts) + window <= ends)
    return s, s + at[s], best[s]


class Automaton:
    """Suffix automaton over words; a state knows the first document of its words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, length: int, link: int, first: int, moves: dict) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state for the words of ``p`` followed by ``word``, cut out of ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, passage: list, doc: int) -> None:
        """Passages come in ascending order of ``doc``."""
        last = 0
        for word in passage:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                continue
            new = self._state(self.length[last] + 1, 0, doc, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def first_docs(self, passage: list, window: int, own: int) -> list[int]:
        """First document of each window of the passage; ``own`` where no earlier passage has it."""
        out, state, size = [], 0, 0
        for i, word in enumerate(passage):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
                size = self.length[state]
            if i >= window - 1:
                out.append(self.first[state] if size >= window else own)
        return out


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
                     F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, lo, hi): the anchors of each batch of documents, with its first and last document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for a, b in text_batches(batch.column("text")):
                w = split_words(texts_of(batch.column("text"), a, b))
                s, _, anchor = anchors(w, window)
                if not len(s):
                    continue
                of = doc[a:b][np.searchsorted(w.first, s, side="right") - 1]
                order = np.lexsort((of, anchor))
                anchor, of = anchor[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new].view(np.int64)), pa.array(of[new]),
                     pa.array(of[np.append(new[1:], len(of)) - 1])], names=["anchor", "lo", "hi"])

    return docs.select("doc", "text").mapInArrow(run, "anchor long, lo long, hi long")


def _known(wanted: DataFrame, bits: int):
    """The leading ``bits`` bits of the wanted anchors, as a broadcast bitmap of fixed size."""
    rows = bitmap(wanted.select(F.shiftrightunsigned("anchor", 64 - bits).alias("bit")), "bit", bits).collect()
    flags = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:  # at most 2**bits / 2**15 rows of 4 KB
        piece = np.frombuffer(r["map"], np.uint8)[:len(flags)]
        flags[r["bucket"] * 4096:r["bucket"] * 4096 + len(piece)] = piece
    return wanted.sparkSession.sparkContext.broadcast(flags)


def _runs(batch: pa.RecordBatch, a: int, b: int, window: int, shared):
    """(words, first window, last window, anchor, same) of the passages of some documents: runs of windows
    of one wanted anchor occurrence; ``same`` is the hash of a passage's words."""
    w = split_words(texts_of(batch.column("text"), a, b))
    s, at, anchor = anchors(w, window)
    flags = shared.value
    bit = anchor >> np.uint64(64 - (len(flags).bit_length() + 2))
    some = flags[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
    s, at, anchor = s[some], at[some], anchor[some]
    if not len(s):
        none = np.zeros(0, np.int64)
        return w, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]))
    first, last = s[new], s[np.append(new[1:], len(s)) - 1]
    return w, first, last, anchor[new], sequence_hash(w.hash, first, last + window)


def _passages(docs: DataFrame, shared, window: int) -> DataFrame:
    """(doc, version, at, n, anchor, same): the passages; ``at``: first window, ``n``: windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, version = batch.column("doc").to_numpy(), batch.column("version").to_numpy()
            for a, b in text_batches(batch.column("text")):
                w, first, last, anchor, same = _runs(batch, a, b, window, shared)
                of = np.searchsorted(w.first, first, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[a:b][of]), pa.array(version[a:b][of]),
                     pa.array((first - w.first[of]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                     pa.array(anchor.view(np.int64)), pa.array(same.view(np.int64))],
                    names=["doc", "version", "at", "n", "anchor", "same"])

    return docs.mapInArrow(run, "doc long, version long, at int, n int, anchor long, same long")


def _once(anchor: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Index of one passage of each wording."""
    order = np.lexsort((same, anchor))
    change = (np.diff(anchor[order]) != 0) | (np.diff(same[order]) != 0)
    return order[np.concatenate([[True], change])] if len(order) else order


def _wordings(docs: DataFrame, shared, window: int) -> DataFrame:
    """(anchor, same, passage): the words of the passages of wanted anchors, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_batches(batch.column("text")):
                w, first, last, anchor, same = _runs(batch, a, b, window, shared)
                once = _once(anchor, same)
                text = [b" ".join(w.data[i:j].split())
                        for i, j in zip(w.start[first[once]].tolist(), w.end[last[once] + window - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[once].view(np.int64)), pa.array(same[once].view(np.int64)),
                     pa.array(text, pa.binary()).cast(pa.string())], names=["anchor", "same", "passage"])

    return docs.mapInArrow(run, "anchor long, same long, passage string")


def _windows(docs: DataFrame, shared, window: int) -> DataFrame:
    """(anchor, same, windows): hashes of the windows of the passages of wanted anchors, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_batches(batch.column("text")):
                w, first, last, anchor, same = _runs(batch, a, b, window, shared)
                once = _once(anchor, same)
                n = (last - first + 1)[once]
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                s = np.repeat(first[once] - ends[:-1], n) + np.arange(ends[-1])
                h = sequence_hash(w.hash, s, s + window) if len(s) else s.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[once].view(np.int64)), pa.array(same[once].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))],
                    names=["anchor", "same", "windows"])

    return docs.mapInArrow(run, "anchor long, same long, windows array<long>")


def _first_by_window(passages: DataFrame) -> DataFrame:
    """As ``_first_documents``, from (anchor, same, lo, windows) in any order."""
    each = passages.select("anchor", "same", "lo", F.posexplode("windows").alias("i", "h"))
    least = each.groupBy("anchor", "h").agg(F.min("lo").alias("first"), F.count(F.lit(1)).alias("k"))
    least = written(least.filter("k > 1").select(F.col("anchor").alias("_a"), F.col("h").alias("_h"), "first"),
                    "substring-least")  # written, so that adaptive execution splits the join
    met = each.join(least, (F.col("anchor") == F.col("_a")) & (F.col("h") == F.col("_h")), "left")
    found = F.struct("i", F.coalesce("first", "lo").alias("first"))
    return met.groupBy("anchor", "same").agg(F.array_sort(F.collect_list(found)).alias("found")).select(
        "anchor", "same", F.col("found.first").alias("firsts"))


def _first_documents(shards: DataFrame, window: int) -> DataFrame:
    """(anchor, same, firsts): the first document of each window of each passage. ``shards``: (anchor,
    passage, same, lo), dealt and sorted by anchor, then lo."""

    def shard(anchor: int, rows: list) -> tuple:
        automaton, firsts = Automaton(), []
        for passage, _, lo in rows:
            w = passage.split(" ")
            firsts.append(automaton.first_docs(w, window, lo))
            automaton.add(w, lo)
        return [anchor] * len(rows), [r[1] for r in rows], firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "passage", "same", "lo"))):
                if anchor != now and rows:
                    for o, x in zip(out, shard(now, rows)):
                        o.extend(x)
                    rows = []
                now = anchor
                rows.append(row)
            yield _firsts(out)
        if rows:
            yield _firsts(shard(now, rows))

    return shards.select("anchor", "passage", "same", "lo").mapInArrow(
        run, "anchor long, same long, firsts array<long>")


def _firsts(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))],
        names=["anchor", "same", "firsts"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, bits: int = ANCHOR_BITS, shard: int = SHARD) -> DataFrame:
    """(doc, version, spans): runs (first, last) of the windows of each document that also start in an earlier
    one."""
    repeated = _anchor_rows(docs, window).groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    repeated = written(repeated.filter("lo < hi").select("anchor"), "substring-anchors")
    found = written(_passages(docs, _known(repeated, bits), window), "substring-passages")
    kinds = written(found.groupBy("anchor", "same").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"),
                                                       F.min("n").alias("n")), "substring-kinds")

    # anchors with one wording need no automaton: its windows start in its own first document
    several = written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "substring-shards")
    few, many = (several.filter(F.col("k") <= shard).select("anchor"), several.filter(F.col("k") > shard).select("anchor"))
    texts = _wordings(docs, _known(few, bits), window).dropDuplicates(["anchor", "same"])
    shards = texts.join(kinds.join(few, "anchor").select("anchor", "same", "lo"), ["anchor", "same"])
    shards = shards.repartition("anchor").sortWithinPartitions("anchor", "lo", "same")
    matched = written(_first_documents(shards, window), "substring-firsts")
    if not many.isEmpty():
        passages = _windows(docs, _known(many, bits), window).dropDuplicates(["anchor", "same"])
        held = kinds.join(many, "anchor").select("anchor", "same", "lo")
        passages = written(passages.join(held, ["anchor", "same"]), "substring-windows")
        matched = matched.unionByName(written(_first_by_window(passages), "substring-firsts"))
    # a wording of one document, none of whose windows is in an earlier one, has no hit anywhere
    matched = matched.withColumnsRenamed({"same": "_same", "anchor": "_anchor"})
    firsts = kinds.join(matched, (F.col("same") == F.col("_same")) & (F.col("anchor") == F.col("_anchor")), "left").select(
        F.col("same").alias("_same"), "lo", "hi", "firsts")
    firsts = firsts.filter((F.col("lo") < F.col("hi")) | F.exists("firsts", lambda x: x < F.col("lo"))).drop("hi")

    # equal words have equal anchors, so the hash of the words alone is the key
    hits = found.select("doc", "version", "at", "n", "same").join(firsts, F.col("same") == F.col("_same"))
    whole = F.array(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last")))
    each = F.transform("firsts", lambda x, i: F.when(x < F.col("doc"), F.struct(
        (F.col("at") + i).alias("first"), (F.col("at") + i).alias("last"))))
    runs = F.when(F.col("lo") < F.col("doc"), whole).otherwise(F.filter(each, lambda r: r.isNotNull()))
    hits = hits.select("doc", "version", F.explode(runs).alias("run")).select("doc", "version", "run.first", "run.last")
    return hits.groupBy("doc", "version").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          bits: int = ANCHOR_BITS, shard: int = SHARD) -> DataFrame:
    """(id, n_words, n_removed, kept, spans): kept words joined by one space, and the removed word ranges
    [from, to) of the input."""
    docs = _documents(df, id_col, text_col)
    hits = written(repeated_windows(docs, window, bits, shard), "substring-hits").withColumnsRenamed(
        {"doc": "_doc", "version": "_version"})
    keyed = df.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"),
                      F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"))
    # texts without a hit stay where they are
    def bit(doc: str, version: str):
        return F.shiftrightunsigned(F.xxhash64(doc, version), 64 - HIT_BITS)

    hit_docs = written(bitmap(hits.select(bit("_doc", "_version").alias("bit")), "bit", HIT_BITS), "substring-bitmap")
    marked = bit_is_set(keyed.withColumn("_bit", bit("doc", "version")), hit_docs, "_bit", "_hit")
    moved = marked.filter("_hit").join(hits, (F.col("doc") == F.col("_doc")) & (F.col("version") == F.col("_version")), "left")
    columns = [F.col(id_col), F.col("text"), F.col("spans")]
    joined = moved.select(*columns).unionByName(
        marked.filter("NOT _hit").select(*columns[:2], F.lit(None).cast(hits.schema["spans"].dataType).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_batches(batch.column("text")):
                n_words, n_removed, kept, spans = [], [], [], []
                runs = batch.column("spans").slice(a, b - a)
                for text, at in zip(texts_of(batch.column("text"), a, b), runs):
                    w = text.split()
                    ranges = []
                    if at.is_valid:
                        for first, last in sorted(zip(*(at.values.field(i).to_pylist() for i in range(2)))):
                            if ranges and first <= ranges[-1][1]:
                                ranges[-1][1] = max(ranges[-1][1], last + window)
                            else:
                                ranges.append([first, last + window])
                    left, done = [], 0
                    for i, j in ranges:
                        left.extend(w[done:i])
                        done = j
                    left.extend(w[done:])
                    n_words.append(len(w))
                    n_removed.append(len(w) - len(left))
                    kept.append(b" ".join(left))
                    spans.append(ranges)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(a, b - a), pa.array(n_words, pa.int64()),
                     pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                    names=[id_col, "n_words", "n_removed", "kept", "spans"])

    schema = T.StructType([df.schema[id_col], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
                           T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return joined.mapInArrow(run, schema)
