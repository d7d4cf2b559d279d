"""Hierarchical Pitman-Yor language model.

Every preceding word has restaurants whose customers are the words that follow it, one under each class context it
stands in; their tables are customers of the class context, whose tables are customers of the root, and the root's
parent is uniform over the vocabulary and one unknown word. Seating is sampled by Gibbs sweeps: all customers of a word in a restaurant leave
and are seated again one by one, each at a new table with probability proportional to
(theta + d * tables) * P_parent(word). Given the restaurants' totals, which are a few hundred numbers,
words are independent, so a sweep is one parallel job over the words; totals are summed and passed to
the next sweep. The last sweeps' predictive probabilities are averaged and score the texts.

The class context of a word is the class of what stands before it, a fixed number of them: the previous word
itself if it is one of the ``CLASSES`` most frequent words (this is its restaurant), else the last such word before it.
In the second case the restaurant of the previous word in that class context stands below. These have discount 0 and
a strength alpha of their class context, fitted to their tables, so that a word follows with
(c + alpha * P_class(word)) / (C + alpha). The numerator is known where the word is, the denominator where the word
before is: C counts that word's own occurrences. So log scores are added from both and no restaurant joins a token.

A word with at least one in ``HEAVY`` of all training tokens is heavy. There are at most ``HEAVY`` of
these, so their part of the model has a proven bound, is broadcast, and their tokens never move. All
other tokens are shuffled by word, where no word can be hot. Nothing is dropped on either way. One pass over the
texts counts the heavy words' contexts and deals the other tokens into buckets of words; a shuffled row holds a
bucket's tokens of many texts, and a row of the written words the whole words of up to ``ROW`` tokens. A rare token
also names the word before it and, if heavy, the word behind it; two heavy words in a row are dealt by pair. Tokens
carry the number that their task gave a text, in place of its key, and a table of both goes along.

Defined results: a null or empty text is one end token; words are identified by a 64-bit hash; repeated
rows are scored each, rows with one id by their own texts; with nothing to learn from every probability
is the uniform one; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import written
from veritext.llm.wordarrays import Words, mix, split_words, text_batches, texts_of

HEAVY = 1 << 14
CLASSES = 127
CONTEXTS = 2 * (CLASSES + 1)
LOG_CONTEXTS = 8
THETA = 1.0
#: The strength of the restaurants of preceding words: at first, and its range.
ALPHA, ALPHAS = 1.0, (1e-3, 1e6)
SWEEPS = 3
BURN_IN = 2
#: The end of a text as a word.
END = np.uint64(0xE5D0F7E87A5B3C11)
#: Customers of one dish, and of all dishes, whose draws are held at once.
MOST = 1 << 16
ROOM = 1 << 16
#: Buckets of words, at least, and training tokens for each at most, on average; heavy words in a group.
BUCKETS, BUCKET_TOKENS = 1 << 12, 1 << 20
GROUP = 64
#: Tokens that are dealt or packed at once, and those in a row of whole words.
HELD, GATHERED, ROW = 1 << 20, 1 << 17, 1 << 12
#: Bytes of the words' types or tokens that are worked on at once.
PART_BYTES = 1 << 19


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with one end after each text, text of each token)."""
    n = len(w.first) - 1
    text = np.repeat(np.arange(n), np.diff(w.first))
    return np.insert(w.hash, w.first[1:], END), np.insert(text, w.first[1:], np.arange(n))


class Heavy:
    """The heavy words and their classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], counts[order]
        best = np.lexsort((self.hash, -self.count))
        best = best[self.hash[best] != END][:CLASSES]
        self.cls = np.zeros(len(self.hash) + 1, np.int64)  # the last place is for all other words
        self.cls[best] = np.arange(1, len(best) + 1)
        #: Words without restaurants of their own below the class contexts: classes, and the end, which precedes nothing.
        self.follow_near = (self.cls[:-1] > 0) | (self.hash == END)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Index of each word, ``len(self.hash)`` for words that are not heavy."""
        n = len(self.hash)
        if not n:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), n - 1)
        return np.where(self.hash[at] == h, at, n)

    def contexts(self, place: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Context of each token: 0 at the start of a text."""
        n = len(place)
        cls, at = self.cls[place], np.arange(n)
        first = np.searchsorted(text, text)
        seen = np.maximum.accumulate(np.where(cls > 0, at, -1))
        before = np.concatenate([[-1], seen[:-1]])
        known = before >= first
        far = np.where(known, cls[np.maximum(before, 0)], 0)
        near = before == at - 1
        return np.where(at == first, 0, np.where(near & known, far, CLASSES + 1 + far))


def _seed(*keys) -> np.ndarray:
    x = np.uint64(0)
    for k in keys:
        x = mix(np.asarray(k, np.uint64) + np.uint64(0x9E3779B97F4A7C15) + x)
    return x


def _uniform(seed: np.ndarray, step: np.ndarray) -> np.ndarray:
    x = mix(seed + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)) * (1.0 / (1 << 53))


def seat(customers: np.ndarray, strength: np.ndarray, d: float, *keys) -> np.ndarray:
    """Tables after seating ``customers`` (>= 1 each) of one dish one by one; ``strength``: weight of a new table.
    The draws depend on ``keys`` and the customer's place alone, not on how rows are dealt to tasks.

    With j seated at t tables, a customer with draw u opens one if u < a / (a + j - d * t), that is if t is above
    (a + j - a / u) / d. These bounds are known before t is, so as many customers as are seated are taken at
    once: tables are counted from those that open one even at the least t, then again from the counts so
    found, until none changes. Counts only rise, and the first customer not yet right is right after each
    turn, so the end is the result of seating one by one."""
    tables = np.ones(len(customers))
    seated = np.ones(len(customers))
    seed = np.broadcast_to(_seed(*keys), customers.shape)
    live = np.flatnonzero(customers > 1)
    while len(live):
        block = np.minimum(np.minimum(seated[live], MOST), customers[live] - seated[live]).astype(np.int64)
        room = np.cumsum(block) // ROOM
        for part in np.split(np.arange(len(live)), np.flatnonzero(np.diff(room)) + 1):
            tables[live[part]] += _opened(block[part], seated[live[part]], tables[live[part]], strength[live[part]],
                                          d, seed[live[part]])
        seated[live] += block
        live = live[seated[live] < customers[live]]
    return tables


def _opened(block: np.ndarray, j: np.ndarray, t: np.ndarray, a: np.ndarray, d: float, seed: np.ndarray) -> np.ndarray:
    """Tables opened by each dish's next ``block`` customers."""
    ends = np.cumsum(block)
    nth = np.arange(ends[-1]) - np.repeat(ends - block, block)
    u = _uniform(np.repeat(seed, block), nth + np.repeat(j.astype(np.int64), block))
    if d == 0:  # the tables do not matter
        opens = u * (np.repeat(a + j, block) + nth) < np.repeat(a, block)
        return np.bincount(np.repeat(np.arange(len(block)), block), opens, len(block))
    # at most one table for each customer before: the others open none, whatever t is
    least = np.repeat(a + j - d * t, block)
    some = np.flatnonzero(u * (least + (1 - d) * nth) < np.repeat(a * (1 + 1e-9), block))
    row = np.searchsorted(ends, some, side="right")
    with np.errstate(divide="ignore"):
        bound = (a[row] + j[row] + nth[some] - a[row] / u[some]) / d - t[row]
    start = np.searchsorted(row, np.arange(len(block)))
    opens = bound < 0
    while True:
        before = np.concatenate([[0], np.cumsum(opens)])
        now = bound < before[:-1] - before[start[row]]
        if (now == opens).all():
            return np.bincount(row, opens, len(block))
        opens = now


def _sample(word: np.ndarray, ctx: np.ndarray, count: np.ndarray, of: np.ndarray, n_words: int, m: dict, turn: int):
    """One sweep over some words' types. Returns tables per type, customers and tables per word in the
    root, and the words' root probabilities."""
    p = m["prior"][of]
    tables = seat(count, (THETA + m["d"] * m["T"][ctx]) * p, m["d"], word[of], ctx, np.uint64(2 * turn))
    arrived = np.bincount(of, tables, n_words)
    some = np.flatnonzero(arrived)
    root = np.zeros(n_words)
    uniform = 1.0 / (m["V"] + 1)
    root[some] = seat(arrived[some], np.full(len(some), (THETA + m["d0"] * m["T0"]) * uniform), m["d0"],
                      word[some], np.uint64(2 * turn + 1))
    rate = (arrived - m["d0"] * root + (THETA + m["d0"] * m["T0"]) * uniform) / (THETA + m["N0"])
    return tables, arrived, root, rate


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all rows of a binary column, where each row begins and the last ends)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def _values(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    return _bytes(batch.column(name))[0].view(dtype)


def _blobs(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column: row i holds the values from ``ends[i - 1]`` to ``ends[i]``."""
    at = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.tobytes()), data])


def _ends(new: np.ndarray) -> np.ndarray:
    """Ends of the runs of sorted values; ``new``: whether each value but the first differs from the one before."""
    return np.append(np.flatnonzero(new) + 1, len(new) + 1)


def _parts(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, of about ``PART_BYTES`` in one column."""
    for batch in batches:
        if batch.num_rows:
            ends = _ends(np.diff(_bytes(batch.column(name))[1][1:] // PART_BYTES))
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                yield batch.slice(a, b - a)


def _unpack(batch: pa.RecordBatch):
    """Words of a batch and their flattened training types."""
    word = _values(batch, "w", np.uint64)
    of = np.repeat(np.arange(len(word)), _values(batch, "types", np.int32))
    return word, _values(batch, "ctx", np.uint8).astype(np.int64), _values(batch, "c", np.int64).astype(np.float64), of


class Leaves(NamedTuple):
    """The restaurants of preceding words, seen from the words that follow: for each dish learned, its type and customers,
    and its place among those of its word; for each token, the customers of its dish."""
    type: np.ndarray
    count: np.ndarray
    place: np.ndarray
    of_token: np.ndarray


def _token_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, class context, number and whether learned) of each entry of a batch's tokens."""
    tokens = _values(batch, "tokens", np.int32)
    mark = _values(batch, "mark", np.uint8)
    return (np.repeat(np.arange(len(tokens)), tokens), _values(batch, "at", np.uint8).astype(np.int64),
            _values(batch, "n", np.int32).astype(np.float64), mark)


def _leaves(batch: pa.RecordBatch, ctx: np.ndarray, of: np.ndarray) -> Leaves:
    w, at, n, mark = _token_words(batch)
    leaf = np.cumsum(mark >> 1, dtype=np.int64) - 1
    first = np.flatnonzero(mark & 2)
    count = np.bincount(leaf, n * (mark & 1), len(first))
    some = np.flatnonzero((at[first] > CLASSES) & (count > 0))
    begin = np.searchsorted(w[first], w[first][some])
    kind = np.searchsorted(of * CONTEXTS + ctx, (w * CONTEXTS + at)[first[some]])
    return Leaves(kind, count[some], some - begin, count[leaf])


def _far(ctx: np.ndarray) -> np.ndarray:
    """The class context of what follows a word that is no class, if it stands in ``ctx`` itself."""
    return np.where(ctx > CLASSES, ctx, ctx + CLASSES + 1)


def _followed(word, ctx, count, of) -> tuple[np.ndarray, np.ndarray]:
    """(word * CONTEXTS + class context, customers) of the restaurants of these words as preceding ones; a text's end
    precedes nothing."""
    some = word[of] != END
    key, at = np.unique((of * CONTEXTS + _far(ctx))[some], return_inverse=True)
    return key, np.bincount(at, count[some], len(key))


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the keys asked for, 0 where there is none; ``keys`` are in order."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        small = x < 8
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def _chain(word, ctx, count, of, m: dict, sweeps: int, turn: int, leaves: Leaves | None = None, arrived=None):
    """Sweeps with the totals held; yields customers per type, the results of the sweep and the leaves' tables. The
    customers of far class contexts are the tables of ``leaves``, or those that have ``arrived``."""
    total = np.bincount(of, count, len(word))
    prior = (total + 0.5) / (m["N"] + 0.5 * (m["V"] + 1))
    customers = (count if arrived is None else arrived).astype(np.float64)
    own = None
    if leaves is not None:
        far = ctx > CLASSES
        own = np.ones(len(leaves.type))
    for s in range(sweeps):
        if leaves is not None:
            if s:
                p = (customers - m["d"] * got[0]) / (THETA + m["C"][ctx]) + m["back"][ctx] * prior[of]
                k = leaves.type
                own = seat(leaves.count, m["alpha"][ctx[k]] * np.minimum(p[k], 1.0), 0.0, word[of[k]], ctx[k],
                           leaves.place, np.uint64(2 * (turn + s)))
            customers[far] = np.bincount(leaves.type, own, len(ctx))[far]
        got = _sample(word, ctx, customers, of, len(word), m | {"prior": prior}, turn + s)
        prior = got[3]
        yield customers, *got, own


def _back(m: dict) -> dict:
    """With the weight of the root in each class context."""
    return m | {"back": (THETA + m["d"] * m["T"]) / (THETA + m["C"])}


TYPES = ["w", "types", "ctx", "c"]


def _heavy_types(batch: pa.RecordBatch, frequent: Heavy, arrived: np.ndarray):
    """``_unpack`` of heavy words, and the customers of each type."""
    word, ctx, count, of = _unpack(batch)
    return word, ctx, count, of, np.where(ctx > CLASSES, arrived[frequent.place(word)[of], ctx], count)


def _totals(words: DataFrame, m: dict, turn: int, shared, arrived, followed: np.ndarray) -> dict:
    """The totals after a sweep, from sums that the tasks make: one row per context and two for the root."""

    def sums_of(heavy: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((CONTEXTS + 1, 6))
            for batch in _parts(batches, "c"):
                if heavy:
                    word, ctx, count, of, came = _heavy_types(batch, shared.value, arrived.value)
                    *_, last = _chain(word, ctx, count, of, m, SWEEPS, turn, arrived=came)
                else:
                    word, ctx, count, of = _unpack(batch)
                    leaves = _leaves(batch, ctx, of)
                    *_, last = _chain(word, ctx, count, of, m, SWEEPS, turn, leaves)
                    sums[:CONTEXTS, 4] += np.bincount(ctx[leaves.type], last[5], CONTEXTS)
                    key, n = _followed(word, ctx, count, of)
                    sums[:CONTEXTS, 5] += np.bincount(key % CONTEXTS, _spread(n, m["alpha"][key % CONTEXTS]), CONTEXTS)
                customers, tables, came, root, _, _ = last
                sums[:CONTEXTS, 0] += np.bincount(ctx, tables, CONTEXTS)
                sums[:CONTEXTS, 1] += np.bincount(ctx, customers, CONTEXTS)
                sums[0, 2] += (customers == 1).sum()
                sums[0, 3] += (customers == 2).sum()
                sums[CONTEXTS, :4] += [came.sum(), root.sum(), (came == 1).sum(), (came == 2).sum()]
            some = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(sums[some, k]) for k in range(6))],
                                             names=["k", "a", "b", "n1", "n2", "leaf", "spread"])
        return run

    schema = "k int, a double, b double, n1 double, n2 double, leaf double, spread double"
    both = [words.filter(f"tokens IS {'' if heavy else 'NOT'} NULL").select(*TYPES, *([] if heavy else LINKS))
            .mapInArrow(sums_of(heavy), schema) for heavy in (True, False)]
    rows = both[0].unionByName(both[1]).groupBy("k").agg(
        *(F.sum(c).alias(c) for c in ("a", "b", "n1", "n2", "leaf", "spread"))).collect()  # CONTEXTS + 1 rows
    out = m | {"T": np.zeros(CONTEXTS), "C": np.zeros(CONTEXTS)}
    n1 = n2 = 0.0
    leaf = np.where(np.arange(CONTEXTS) > CLASSES, arrived.value.sum(axis=0), 0.0)
    spread = _spread(followed, m["alpha"]).sum(axis=0)
    for r in rows:
        if r["k"] < CONTEXTS:
            out["T"][r["k"]], out["C"][r["k"]] = r["a"], r["b"]
            leaf[r["k"]] += r["leaf"]
            spread[r["k"]] += r["spread"]
            n1, n2 = n1 + r["n1"], n2 + r["n2"]
        else:
            out["N0"], out["T0"] = r["a"], r["b"]
            out["d0"] = _discount(r["n1"], r["n2"])
    out["d"] = _discount(n1, n2)
    fitted = np.where((leaf > 0) & (spread > 0), leaf / np.maximum(spread, 1e-300), m["alpha"])
    out["alpha"] = np.clip(fitted, *ALPHAS).astype(np.float32).astype(np.float64)  # sums of doubles differ in last places
    return _back(out)


def _spread(n: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The expected tables of ``n`` customers, over alpha."""
    return np.where(n > 0, _digamma(alpha + n) - _digamma(alpha + 0 * n), 0.0)


def _pairs_of(batch: pa.RecordBatch, word: np.ndarray):
    """Heavy words behind rare ones, among a batch's tokens: (tokens that have one, the dish of each), and of each dish the
    key of its restaurant's word, its place, class context and customers."""
    w, at, n, mark = _token_words(batch)
    behind = _values(batch, "next", np.uint16).astype(np.int64)
    some = np.flatnonzero(behind)
    k = _far(at[some])
    dish, where = np.unique((w[some] * CONTEXTS + k) << 15 | (behind[some] - 1), return_inverse=True)
    count = np.bincount(where, (n * (mark & 1))[some], len(dish))
    return some, where, word[dish >> 15 + LOG_CONTEXTS], dish & (1 << 15) - 1, (dish >> 15) % CONTEXTS, count


def _arrivals(words: DataFrame, m: dict, turn: int, grid, size: int) -> np.ndarray:
    """Tables of heavy words in the restaurants of preceding words, by word and class context; one each at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * CONTEXTS)

        def add(key, place, k, count):
            some = np.flatnonzero(count > 0)
            key, place, k, count = key[some], place[some], k[some], count[some]
            tables = np.ones(len(some))
            if grid is not None:
                tables = seat(count, m["alpha"][k] * grid.value[place, k], 0.0, key, k, place, np.uint64(2 * turn + 1))
            np.add(table, np.bincount(place * CONTEXTS + k, tables, len(table)), out=table)

        for batch in _parts(batches, "at"):
            _, _, key, place, k, count = _pairs_of(batch, _values(batch, "w", np.uint64))
            add(key, place, k, count)
            add(*_pair_types(batch))
        some = np.flatnonzero(table)
        if len(some):
            group = some // (GROUP * CONTEXTS)
            ends = _ends(np.diff(group))
            yield pa.RecordBatch.from_arrays([pa.array((group[ends - 1]).astype(np.int32)), _blobs(ends, some.astype(np.int32)),
                                              _blobs(ends, table[some].astype(np.int64))], names=["b", "at", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = np.zeros(0, np.int64), None

        def row():
            some = np.flatnonzero(table)
            end = np.array([len(some)])
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), _blobs(end, (some + last * GROUP * CONTEXTS).astype(
                np.int32)), _blobs(end, table[some])], names=["b", "at", "n"])

        for batch in batches:
            for b, at, n in zip(*(batch.column(c).to_pylist() for c in ("b", "at", "n"))):
                if b != last:
                    if last is not None:
                        yield row()
                    table, last = np.zeros(GROUP * CONTEXTS, np.int64), b
                table[np.frombuffer(at, np.int32) - b * GROUP * CONTEXTS] += np.frombuffer(n, np.int64)
        if last is not None:
            yield row()

    if not size:
        return np.zeros((0, CONTEXTS))
    schema = "b int, at binary, n binary"
    rows = (words.filter("tokens IS NOT NULL").select("w", *LINKS, "next", *PAIRS[:4]).mapInArrow(run, schema)
            .repartition("b").sortWithinPartitions("b").mapInArrow(added, schema).toPandas())  # ``size`` words' cells
    out = np.zeros(size * CONTEXTS)
    for at, n in zip(rows["at"], rows["n"]):
        out[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
    return out.reshape(size, CONTEXTS)


def _pair_types(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(key, place of the second word, class context, customers) of a batch's pairs of heavy words."""
    return (_values(batch, "pair", np.uint64), _values(batch, "second", np.uint16).astype(np.int64),
            _values(batch, "pair_ctx", np.uint8).astype(np.int64), _values(batch, "pair_c", np.int64).astype(np.float64))


def _discount(ones: float, twos: float) -> float:
    """From the numbers of words seen once and twice."""
    return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5


def _predictive(word, ctx, count, of, m: dict, turn: int, **kw):
    """(averaged customers - d * tables per type, averaged root probability per word)."""
    own, root, n = np.zeros(len(ctx)), np.zeros(len(word)), 0
    for s, (customers, tables, _, _, rate, _) in enumerate(_chain(word, ctx, count, of, m, SWEEPS + BURN_IN, turn, **kw)):
        if s >= BURN_IN:
            own, root, n = own + customers - m["d"] * tables, root + rate, n + 1
    return own / n, root / n


def _grid(words: DataFrame, m: dict, turn: int, shared, arrived) -> np.ndarray:
    """Probabilities of the heavy words in the class contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "c"):
            word, ctx, count, of, came = _heavy_types(batch, shared.value, arrived.value)
            own, root = _predictive(word, ctx, count, of, m, turn, arrived=came)
            grid = root[:, None] * m["back"][None, :]
            grid[of, ctx] += own / (THETA + m["C"][ctx])
            yield _record(("w", "p"), (word.view(np.int64), [x.astype(np.float32).tobytes() for x in grid]))

    rows = words.filter("tokens IS NULL").select(*TYPES).mapInArrow(run, "w long, p binary").toPandas()
    order = np.argsort(rows["w"].to_numpy(np.int64).view(np.uint64))  # at most ``heavy`` rows of CONTEXTS numbers
    return np.frombuffer(b"".join(rows["p"].iloc[i] for i in order), np.float32).reshape(-1, CONTEXTS)


def _heavy_followed(words: DataFrame, frequent: Heavy) -> np.ndarray:
    """Customers of the heavy words' restaurants as preceding ones, by word and class context; classes and ends have none."""
    out = np.zeros((len(frequent.hash), CONTEXTS))
    for r in words.filter("tokens IS NULL").select(*TYPES).collect():  # at most ``heavy`` words
        of = np.repeat(np.arange(len(r["w"]) // 8), np.frombuffer(r["types"], np.int32))
        place = frequent.place(np.frombuffer(r["w"], np.uint64))[of]
        np.add.at(out, (place, _far(np.frombuffer(r["ctx"], np.uint8).astype(np.int64))), np.frombuffer(r["c"], np.int64))
    out[frequent.follow_near] = 0.0
    return out


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(id, train boolean, n_tokens, n_known, train_tokens, base_score, score) per row; ``train`` says
    which rows are learned from."""
    docs = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"),
                     F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            w, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return w, np.bincount(at, np.concatenate([p[1] for p in parts]), len(w)).astype(np.int64)

        held, size = [], 0
        for batch in batches:
            for a, b in text_batches(batch.column(0)):
                h, _ = _tokens(split_words(texts_of(batch.column(0), a, b), lower=True))
                held.append(np.unique(h, return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield _record(("w", "n"), held[0])
                        held, size = [], 0
        if held:
            yield _record(("w", "n"), merged(held))

    learned = docs.filter("train").select("text")
    vocabulary = written(learned.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")),
                         "lm-vocabulary")
    total = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, n_words = int(total["n"] or 0), int(total["v"])
    top = vocabulary.filter(F.col("n") * heavy >= n_all).toPandas()  # at most ``heavy`` rows
    frequent = Heavy(top["w"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))
    size = len(frequent.hash)
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    buckets = max(BUCKETS, min(n_all // BUCKET_TOKENS, 1 << 20))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare tokens by bucket, and at the end the heavy words' training types by group, as buckets below zero."""
        h_, task = shared.value, TaskContext.get().partitionId()
        table = np.zeros((size + 1) * CONTEXTS, np.int64)
        held, cells, n, keys, given = [], [], 0, [], task << 32
        for batch in batches:
            learn = batch.column("train").to_numpy(zero_copy_only=False)
            number = given + np.arange(batch.num_rows)
            given += batch.num_rows
            keys.append(batch.column("key").to_numpy().copy())
            for a, b in text_batches(batch.column("text")):
                h, text = _tokens(split_words(texts_of(batch.column("text"), a, b), lower=True))
                place = h_.place(h)
                ctx = h_.contexts(place, text)
                train = learn[a:b][text]
                rare, far = place == size, ctx > CLASSES
                cells.append((place * CONTEXTS + ctx)[train & ~rare])
                before, behind = np.append(np.uint64(0), h[:-1]), np.append(place[1:], size)
                behind[np.append(text[1:] != text[:-1], True)] = size
                pair = far & ~rare & (np.append(size, place[:-1]) < size)
                # the heavy word behind a rare one, or the second one of a pair
                link = np.where(pair, place + 1, np.where(rare & (behind < size), behind + 1, 0)).astype(np.uint16)
                kept = np.flatnonzero(rare | pair)
                held.append(tuple(x[kept] for x in (
                    np.where(pair, _seed(before, h), h), number[a:b][text], ctx.astype(np.uint8),
                    train + 2 * pair.astype(np.uint8), np.where(far & rare, before, np.uint64(0)), link)))
                n += len(h)
                if n > HELD:
                    table += np.bincount(np.concatenate(cells), minlength=len(table))
                    yield _dealt(held, buckets)
                    held, cells, n = [], [], 0
        if held:
            table += np.bincount(np.concatenate(cells), minlength=len(table))
            yield _dealt(held, buckets)
        if keys:
            keys = np.concatenate(keys)
            ends = np.minimum(np.arange(1, -(-len(keys) // HELD) + 1) * HELD, len(keys))
            none = pa.nulls(len(ends), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array((buckets + (task + np.arange(len(ends))) % buckets).astype(np.int32)),
                 _blobs(ends, (task << 32) + np.arange(len(keys))), _blobs(ends, keys), *(none for _ in DEALT[3:])], names=DEALT)
        some = np.flatnonzero(table)
        if len(some):
            group = some // (GROUP * CONTEXTS)
            ends = _ends(np.diff(group))
            none = pa.nulls(len(ends), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array((-1 - group[ends - 1]).astype(np.int32)), _blobs(ends, (some % (GROUP * CONTEXTS)).astype(np.int32)),
                 none, none, _blobs(ends, table[some]), none, none, none], names=DEALT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket to rows of whole words (one word: at most one in ``heavy`` of the tokens)."""
        table, held, n, last = None, [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("b").to_numpy()
            data = [_bytes(batch.column(c)) for c in DEALT[1:]]
            ends = _ends(np.diff(bucket))
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                if bucket[a] != last:
                    if table is not None:
                        yield _packed_group(shared.value.hash[(-1 - last) * GROUP:], table)
                        table = None
                    if n > GATHERED:
                        yield _packed(held)
                        held, n = [], 0
                last = int(bucket[a])
                if last >= buckets:
                    (w, at), (key, to) = data[:2]
                    yield _numbered(w[at[a]:at[b]].view(np.int64), key[to[a]:to[b]].view(np.int64))
                    continue
                w, key, ctx, count_, train, before, link = (x[at[a]:at[b]] for x, at in data)
                if last < 0:
                    table = np.zeros(GROUP * CONTEXTS) if table is None else table
                    table += np.bincount(w.view(np.int32), count_.view(np.int64), len(table))
                else:  # copies: a bucket may go on in the next batch
                    rows = data[1][1][a:b + 1] - data[1][1][a]
                    key = np.concatenate([_joined(key[i:j]) for i, j in zip(rows[:-1].tolist(), rows[1:].tolist())])
                    held.append((w.view(np.uint64).copy(), key, ctx.copy(), count_.view(np.int32).copy(),
                                 train.copy(), before.view(np.uint64).copy(), link.view(np.uint16).copy()))
                    n += len(ctx)
        if table is not None:
            yield _packed_group(shared.value.hash[(-1 - last) * GROUP:], table)
        if held:
            yield _packed(held)

    dealt = (docs.select("key", "train", "text").mapInArrow(deal, "b int, " + ", ".join(f"{c} binary" for c in DEALT[1:]))
             .repartition("b").sortWithinPartitions("b"))
    words = written(dealt.mapInArrow(pack, ", ".join(f"{c} binary" for c in PACKED)), "lm-words",
                    **{"parquet.block.size": 1 << 24, "compression": "zstd"})

    # burn-in: each job starts from the totals of the last
    m = {"V": n_words, "N": n_all, "d": 0.7, "d0": 0.7, "T": np.full(CONTEXTS, max(n_words, 1) / CONTEXTS),
         "C": np.zeros(CONTEXTS), "T0": float(n_words), "N0": float(max(n_words, 1)), "alpha": np.full(CONTEXTS, ALPHA)}
    m, model, followed = _back(m), None, _heavy_followed(words, frequent)
    for turn in range(BURN_IN + 1):
        # the sums of words dealt by their place go back to all tasks: ``heavy`` rows of CONTEXTS numbers
        arrived = df.sparkSession.sparkContext.broadcast(_arrivals(words, m, turn, model, size))
        if turn < BURN_IN:
            m = _totals(words, m, turn * SWEEPS, shared, arrived, followed)
        model = df.sparkSession.sparkContext.broadcast(_grid(words, m, (turn + 1) * SWEEPS, shared, arrived))
    turn = BURN_IN * SWEEPS
    base_all = np.log10(n_all + 0.5 * (n_words + 1))
    back, alpha = m["back"], m["alpha"]
    per = THETA + m["C"]
    # what a heavy word takes from the score of the next one
    rest = df.sparkSession.sparkContext.broadcast(np.where(frequent.follow_near[:, None], 0.0, np.log10(alpha + followed)))

    sums = "key long, n_tokens long, n_known long, base double, score double"

    def heavy_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h_, table = shared.value, model.value
        base = np.append(np.log10(h_.count + 0.5) - base_all, 0.0)
        for batch in batches:
            column = batch.column("text")
            for a, b in text_batches(column):
                h, text = _tokens(split_words(texts_of(column, a, b), lower=True))
                place = h_.place(h)
                ctx = h_.contexts(place, text)
                is_heavy = place < size
                value = np.zeros(len(h))
                near = is_heavy & (ctx <= CLASSES)  # other heavy words are scored with the word before them
                value[near] = np.log10(table[place[near], ctx[near]].astype(np.float64))
                value[is_heavy] -= rest.value[place[is_heavy], _far(ctx[is_heavy])]
                n = b - a
                yield _record(("key", "n_tokens", "n_known", "base", "score"), (
                    batch.column("key").to_numpy()[a:b], np.bincount(text, minlength=n),
                    np.bincount(text, is_heavy, n).astype(np.int64), np.bincount(text, base[place], n),
                    np.bincount(text, value, n)))

    def rare_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "key"):
            word, ctx, count_, of = _unpack(batch)
            leaves = _leaves(batch, ctx, of)
            own, root = _predictive(word, ctx, count_, of, m, turn, leaves=leaves)
            seen = np.bincount(of, count_, len(word))
            base = np.log10(seen + 0.5) - base_all
            w, at, n, _ = _token_words(batch)
            p = root[w] * back[at]
            p += _found(of * CONTEXTS + ctx, own / per[ctx], w * CONTEXTS + at)  # sorted: words in order, their contexts in order
            value = np.log10(np.where(at > CLASSES, leaves.of_token + alpha[at] * p, p))
            # the rest of the next word's score
            k = _far(at)
            value -= np.where(word[w] == END, 0.0, np.log10(alpha[k] + _found(*_followed(word, ctx, count_, of), w * CONTEXTS + k)))
            some, where, _, place, dish_k, dish_c = _pairs_of(batch, word)
            value[some] += np.log10(dish_c + alpha[dish_k] * model.value[place, dish_k])[where]
            keys, where = np.unique(_values(batch, "key", np.int64), return_inverse=True)
            yield _record(("key", "n_tokens", "n_known", "base", "score"), (
                keys, np.zeros(len(keys), np.int64), np.bincount(where, n * (seen > 0)[w], len(keys)).astype(np.int64),
                np.bincount(where, n * base[w], len(keys)), np.bincount(where, n * value, len(keys))))
            _, place, k, count_ = _pair_types(batch)
            if len(k):
                value = np.repeat(np.log10(count_ + alpha[k] * model.value[place, k]), _values(batch, "pair_tokens", np.int32))
                keys, where = np.unique(_values(batch, "pair_key", np.int64), return_inverse=True)
                zero = np.zeros(len(keys), np.int64)
                yield _record(("key", "n_tokens", "n_known", "base", "score"), (
                    keys, zero, zero, zero.astype(float),
                    np.bincount(where, value * _values(batch, "pair_n", np.int32), len(keys))))

    whole = docs.select("key", "text").mapInArrow(heavy_scores, sums)
    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _record(("number", "text_key"), (_values(batch, "num", np.int64), _values(batch, "text", np.int64)))

    numbered = words.filter("num IS NOT NULL").select("num", "text").mapInArrow(numbers, "number long, text_key long")
    parts = words.filter("tokens IS NOT NULL").mapInArrow(rare_scores, sums).groupBy("key").agg(
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    parts = parts.join(numbered, F.col("key") == F.col("number")).select(
        F.col("text_key").alias("key"), "n_tokens", "n_known", "base", "score")
    both = whole.unionByName(parts).groupBy("key").agg(
        F.count_if(F.col("n_tokens") > 0).alias("_rows"),
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    ids = docs.select("key", "id", "train").distinct()
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))  # repeated rows share a key
    out = both.join(ids.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).withColumn("_copy", copies)
    each = lambda c: F.col(c) / F.col("_rows")
    return out.select(F.col("id").alias(id_col), "train", each("n_tokens").cast("long").alias("n_tokens"),
                      each("n_known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                      each("base").alias("base_score"), each("score").alias("score"))


#: Columns of dealt rows (a group of heavy words has its cells in ``w`` and their counts in ``n``; ``train`` is 2 more for
#: a pair of heavy words), and of rows of whole words: words, types of each, the types' contexts and counts, tokens of
#: each word, the tokens' contexts, texts, numbers, marks (1: learned, 2: the first behind another word) and heavy words
#: behind; then pairs of heavy words: their keys, second words, contexts, counts, tokens of each, the tokens' texts, numbers.
#: ``num`` and ``text``: texts' numbers and keys (in dealt rows, as buckets beyond the last, ``w`` and ``key``).
DEALT = ["b", "w", "key", "ctx", "n", "train", "before", "link"]
LINKS = ["tokens", "at", "n", "mark"]
PAIRS = ["pair", "second", "pair_ctx", "pair_c", "pair_tokens", "pair_key", "pair_n"]
PACKED = ["w", "types", "ctx", "c", "tokens", "at", "key", "n", "mark", "next", *PAIRS, "num", "text"]


def _record(names, arrays) -> pa.RecordBatch:
    fixed = [a.view(np.int64) if isinstance(a, np.ndarray) and a.dtype == np.uint64 else a for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in fixed], names=list(names))


def _dealt(held, buckets: int) -> pa.RecordBatch:
    """One row per bucket; tokens of one word, context and text are one with a number. The sort puts a word's tokens
    side by side but for chance meetings of hash bits, which leave two entries for one and change no sum."""
    h, key, ctx, train, before, link = held = [np.concatenate(x) for x in zip(*held)]
    bucket = h % np.uint64(buckets)
    rest = _seed(key.view(np.uint64), ctx) >> np.uint64(44)
    order = np.argsort((bucket << np.uint64(44)) | ((h >> np.uint64(40)) << np.uint64(20)) | rest)
    held, bucket = [x[order] for x in held], bucket[order]
    if not len(h):
        ends = np.zeros(0, np.int64)
    else:
        ends = _ends(np.any([x[1:] != x[:-1] for x in held], axis=0))
    n = np.diff(ends, prepend=0).astype(np.int32)
    (h, key, ctx, train, before, link), bucket = (x[ends - 1] for x in held), bucket[ends - 1]
    ends = _ends(np.diff(bucket)) if len(h) else ends
    return pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1].astype(np.int32)),
                                       *(_blobs(ends, x) for x in (h, _apart(key, ends), ctx, n, train, before, link))],
                                      names=DEALT)


def _apart(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each row's numbers with their first bytes first, then their second ones and so on: those alike compress."""
    parts = [x[a:b].view(np.uint8).reshape(-1, 8).T.ravel() for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]
    return np.concatenate(parts).view(np.int64) if parts else x


def _joined(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).ravel()


def _numbered(number: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """A row of texts' numbers and keys, without words."""
    empty, end = pa.array([b""]), np.array([len(number)])
    return pa.RecordBatch.from_arrays([*(empty for _ in PACKED[:-2]), _blobs(end, number), _blobs(end, key)], names=PACKED)


def _packed(held) -> pa.RecordBatch:
    """Rows of whole words: their training types and all their tokens, both by word and context; pairs of heavy words are
    in the last row."""
    h, key, ctx, n, train, *links = (np.concatenate(x) for x in zip(*held))
    before, link = links or (np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint16))
    pair, train = train.astype(np.uint8) > 1, train.astype(np.uint8) & 1
    pairs = _packed_pairs(*(x[pair] for x in (h, key, ctx, n, train, link)))
    order = np.flatnonzero(~pair)
    order = order[np.argsort(h[order])]
    h, key, ctx, n, train, before, link = (x[order] for x in (h, key, ctx, n, train, before, link))
    first = np.append(0, _ends(h[1:] != h[:-1])[:-1])[:len(h)]
    word = np.zeros(len(h), np.int64)
    word[first[1:]] = 1
    cell = np.cumsum(word) * CONTEXTS + ctx
    order = np.lexsort((before, cell))
    key, n, train, cell, before, link = (x[order] for x in (key, n, train, cell, before, link))
    begins = np.append(True, (cell[1:] != cell[:-1]) | (before[1:] != before[:-1]))[:len(h)]
    of, count = cell[train > 0], n[train > 0].astype(np.int64)
    new = np.append(0, _ends(of[1:] != of[:-1])[:-1]) if len(of) else np.zeros(0, np.int64)
    of, count = of[new], np.add.reduceat(count, new) if len(new) else count
    types = np.bincount(of // CONTEXTS, minlength=len(first))
    tokens = np.diff(np.append(first, len(h)))
    type_ends, token_ends = np.cumsum(types), np.cumsum(tokens)
    words = _ends(np.diff(token_ends // ROW)) if len(h) else np.zeros(1, np.int64)
    a, b = (type_ends[words - 1], token_ends[words - 1]) if len(h) else (words, words)
    return pa.RecordBatch.from_arrays(
        [_blobs(words, h[first]), _blobs(words, types.astype(np.int32)), _blobs(a, (of % CONTEXTS).astype(np.uint8)),
         _blobs(a, count), _blobs(words, tokens.astype(np.int32)), _blobs(b, (cell % CONTEXTS).astype(np.uint8)),
         _blobs(b, key), _blobs(b, n), _blobs(b, (train + 2 * begins).astype(np.uint8)), _blobs(b, link),
         *(_blobs(np.append(np.zeros(len(words) - 1, np.int64), len(x)), x) for x in pairs),
         *(pa.nulls(len(words), pa.binary()) for _ in range(2))], names=PACKED)


def _packed_pairs(h, key, ctx, n, train, link) -> list[np.ndarray]:
    """The columns ``PAIRS`` of pairs of heavy words."""
    order = np.lexsort((ctx, h))
    h, key, ctx, n, train, link = (x[order] for x in (h, key, ctx, n, train, link))
    first = np.append(0, _ends((h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]))[:-1])[:len(h)]
    count = np.add.reduceat((n * train).astype(np.int64), first) if len(h) else np.zeros(0, np.int64)
    tokens = np.diff(np.append(first, len(h))).astype(np.int32)
    return [h[first], (link[first] - 1).astype(np.uint16), ctx[first], count, tokens, key, n]


def _packed_group(hashes: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
    """One row of a group of heavy words, all of which occur in training: their types alone."""
    some = np.flatnonzero(table)
    types = np.bincount(some // CONTEXTS)
    held, end = np.flatnonzero(types), np.array([len(some)])
    words = np.array([len(held)])
    none = pa.nulls(1, pa.binary())
    return pa.RecordBatch.from_arrays(
        [_blobs(words, hashes[held]), _blobs(words, types[held].astype(np.int32)),
         _blobs(end, (some % CONTEXTS).astype(np.uint8)), _blobs(end, table[some].astype(np.int64)),
         *(none for _ in PACKED[4:])], names=PACKED)
