"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regular expression. The texts of a batch become one array of code
points; a class table maps each code point to one of twelve character classes, and a small automaton
over those classes knows, from its state, the class and the next class, whether a token starts at a
position. The automaton's transition functions form a finite monoid (composition is associative), so
the states at all positions come from a two-pass scan: every block composes its functions, the block
results are chained, and each block then replays from its start state; both passes advance all blocks
at once. The resulting slices feed a pair merge whose results are cached per slice; the slices of a batch
that the cache lacks are merged side by side, one merge of each at a time.

Defined results: a null or empty text has no tokens and decodes to the empty string; repeated rows are
encoded alike; other columns pass through untouched, and output columns that clash replace theirs.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# -- character classes and the automaton ------------------------------------------------------

LETTER, ENDS, R, V, E, L, NUMBER, SPACE, BLANK, QUOTE, OTHER, STOP = range(12)
_LETTERS = (LETTER, ENDS, R, V, E, L)
# states: the kind of token that the last character belongs to
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, AT_QUOTE, QUOTE_R, QUOTE_V,
 QUOTE_L, CLOSED) = range(11)

# Unicode White_Space (fixed values)
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003,
               0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000]
# Letters and numbers of Unicode 16 that Python's Unicode 15.1 data lacks (fixed values)
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
              (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
              (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
              (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
              (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
              (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            table[cp] = kind
    for cls, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in ranges:
            table[first:last + 1] = cls
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    table[ord("'")] = QUOTE
    for ch, cls in (("s", ENDS), ("t", ENDS), ("m", ENDS), ("d", ENDS), ("r", R), ("v", V), ("e", E), ("l", L)):
        table[ord(ch)] = cls
    return table


def _step(state: int, cls: int) -> int:
    if cls == STOP:
        return START
    if cls == NUMBER:
        return IN_NUMBERS
    if cls == SPACE:
        return AFTER_SPACE
    if cls == BLANK:
        return AFTER_BLANK
    if cls == OTHER:
        return IN_OTHERS
    if cls == QUOTE:
        return IN_OTHERS if state in (IN_OTHERS, AFTER_SPACE, AT_QUOTE) else AT_QUOTE
    if state == AT_QUOTE:
        return {ENDS: CLOSED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(cls, IN_LETTERS)
    if (state, cls) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        return CLOSED
    return IN_LETTERS


def _starts(state: int, cls: int, ahead: int) -> bool:
    """Whether a token starts at a character of class ``cls``, the next one being ``ahead``."""
    if cls == STOP:
        return False
    if cls in (SPACE, BLANK):
        # a run of white space is one token but for its last character when more text follows
        return state not in (AFTER_SPACE, AFTER_BLANK) or ahead not in (SPACE, BLANK, STOP)
    if state == AFTER_SPACE:
        return False
    if cls == NUMBER:
        return state != IN_NUMBERS
    if cls in (QUOTE, OTHER):
        return state not in (IN_OTHERS, AT_QUOTE)
    if state == AT_QUOTE:
        return not (cls == ENDS or (cls in (R, V) and ahead == E) or (cls == L and ahead == L))
    return state not in (IN_LETTERS, QUOTE_R, QUOTE_V, QUOTE_L)


@lru_cache(maxsize=1)
def _machine():
    """(step table, start table, ids of the class functions, composition table, functions)."""
    step = np.array([[_step(s, c) for c in range(12)] for s in range(11)], np.uint8)
    starts = np.array([[[_starts(s, c, a) for a in range(12)] for c in range(12)] for s in range(11)], bool)
    identity = tuple(range(11))
    functions, ids, todo = [identity], {identity: 0}, [identity]
    while todo:
        f = todo.pop()
        for c in range(12):
            g = tuple(int(step[s, c]) for s in f)
            if g not in ids:
                ids[g] = len(functions)
                functions.append(g)
                todo.append(g)
    after = np.array([[ids[tuple(int(step[s, c]) for s in f)] for c in range(12)] for f in functions], np.uint16)
    return step, starts, after, np.array(functions, np.uint8)


BLOCK = 1024


def token_starts(points: np.ndarray) -> np.ndarray:
    """Mask of token starts over code points; a code point 0x110000 ends a text."""
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    step, starts, after, functions = _machine()
    classes = np.append(class_table(), np.uint8(STOP))[points]
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, STOP, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)  # one row per position in the block
    composed = np.zeros(rows, np.uint16)
    flat_after = after.ravel()
    for line in grid:
        composed = flat_after[composed.astype(np.int32) * 12 + line]
    state = np.empty(rows, np.uint8)
    now = START
    for i, f in enumerate(functions[composed]):
        state[i] = now
        now = f[now]
    before = np.empty((BLOCK, rows), np.uint8)
    flat_step = step.ravel()
    for j, line in enumerate(grid):
        before[j] = state
        state = flat_step[state.astype(np.int16) * 12 + line]
    before = before.T.ravel()[:n]
    ahead = np.append(classes[1:], np.uint8(STOP))
    return starts.ravel()[(before.astype(np.int16) * 12 + classes) * 12 + ahead]


def flat_slices(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The slices of all texts, one after the other, and the number of slices of each, by one scan."""
    joined = "\x00".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    points[ends] = 0x110000
    starts = token_starts(points)
    cuts = np.flatnonzero(starts)
    starts[ends] = True  # a slice goes up to the next slice or to the end of its text
    stops = np.flatnonzero(starts)
    stops = stops[np.searchsorted(stops, cuts, "right")]
    counts = np.diff(np.searchsorted(cuts, ends), prepend=0)
    return [joined[i:j] for i, j in zip(cuts.tolist(), stops.tolist())], counts


def slices(texts: list[str]) -> list[list[str]]:
    """The slices of each text, by one scan over the batch."""
    pieces, counts = flat_slices(texts)
    stops = np.cumsum(counts).tolist()
    return [pieces[j - n:j] for j, n in zip(stops, counts.tolist())]


# -- pair merging -----------------------------------------------------------------------------

#: Slices kept in a worker's cache; beyond it the cache starts anew (a bound on memory, not on input).
CACHE_SLICES = 250_000
NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id; one per worker process and vocabulary file."""
    return {rank: token for token, rank in read_ranks(path).items()}


class Merger:
    """Ranks of a vocabulary and the cached pair merge over them."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.byte_ids = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}  # ids of two neighbours -> id of their merge
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        order = sorted(self.pairs)
        self.keys = np.array([*order, NONE], np.int64)  # the last one matches no pair
        self.merged = np.array([*map(self.pairs.__getitem__, order), NONE], np.int64)
        self.byte_table = np.array(self.byte_ids, np.int64)
        left, right = np.repeat(self.byte_table, 256), np.tile(self.byte_table, 256)
        self.byte_pairs = self._ranks_of(left, right)  # by two neighbouring bytes
        self._start_cache()

    def _start_cache(self) -> None:
        self.cache: dict[str, int] = {}  # slice -> its place in the two arrays
        self.counts = np.zeros(0, np.int64)  # ids of each slice
        self.found = np.zeros(0, np.int32)  # the ids, one slice after the other

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours; NONE where they do not merge."""
        wanted = left << 20 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.merged[at], NONE)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        return tuple(self.merge_all([piece])[0].tolist())

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one piece after the other, and how many each has."""
        owners, parts = [], []  # places of pieces, repeated for each id, and the ids
        short = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is None and len(piece) <= 200:
                short.append(k)
            else:
                ids = (whole,) if whole is not None else self._merge_long(piece)
                parts.append(np.array(ids, np.int64))
                owners.append(np.full(len(ids), k, np.int64))
        if short:
            own, ids = self._merge_short([pieces[k] for k in short])
            owners.append(np.array(short, np.int64)[own])
            parts.append(ids)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        owner = np.concatenate(owners)
        ids = np.concatenate(parts)[np.argsort(owner, kind="stable")]
        return ids.astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def _merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(piece, id) of the merged pieces, all merged at once: each round merges the first pair of lowest
        rank of every piece, and pieces without such a pair leave."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ids, own = self.byte_table[data], np.repeat(np.arange(len(pieces)), sizes)
        ranks = np.full(len(ids), NONE, np.int64)  # of each id and the next one
        ranks[:-1] = self.byte_pairs[data[:-1] << 8 | data[1:]]
        ranks[:-1][own[:-1] != own[1:]] = NONE
        done_own, done_ids = [], []
        while len(ids):
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(heads, append=len(ids)))
            over = lowest == NONE
            if over.any():
                done_own.append(own[over])
                done_ids.append(ids[over])
                ids, own, ranks, lowest = ids[~over], own[~over], ranks[~over], lowest[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == lowest)
            at = at[np.diff(own[at], prepend=-1) != 0]
            ids[at] = ranks[at]  # a merged pair's rank is its id
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places after the second ids of earlier pieces are gone
            ids, own, ranks = ids[keep], own[keep], ranks[keep]
            for left in (at[at > 0] - 1, at[at + 1 < len(ids)]):
                ranks[left] = np.where(own[left] == own[left + 1], self._ranks_of(ids[left], ids[left + 1]), NONE)
            if at[-1] == len(ids) - 1:
                ranks[-1] = NONE
        owner = np.concatenate(done_own) if done_own else own
        order = np.argsort(owner, kind="stable")
        return owner[order], (np.concatenate(done_ids) if done_ids else ids)[order]

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merge with a heap over a linked list, for slices of any length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        back = list(range(-1, n - 1))
        alive = [True] * n

        def rank_at(i: int):
            j = end[i]
            return ranks.get(piece[i:end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, end[j]
            if end[i] < n:
                back[end[i]] = i
            for k in (i, back[i]):
                if k >= 0 and (q := rank_at(k)) is not None:
                    heapq.heappush(heap, (q, k, end[end[k]]))
        return tuple(ranks[piece[i:end[i]]] for i in range(n) if alive[i])

    def ids(self, pieces: list[str]) -> list[int]:
        return self.batch_ids(pieces)[0].tolist()

    def batch_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices, one slice after the other, and how many each has."""
        if len(self.cache) >= CACHE_SLICES or len(self.found) >= 16 * CACHE_SLICES:
            self._start_cache()
        cache = self.cache
        new = [p for p in dict.fromkeys(pieces) if p not in cache]
        if new:
            found, counts = self.merge_all([p.encode() for p in new])
            cache.update(zip(new, range(len(self.counts), len(self.counts) + len(new))))
            self.found, self.counts = np.concatenate([self.found, found]), np.concatenate([self.counts, counts])
        at = np.fromiter(map(cache.__getitem__, pieces), np.int64, len(pieces))
        for p in new:
            if len(p) > 64:
                del cache[p]
        counts = self.counts[at]
        first = (np.cumsum(self.counts) - self.counts)[at]
        place = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        return self.found[place], counts


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    """One per worker process and vocabulary file."""
    return Merger(path)


# -- DataFrame operators ----------------------------------------------------------------------

BATCH_CHARS = 500_000


def _runs(sizes: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``most``."""
    start = total = i = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if total:
        yield start, i + 1


def _encoder(names: list[str], vocabulary: str, text_col: str, ids_col: str, offsets_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merger(vocabulary)
        lengths = np.zeros(max(bpe.ranks.values()) + 1, np.int32)
        for token, rank in bpe.ranks.items():
            lengths[rank] = len(token)
        for batch in batches:
            column = batch.column(text_col)
            for a, b in _runs((n or 0 for n in pc.binary_length(column).to_pylist()), BATCH_CHARS):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                pieces, n_pieces = flat_slices(texts)
                flat, n_ids = bpe.batch_ids(pieces)
                ends = np.append(0, np.cumsum(n_ids))[np.append(0, np.cumsum(n_pieces))]
                size = lengths[flat]
                before = np.append(0, np.cumsum(size))  # bytes of the whole batch before each id
                offs = (before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))).astype(np.int32)
                ends = ends.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(a, b - a) for n in names),
                     pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, offs)],
                    names=[*names, ids_col, offsets_col])

    return run


def _decoder(names: list[str], vocabulary: str, ids_col: str, decoded_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = token_bytes(vocabulary).__getitem__
        for batch in batches:
            ids = batch.column(ids_col)
            for a, b in _runs(map(lambda n: n or 0, ids.value_lengths().to_pylist()), BATCH_CHARS // 2):
                decoded = [b"".join(map(of, r.tolist())) for r in _rows(ids.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(a, b - a) for n in names), pa.array(decoded, pa.binary())],
                    names=[*names, decoded_col])

    return run


def _encoded(df: DataFrame, text_col: str, ids_col: str, offsets_col: str) -> list[T.StructField]:
    kept = [f for f in df.schema.fields if f.name not in (text_col, ids_col, offsets_col)]
    return [*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType())),
            T.StructField(offsets_col, T.ArrayType(T.IntegerType()))]


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids",
           offsets_col: str = "offsets") -> DataFrame:
    """Adds ``ids`` array<int> and ``offsets`` array<int> (first byte of each token in the UTF-8 text).

    ``vocabulary`` is a rank file at the same path on every executor. The text column is dropped.
    """
    fields = _encoded(df, text_col, ids_col, offsets_col)
    names = [f.name for f in fields[:-2]]
    return df.select(*names, text_col).mapInArrow(
        _encoder(names, vocabulary, text_col, ids_col, offsets_col), T.StructType(fields))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds ``decoded`` binary: the bytes that the ids stand for. Null ids decode to nothing."""
    kept = [f for f in df.schema.fields if f.name != decoded_col]
    names = [f.name for f in kept]
    return df.select(*names).mapInArrow(_decoder(names, vocabulary, ids_col, decoded_col),
                                        T.StructType([*kept, T.StructField(decoded_col, T.BinaryType())]))


def encode_decode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids",
                  offsets_col: str = "offsets", decoded_col: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one Python pass: the ids of a batch are decoded in the worker that made
    them, which halves the workers that an executor holds."""
    fields = [f for f in _encoded(df, text_col, ids_col, offsets_col) if f.name != decoded_col]
    names = [f.name for f in fields[:-2]]
    encoder = _encoder(names, vocabulary, text_col, ids_col, offsets_col)
    decoder = _decoder([f.name for f in fields], vocabulary, ids_col, decoded_col)
    return df.select(*names, text_col).mapInArrow(
        lambda batches: decoder(encoder(batches)), T.StructType([*fields, T.StructField(decoded_col, T.BinaryType())]))


def _rows(lists: pa.ListArray) -> Iterator[np.ndarray]:
    for item in lists:
        yield np.zeros(0, np.int32) if not item.is_valid else item.values.to_numpy(zero_copy_only=False)
