"""Words of a batch of texts as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C55)


class Words(NamedTuple):
    """``hash`` (uint64) and byte range of each word in ``data``; text i has words first[i] to first[i+1]."""
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64)
                 for b in (_ODD, inverse))


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run values[start:end]; equal runs have equal hashes wherever they stand."""
    up, down = _powers(1 << max(16, len(values).bit_length()))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:len(values)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def split_words(texts: list[bytes], lower: bool = False) -> Words:
    """Words between ASCII white space; equal words have equal hashes in every batch."""
    data = b"\n" + b"\n".join(texts) + b"\n"
    if lower:
        data = data.lower()  # on bytes: A-Z only
    a = np.frombuffer(data, np.uint8)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(blank.view(np.int8)))
    start, end = edge[0::2] + 1, edge[1::2] + 1
    size = 1 << max(16, len(a).bit_length())
    up, down = _powers(size)
    total = np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:len(a)], dtype=np.uint64)
    value = (total[end - 1] - total[start - 1]) * down[start]
    heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(mix(value), start, end, np.searchsorted(start, heads), data)


def text_batches(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; nulls count as empty."""
    begin = total = 0
    sizes = pc.binary_length(column).to_pylist()
    for i, n in enumerate(sizes):
        if total and total + (n or 0) > most:
            yield begin, i
            begin, total = i, 0
        total += (n or 0) + 1
    if sizes:
        yield begin, len(sizes)


def texts_of(column: pa.Array, a: int, b: int) -> list[bytes]:
    return [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
