"""Small tables for the corpus operators: every kind of odd row, and brute-force versions."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside
                     *(T.StructField(c, T.StringType()) for c in (
                         "size", "h", "fp", "ids", "kept", "doc", "version", "key", "anchor", "copies", "score",
                         "n_words", "_w", "target", "leaf", "shares", "dropped_lines", "decoded", "_key", "_doc",
                         "_source", "_id", "_version", "_copies", "row", "of", "id", "h2", "tie", "cut", "times", "gone",
                         "stats", "trains", "spans", "_bit", "left_text", "left_count"))])
EXTRA = len(DOCS.fields) - 5

PROSE = ("the quick brown fox jumps over the lazy dog while the other animals watch from the far side of the "
         "old river and wonder what all of this noise could mean for them today")


def edge_rows():
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"),  # a repeated row
        (2, PROSE, "en", "b"), (3, PROSE + " and more words follow", "en", "a"),
        (4, None, "en", "a"), (5, "", "fr", None), (6, " \n\t\x0b \n", None, "b"),
        (None, PROSE.upper(), None, None), (None, "no id here but some words all the same", "de", "a"),
        (7, long_text, "de", "c"), (8, "x" * 50_000, "en", "c"), (9, "one", "fr", "c"), (10, "one two", "fr", "c"),
        (11, "日本語 のテキスト\u00a0と\u2003空白 ünïcödé 😀 ' 's 'll don't", "ja", "d"),
        (12, "line one is here\nline one is here\nPage 12 of 30\nlast", "en", "a"),
        (13, "line one is here\nother words\nPage 13 of 30\nlast", "en", "b"),
        (13, "another text under one id", "en", "b"),
    ]
    return [(i, t, lang, s, len(t) if t else None, *(["x"] * EXTRA)) for i, t, lang, s in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def simhash(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], bits: int = 3) -> list[int]:
    """Index of the first member of each one's component."""
    x, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= bits) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(x))]


def without_repeats(texts: dict[int, str | None], window: int = 13) -> dict[int, tuple[int, int, str]]:
    """(n_words, n_removed, kept) per id."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first: dict = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s:s + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out
