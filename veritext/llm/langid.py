"""Language identification by multilingual mixture inference.

Per language, letter 3-grams (a word is padded by a space on each side) are counted over all training
texts into a hashed table of fixed size. A document is a mixture: each of its words comes from one
language, with the likelihood of its n-grams; expectation-maximisation estimates the languages'
proportions. The language set is chosen among the nested sets of the 1, 2, ... languages of largest share:
it grows, up to all that were learned, as long as the penalised likelihood (BIC) rises; the prediction is the
largest share in it.

Only texts and labels of training rows are learned from, only texts are predicted from.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when
there is nothing to learn from; ties go to the smaller language name; repeated rows are predicted alike;
an empty table gives an empty result; long texts are read whole, a text at a time; other columns pass
through, clashing output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.bpe import ENDS, LETTER, E, L, R, V, class_table

#: Buckets of the n-gram tables: half a megabyte of counts per language.
BUCKETS = 1 << 17
SMOOTHING = 0.05
ROUNDS = 8
PENALTY = 3.0
BATCH_CHARS = 500_000
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the n-gram around each letter, first letter of each word, first word of each text and
    the end)."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
    letter = np.isin(np.arange(12), (LETTER, ENDS, R, V, E, L))[class_table()[points]]
    code = np.where(letter, points, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    mix = code[at - 1] * np.uint64(0x9E3779B97F4A7C15)
    mix = (mix ^ (mix >> np.uint64(29))) + code[at] * np.uint64(0xBF58476D1CE4E5B9)
    mix = (mix ^ (mix >> np.uint64(31))) + code[at + 1] * np.uint64(0x94D049BB133111EB)
    mix = mix * np.uint64(0xD6E8FEB86659FD93)
    bucket = (mix >> np.uint64(47)).astype(np.int64)
    word = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    ends = np.cumsum([0, *(len(t) + 1 for t in lowered)]) + 1  # where each text starts, then the end
    return bucket, word, np.searchsorted(at[word], ends)


def _batches(column: pa.Array) -> Iterator[tuple[int, int]]:
    start = total = 0
    sizes = pc.binary_length(column).to_pylist()
    for i, n in enumerate(sizes):
        if total and total + (n or 0) > BATCH_CHARS:
            yield start, i
            start, total = i, 0
        total += (n or 0) + 1
    if sizes:
        yield start, len(sizes)


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, bucket]): one table of fixed size per language comes to
    the driver; it grows with the number of languages only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in _batches(batch.column(1)):
                langs = batch.column(0).slice(a, b - a).to_pylist()
                texts = batch.column(1).slice(a, b - a).to_pylist()
                for lang in set(langs):
                    bucket, _, _ = grams([t for t, x in zip(texts, langs) if x == lang])
                    seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    seen[lang] += np.bincount(bucket, minlength=BUCKETS)
        for lang, counts in seen.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)),
                 pa.array(counts[some])], names=["lang", "bucket", "n"])

    known = train.select(F.col(lang_col).cast("string"), text_col).filter(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _expect(like: np.ndarray, share: np.ndarray, first: np.ndarray, words: np.ndarray, rounds: int):
    """Shares [text, language] after EM rounds, and the log likelihood of each text."""
    for _ in range(rounds):
        part = like * np.repeat(share, words, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / words[:, None]
    total = (like * np.repeat(share, words, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(total), first)


def mixtures(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Shares [text, language] of the chosen sets; a row of zeros for a text without a letter."""
    out = np.zeros((len(texts), len(logs)))
    bucket, word, first = grams(texts)
    words = np.diff(first)
    some = np.flatnonzero(words)
    if not len(some) or not len(logs):
        return out
    score = np.stack([np.add.reduceat(table[bucket], word, dtype=np.float64) for table in logs], axis=1)
    peak = score.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(score - peak, -60.0))
    first, words = first[:-1][some], words[some]
    start = np.full((len(some), len(logs)), 1.0 / len(logs))
    share, _ = _expect(like, start, first, words, ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best_value, best = np.full(len(some), -np.inf), np.zeros_like(share)
    rising = np.arange(len(some))  # texts whose set still grows
    for size in range(1, len(logs) + 1):
        inside = np.where(rank[rising] < size, np.maximum(share[rising], 1e-6), 0.0)
        inside /= inside.sum(axis=1, keepdims=True)
        held = np.isin(np.repeat(np.arange(len(some)), words), rising)
        n = words[rising]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        fitted, value = _expect(like[held], inside, starts, n, ROUNDS // 2 if size > 1 else 0)
        value = value - PENALTY * (size - 1) * np.log(n + 1)
        better = value > best_value[rising]
        rising = rising[better]
        if not len(rising):
            break
        best_value[rising], best[rising] = value[better], fitted[better]
    out[some] = best
    return out


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``df`` without its text, with lang_pred, score (the share of that language) and shares
    (map language -> share of the chosen set)."""
    langs, logs = model
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
            T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))]
    names = [c for c in df.columns if c not in (text_col, *(f.name for f in made))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            for a, b in _batches(column):
                share = mixtures([t or "" for t in column.slice(a, b - a).to_pylist()], logs)
                top = share.argmax(axis=1) if len(langs) else np.zeros(b - a, int)
                score = share.max(axis=1, initial=0.0)
                pred = [langs[i] if s > 0 else UNKNOWN for i, s in zip(top.tolist(), score.tolist())]
                sets = [[(langs[j], r[j]) for j in np.flatnonzero(r > 0).tolist()] for r in share]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(a, b - a) for n in names), pa.array(pred, pa.string()),
                     pa.array(np.minimum(score, 1.0), pa.float64()),
                     pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                    names=[*names, *(f.name for f in made)])

    schema = T.StructType([*(df.schema[n] for n in names), *made])
    return df.select(*names, text_col).mapInArrow(run, schema)
