"""Word classes by context (H13, J4): a hidden Markov model, trained by expectation-maximisation.

The hidden states are word classes (``TAGS`` and one for all other words), the observations are words, hashed
to ``SLOTS`` slots. A lexicon and suffix rules tell the model what they know as prior counts of emissions; how
classes follow each other, and what the other words are, it learns from all texts. In each round every task
runs the forward-backward recursions over its own texts and sums the expected starts, transitions and
emissions, a ``groupBy`` adds them, and the driver, which holds (classes x slots) numbers whatever the data,
makes the next parameters. Each text is then tagged by its most likely sequence (Viterbi).

A text is a sequence of its own; one without words adds nothing and has no tags. Ties go to the earlier tag.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.constants import TAG_FEATURES
from veritext.functions import text as T
from veritext.operators.lexicon import suffix_tag
from veritext.session import scratch_path

TAGS = (*TAG_FEATURES, "OTHER")
SLOTS = 1 << 14
ROUNDS = 5
#: Prior counts: of a word's listed class, of its suffix's class, and of any class.
LISTED, SUFFIXED, ANY = 50.0, 5.0, 0.05
#: Rows of texts that are worked on at once, by their words.
BATCH_WORDS = 1_000_000
#: Words of a text that are followed in one go; a long text is cut, exactly, into pieces of so many.
PIECE = 256


@dataclass
class Markov:
    """Probabilities: start [class], move [class, class], emit [class, slot]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def prior_counts(tag_lexicon: DataFrame, words: DataFrame, suffix_rules, slots: int = SLOTS) -> np.ndarray:
    """Prior emission counts [class, slot]: ``words`` (term, slot) are looked up in the lexicon, then by
    suffix. At most one row per class and slot comes back."""
    listed = tag_lexicon.groupBy(F.col("term").alias("_term")).agg(F.max("tag").alias("_listed"))
    known = words.join(listed, F.col("term") == F.col("_term"), "left")
    tag = F.coalesce("_listed", suffix_tag(F.col("term"), list(suffix_rules)))
    weight = F.when(F.col("_listed").isNotNull(), LISTED).otherwise(SUFFIXED)
    rows = known.select(tag.alias("tag"), "slot", weight.alias("w")).filter("tag IS NOT NULL").groupBy("tag", "slot").agg(
        F.max("w").alias("w"))
    out = np.full((len(TAGS), slots), ANY)
    place = {t: i for i, t in enumerate(TAGS)}
    for r in rows.toLocalIterator():
        out[place.get(r["tag"], len(TAGS) - 1), r["slot"]] += r["w"]
    return out


def first_model(prior: np.ndarray) -> Markov:
    n = len(prior)
    # the classes differ by their emissions alone at first, and tend a little to stay what they are
    move = np.full((n, n), 1.0) + 0.5 * np.eye(n)
    return Markov(np.full(n, 1 / n), move / move.sum(axis=1, keepdims=True), prior / prior.sum(axis=1, keepdims=True))


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, slots per text) of some texts at a time."""
    at, held, words = 0, [], 0
    for item in column:
        held.append(item.values.to_numpy(zero_copy_only=False).astype(np.int64) if item.is_valid else np.zeros(0, np.int64))
        words += len(held[-1])
        if words >= BATCH_WORDS:
            yield at, held
            at, held, words = at + len(held), [], 0
    if held:
        yield at, held


def _aligned(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length, so that those still running at a place are a prefix: (order, lengths, slots of
    all texts end to end, first slot of each)."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    lengths = sizes[order]
    flat = np.concatenate([texts[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    return order, lengths, flat, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def expected(texts: list[np.ndarray], m: Markov) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions over some texts, and their log likelihood.

    The recursions run over the pieces of all texts at once: what happens between a piece's ends is a matrix
    over the classes, found for all pieces together, so that the steps taken one after another do not grow
    with the longest text but for one per piece."""
    n, slots = m.emit.shape
    _, lengths, flat, first = _aligned(texts)
    start, move, emit, like = np.zeros(n), np.zeros((n, n)), np.zeros((n, slots)), 0.0
    if not len(lengths):
        return start, move, emit, like
    # the pieces of all texts: first word, words, and whether a text starts there
    pieces = -(-lengths // PIECE)
    of = np.repeat(np.arange(len(lengths)), pieces)
    head = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    nth = np.arange(len(of)) - head[of]
    begin = first[of] + nth * PIECE
    words = np.minimum(lengths[of] - nth * PIECE, PIECE)
    order = np.argsort(-words, kind="stable")
    begin, words = begin[order], words[order]
    spot = np.empty(len(order), np.int64)
    spot[order] = np.arange(len(order))  # where a text's pieces stand
    opening = (nth == 0)[order]
    running = np.searchsorted(-words, -np.arange(int(words[0])), side="left")  # pieces longer than each place
    # words by their place in their piece: those at one place stand together, pieces in order
    offset = np.concatenate([[0], np.cumsum(running)])
    piece = np.repeat(np.arange(len(words)), words)
    nth_word = np.arange(len(flat)) - np.repeat(np.cumsum(words) - words, words)
    slot = np.empty(len(flat), np.int64)
    slot[offset[nth_word] + piece] = flat[begin[piece] + nth_word]
    seen = m.emit.T[slot]
    steps = [(k, int(live), slice(offset[k], offset[k + 1])) for k, live in enumerate(running)]
    # what a piece does to any classes before it, but for a factor
    through = np.broadcast_to(np.eye(n), (len(words), n, n)).copy()
    for k, live, at in steps if pieces[0] > 1 else ():
        step = (through[:live].reshape(-1, n) @ m.move).reshape(live, n, n)
        if k == 0:
            step[opening[:live]] = np.eye(n)
        step *= seen[at][:, None]
        if k % 8 == 7 or live < len(words):
            step /= step.sum(axis=(1, 2), keepdims=True)
        through[:live] = step
    through /= through.sum(axis=(1, 2), keepdims=True)
    # classes before and after each piece, from piece to piece of a text
    enter, leave = np.empty((len(words), n)), np.ones((len(words), n))
    enter[spot[head]] = m.start
    most = int(pieces[0])  # the longest text is the first
    for k in range(1, most):
        at = head[:np.searchsorted(-pieces, -k, side="left")] + k
        now = np.einsum("ri,rij->rj", enter[spot[at - 1]], through[spot[at - 1]])
        enter[spot[at]] = now / now.sum(axis=1, keepdims=True)
    for k in range(most - 2, -1, -1):
        at = head[:np.searchsorted(-pieces, -(k + 1), side="left")] + k
        now = np.einsum("rij,rj->ri", through[spot[at + 1]], leave[spot[at + 1]])
        leave[spot[at]] = now / now.sum(axis=1, keepdims=True)
    forward, scale = np.empty((len(flat), n)), np.empty(len(flat))
    for k, live, at in steps:
        now = (enter[:live] if k == 0 else forward[offset[k - 1]:offset[k - 1] + live]) @ m.move
        if k == 0:
            now[opening[:live]] = m.start
        now *= seen[at]
        scale[at] = now.sum(axis=1)
        forward[at] = now / scale[at][:, None]
    like = float(np.log(scale).sum())
    shares, back = np.empty((len(flat), n)), leave
    for k, live, at in reversed(steps):
        share = forward[at] * back[:live]
        total = share.sum(axis=1, keepdims=True)
        shares[at] = share / total
        ahead = seen[at] * back[:live]
        if k == 0:
            before, some = enter[:live], ~opening[:live]
            start += shares[at][~some].sum(axis=0)
        else:
            before, some = forward[offset[k - 1]:offset[k - 1] + live], slice(None)
        # the pairs of neighbours add to one
        pair = ahead / (scale[at][:, None] * total)
        move += m.move * (before[some].T @ pair[some])
        behind = ahead @ m.move.T
        back[:live] = behind / behind.sum(axis=1, keepdims=True)
    emit = np.stack([np.bincount(slot, shares[:, c], slots) for c in range(n)])
    return start, move, emit, like


def best_path(texts: list[np.ndarray], m: Markov) -> list[np.ndarray]:
    """The most likely classes of each text."""
    order, lengths, flat, first = _aligned(texts)
    out = [np.zeros(0, np.int8) for _ in texts]
    if not len(lengths):
        return out
    with np.errstate(divide="ignore"):
        start, move, emit = np.log(m.start), np.log(m.move), np.log(m.emit.T)
    came = np.zeros((len(flat), len(m.start)), np.int8)
    longest = int(lengths[0])
    running = np.searchsorted(-lengths, -np.arange(longest), side="left")
    best = np.zeros((len(lengths), len(m.start)))
    for k in range(longest):
        live = running[k]
        at = first[:live] + k
        if k == 0:
            best[:live] = start + emit[flat[at]]
        else:
            ways = best[:live, :, None] + move[None]
            came[at] = ways.argmax(axis=1)
            best[:live] = ways.max(axis=1) + emit[flat[at]]
    path, now = np.empty(len(flat), np.int8), best.argmax(axis=1)
    for k in range(longest - 1, -1, -1):
        at = first[:running[k]] + k
        path[at] = now[:running[k]]
        now[:running[k]] = came[at, now[:running[k]]]
    for i, size, a in zip(order, lengths, first):
        out[i] = path[a:a + size]
    return out


def _round(rows: DataFrame, m: Markov) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    n, slots = m.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * slots + n * n + n + 1)
        for batch in batches:
            for _, texts in _blocks(batch.column(0)):
                start, move, emit, like = expected(texts, m)
                total += np.concatenate([emit.ravel(), move.ravel(), start, [like]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "part"])

    sums = rows.select("slots").mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part"))
    total = np.zeros(n * slots + n * n + n + 1)
    for r in sums.toLocalIterator():  # at most classes x (slots + classes + 1) + 1 rows
        total[r["cell"]] = r["part"]
    a, b = n * slots, n * slots + n * n
    return total[b:b + n], total[a:b].reshape(n, n), total[:a].reshape(n, slots), float(total[-1])


def fit(rows: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> tuple[Markov, list[float]]:
    """The model after ``rounds`` of expectation-maximisation over (slots), and the likelihood of each."""
    m, log = first_model(prior), []
    for _ in range(rounds):
        start, move, emit, like = _round(rows, m)
        log.append(like)
        start, move, emit = start + ANY, move + ANY, emit + prior
        m = Markov(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return m, log


def slots_of(words: str, slots: int) -> Column:
    """``textmodel.word_slots`` of an array of words; a batch hashes each of its distinct words once."""
    @F.arrow_udf("array<int>")
    def hashed(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_list(pa.large_string()))
        found = column.flatten().dictionary_encode()
        slot = [int(md5(w.encode()).hexdigest()[:8], 16) % slots for w in found.dictionary.to_pylist()]
        each = pa.array(slot, pa.int32()).take(found.indices)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, mask=column.is_null())

    return hashed(words)


def prepared(df: DataFrame, text_col: str = "cleaned_text", slots: int = SLOTS) -> DataFrame:
    """(review_id, words, slots), written: the words are hashed once for all rounds."""
    rows = df.select("review_id", T.tokens(text_col).alias("words"))
    rows = rows.select("review_id", "words", slots_of("words", slots).alias("slots"))
    path = scratch_path(df.sparkSession, "tagger-slots")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def tag_counts(rows: DataFrame, m: Markov) -> DataFrame:
    """(review_id, n_tokens, VERB, ADV, NOUN) of the most likely classes."""
    kind = rows.schema["review_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _blocks(batch.column(1)):
                counts = np.stack([np.bincount(p, minlength=len(TAGS)) for p in best_path(texts, m)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(counts.sum(axis=1)),
                     *(pa.array(counts[:, i]) for i in range(len(TAG_FEATURES)))], names=["review_id", "n_tokens", *TAG_FEATURES])

    return rows.select("review_id", "slots").mapInArrow(
        run, f"review_id {kind}, n_tokens long, " + ", ".join(f"{t} long" for t in TAG_FEATURES))


def tagged(df: DataFrame, tag_lexicon: DataFrame, suffix_rules, text_col: str = "cleaned_text",
           rounds: int = ROUNDS, slots: int = SLOTS) -> DataFrame:
    """Trains on all texts of ``df`` and counts the word classes of each."""
    rows = prepared(df, text_col, slots)
    words = rows.select(F.explode(F.arrays_zip(F.col("words").alias("term"), F.col("slots").alias("slot"))).alias("w"))
    prior = prior_counts(tag_lexicon, words.select("w.term", "w.slot").distinct(), suffix_rules, slots)
    model, _ = fit(rows, prior, rounds)
    return tag_counts(rows, model)
