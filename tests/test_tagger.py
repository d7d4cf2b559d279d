"""The hidden Markov tagger against enumeration of all class sequences."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from veritext.operators import tagger as TG
from veritext.plans import all_queries as A


def model(seed, classes=3, slots=5):
    rng = np.random.default_rng(seed)
    share = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return TG.Markov(share(classes), share(classes, classes), share(classes, slots))


def paths(text, m):
    for p in itertools.product(range(len(m.start)), repeat=len(text)):
        w = m.start[p[0]] * m.emit[p[0], text[0]]
        for a, b, x in zip(p, p[1:], text[1:]):
            w *= m.move[a, b] * m.emit[b, x]
        yield p, w


@pytest.mark.parametrize("seed", range(4))
def test_expectations_and_paths_equal_enumeration(seed):
    m, rng = model(seed), np.random.default_rng(seed)
    texts = [rng.integers(0, 5, n) for n in (4, 1, 0, 6, 2, 4)]
    start, move, emit, like = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    best = []
    for t in texts:
        if not len(t):
            best.append(())
            continue
        all_ = list(paths(t, m))
        total = sum(w for _, w in all_)
        like += np.log(total)
        for p, w in all_:
            start[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                move[a, b] += w / total
            for c, x in zip(p, t):
                emit[c, x] += w / total
        best.append(max(all_, key=lambda x: x[1])[0])
    got = TG.expected(texts, m)
    for a, b in zip(got, (start, move, emit, like)):
        assert np.allclose(a, b)
    assert [tuple(p.tolist()) for p in TG.best_path(texts, m)] == best


def test_training_raises_the_likelihood_and_uses_context(spark):
    rng = np.random.default_rng(5)
    # "the <noun> <verb> <adverb>": the words x0.. are nouns and y0.. verbs by their place alone
    texts = [(i, " . ".join(f"the x{rng.integers(6)} {'runs' if rng.random() < 0.3 else f'y{rng.integers(6)}'} quickly"
                            for _ in range(rng.integers(0, 6)))) for i in range(120)] + [(None, "the x1 y1 quickly"), (500, None)]
    df = spark.createDataFrame(texts, "review_id long, cleaned_text string").repartition(3)
    lexicon = spark.createDataFrame([("runs", "VERB"), ("dog", "NOUN")], "term string, tag string")
    rows = TG.prepared(df, slots=512)
    import pyspark.sql.functions as F
    words = rows.select(F.explode(F.arrays_zip(F.col("words").alias("term"), F.col("slots").alias("slot"))).alias("w"))
    prior = TG.prior_counts(lexicon, words.select("w.term", "w.slot").distinct(), [(1, "ly", "ADV")], 512)
    m, log = TG.fit(rows, prior, 8)
    assert len(log) == 8 and log[-1] > log[0] and all(b > a - 1e-6 * abs(a) for a, b in zip(log[1:], log[2:]))
    got = {r["review_id"]: r for r in TG.tag_counts(rows, m).collect()}
    assert len(got) == 122 and got[500]["n_tokens"] == 0
    n = sum(r["n_tokens"] for r in got.values())
    sentences = sum(r["ADV"] for r in got.values())
    assert sentences == sum((t or "").count("quickly") for _, t in texts)
    verbs = sum(r["VERB"] for r in got.values())
    assert verbs == sentences and n == 4 * sentences  # y0.. are verbs, as "runs" stands in their place


def test_query_counts_every_review(spark):
    rows = A.QUERIES["hmm_tags"](spark, SF_SMALL).collect()
    want = {r["review_id"]: r["n_tokens"] for r in A.QUERIES["tokens"](spark, SF_SMALL).collect()}
    assert {r["review_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["VERB"] + r["ADV"] + r["NOUN"] <= r["n_tokens"] for r in rows)
