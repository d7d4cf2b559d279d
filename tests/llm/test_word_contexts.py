"""F2, op9: every preceding word is a context of the language model, whether it is frequent or not."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.llm import hpylm
from veritext.llm.wordarrays import split_words

TEXTS = 700


def _texts():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.35)) % 900}" for _ in range(30 * TEXTS)]
    texts = [" ".join(words[30 * i:30 * i + rng.randint(0, 30)]) for i in range(TEXTS)]
    return texts + texts[:30]


def _hashes(text):
    return [int(h) for h in hpylm._tokens(split_words([text.encode()], lower=True))[0]]


def _contexts(words, classes):
    last, out = 0, []
    for i in range(len(words)):
        near = i > 0 and words[i - 1] in classes
        last = classes[words[i - 1]] if near else last
        out.append(0 if i == 0 else last if near else hpylm.CLASSES + 1 + last)
    return out


@pytest.mark.parametrize("heavy", [1, 3000, 1 << 14])
def test_scores_are_those_of_plain_counts(spark, monkeypatch, heavy):
    """From the classes' probabilities, scores follow by loops over the words of each text."""
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, written, grid = {}, hpylm.written, hpylm._grid

    def kept(words, m, *a):
        seen.update(m=m, grid=grid(words, m, *a))
        return seen["grid"]

    monkeypatch.setattr(hpylm, "written", lambda df, name, **kw: seen.setdefault(name, written(df, name, **kw)))
    monkeypatch.setattr(hpylm, "_grid", kept)
    got = {r["doc_id"]: r["score"] for r in hpylm.score(docs, F.col("doc_id") % 4 != 1, heavy=heavy).collect()}
    m = seen["m"]
    back, per = (hpylm.THETA + m["d"] * m["T"]) / (hpylm.THETA + m["C"]), hpylm.THETA + m["C"]

    texts = [_hashes(t) for t in texts]
    learned = [t for i, t in enumerate(texts) if i % 4 != 1]
    count = Counter(w for t in learned for w in t)
    large = sorted(w for w, n in count.items() if n * heavy >= sum(count.values()))
    best = sorted((w for w in large if w != hpylm.END), key=lambda w: (-count[w], w))[:hpylm.CLASSES]
    classes = {w: i + 1 for i, w in enumerate(best)}
    p = {(w, k): float(x) for w, row in zip(large, seen["grid"]) for k, x in enumerate(row)}
    rare, types = {}, {}
    for batch in seen["lm-words"].filter("tokens IS NOT NULL").toArrow().combine_chunks().to_batches():
        for part in hpylm._parts(iter([batch]), "key"):
            word, ctx, n, of = hpylm._unpack(part)
            own, root = hpylm._predictive(word, ctx, n, of, m, hpylm.BURN_IN * hpylm.SWEEPS, leaves=hpylm._leaves(part, ctx, of))
            rare.update(zip(word.tolist(), root))
            types.update(zip(zip(word[of].tolist(), ctx.tolist()), own))

    def of_class(w, k):
        return p[w, k] if (w, k) in p else rare[w] * back[k] + types.get((w, k), 0.0) / per[k]

    below, whole = Counter(), Counter()
    for t in learned:
        for i, k in enumerate(_contexts(t, classes)):
            if k > hpylm.CLASSES:
                below[k, t[i - 1], t[i]] += 1
                whole[k, t[i - 1]] += 1
    kinds = Counter((u in classes or u in large, w in large) for (_, u, w) in below)
    assert heavy != 3000 or len(kinds) == 4  # frequent and rare words behind and before each other
    for i, t in enumerate(texts):
        want = 0.0
        for j, k in enumerate(_contexts(t, classes)):
            x, a = of_class(t[j], k), m["alpha"][k]
            want += math.log10(x if k <= hpylm.CLASSES else (below[k, t[j - 1], t[j]] + a * x) / (whole[k, t[j - 1]] + a))
        assert abs(got[i] - want) < 1e-4 * max(1, len(t)), i


def test_a_rare_word_tells_the_next(spark):
    """Before, all words beyond the 127 most frequent stood for one context, so that these pairs scored alike."""
    fill = [" ".join(f"f{(7 * i + j) % 140}" for j in range(12)) for i in range(300)]
    learned = [f"a{i} b{i}" for i in range(40)] * 2
    asked = [f"a{i} b{j}" for i in range(40) for j in (i, (i + 1) % 40)]
    rows = [(i, t, i < len(fill) + len(learned)) for i, t in enumerate(fill + learned + asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = hpylm.score(docs, F.col("learn"), heavy=300).orderBy("doc_id").collect()[-len(asked):]
    own, other = (np.array([r["score"] for r in got[k::2]]) for k in (0, 1))
    assert (own > other + 0.2).all()
