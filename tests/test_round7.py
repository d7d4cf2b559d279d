"""op9: texts are dealt and words are written in packed rows, with the same scores however rows are dealt to tasks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.llm import hpylm

TEXTS, WORDS = 400, 3000


def _docs(spark):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.4)) % WORDS}" for _ in range(20 * TEXTS)]
    rows = [(i, " ".join(words[20 * i:20 * i + rng.randint(0, 20)])) for i in range(TEXTS)]
    return spark.createDataFrame([*rows, (1, rows[1][1]), (None, None), (3, "another text")], "doc_id long, text string")


def _scores(docs, **kw):
    got = hpylm.score(docs, F.col("doc_id") % 5 != 1, **kw).collect()
    return sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)


def test_words_are_written_in_packed_rows(spark, monkeypatch):
    seen, inner = {}, hpylm.written
    monkeypatch.setattr(hpylm, "written", lambda df, name, **kw: seen.setdefault(name, inner(df, name, **kw)))
    hpylm.score(_docs(spark), F.lit(True), heavy=32)
    words = seen["lm-vocabulary"].count()
    assert words > 500 and seen["lm-words"].count() < words / 10
    kept = np.concatenate([np.frombuffer(r["w"], np.int64) for r in seen["lm-words"].select("w").collect()])
    assert sorted(kept.tolist()) == sorted(r["w"] for r in seen["lm-vocabulary"].collect())


@pytest.mark.parametrize("heavy", [1, 32, 1 << 14])
def test_scores_do_not_depend_on_how_rows_are_packed(spark, monkeypatch, heavy):
    docs = _docs(spark)
    want = _scores(docs.coalesce(1), heavy=heavy)
    assert len(want) == TEXTS + 3
    for name, value in (("HELD", 50), ("GATHERED", 1), ("BUCKETS", 7)):  # read by the closures that tasks get
        monkeypatch.setattr(hpylm, name, value)
    assert _scores(docs.repartition(5), heavy=heavy) == want


def test_rows_hold_whole_words(monkeypatch):
    monkeypatch.setattr(hpylm, "ROW", 8)
    monkeypatch.setattr(hpylm, "PART_BYTES", 64)
    rng = np.random.default_rng(7)
    n = 500
    h, key, ctx = rng.integers(0, 60, n).astype(np.uint64), rng.integers(0, 9, n), rng.integers(0, 256, n).astype(np.uint8)
    number, train = rng.integers(1, 4, n).astype(np.int32), rng.random(n) < 0.7
    halves = [[x[a:b] for x in (h, key, ctx, number, train)] for a, b in ((0, 200), (200, n))]
    types, tokens, words = {}, [], []
    parts = list(hpylm._parts(iter([hpylm._packed(halves)]), "key"))
    assert len(parts) > 20
    for part in parts:
        word, c, count, of = hpylm._unpack(part)
        assert part.num_rows == 1 or len(hpylm._values(part, "at", np.uint8)) <= 32
        words += word.tolist()
        types.update(zip(zip(word[of].tolist(), c.tolist()), count.tolist()))
        of = np.repeat(word, hpylm._values(part, "tokens", np.int32))
        tokens += zip(of.tolist(), hpylm._values(part, "at", np.uint8).tolist(), hpylm._values(part, "key", np.int64).tolist(),
                      hpylm._values(part, "n", np.int32).tolist())
    want: dict = {}
    for w, c, k, t in zip(h.tolist(), ctx.tolist(), number.tolist(), train.tolist()):
        if t:
            want[w, c] = want.get((w, c), 0) + k
    assert words == sorted(set(h.tolist())) and types == want
    assert sorted(tokens) == sorted(zip(h.tolist(), ctx.tolist(), key.tolist(), number.tolist()))
