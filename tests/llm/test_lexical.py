"""Ranked lexical search against scoring every document, and against SQL."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest

from tests.llm.data import edge_docs, empty_docs
from tests.oracle_harness import digest, duck
from veritext.llm import lexical as L, queries

ITEMS = "item_id long, text string, term string, doc string, score string"


def plain_terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    held = [(i, plain_terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df: dict = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = set()
    for item in {i for i, _ in items}:
        query = [t for x in {t for i, t in items if i == item} for t in plain_terms(x)]
        ranked = []
        for i, w in held:
            score = 0
            for t in query:
                if t in w:
                    m = 75 + 25 * len(w) * n_docs // total
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * (10 ** 9 * w.count(t) // (1000 * w.count(t) + 12 * m))
            if score > 0:
                ranked.append((-score, i is None, i or 0))
        out |= {(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(ranked)[:k], 1)}
    return out


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], ITEMS)


def found(df):
    rows = [(r["item"], r["rank"], r["doc"], r["score"]) for r in df.collect()]
    assert len(set((r[0], r[1]) for r in rows)) == len(rows)
    return set(rows)


def test_terms():
    for text in ("Don't STOP-me now_42", "Été ÉTÉ İI ß", "", " \x00\x7f{}", "日本 語,x"):
        assert [t.decode() for t in L.terms(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("block_docs,query_terms", [(8192, 200_000), (7, 200_000), (50, 40)])
def test_equals_scoring_every_document(spark, monkeypatch, block_docs, query_terms):
    monkeypatch.setattr(L, "BLOCK_DOCS", block_docs)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    chance = 1 / np.arange(1, 61)
    docs = [(int(i // 2), " ".join(rng.choice(words, int(rng.integers(0, 30)), p=chance / chance.sum())))
            for i in range(300)] + [(None, "w50 w51"), (1000, None), (1001, "w50 w51"), (1002, "w51 w50")]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(12)] + [
        (50, "w50 w50 W51"), (50, "w50 w50 W51"), (51, ""), (52, None), (53, "unknown"), (None, "w3 w59"), (54, "w1"),
        (54, "w2 w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(L.search(df, items_table(spark, items), k=5, query_terms=query_terms)) == brute(docs, items, 5)


def test_accumulators_are_limited_and_survivors_exact():
    # document 0 holds the rare term; the common terms alone cannot reach it, so no other gets an accumulator
    n = 400
    ids = np.array([0, *[1] * n], np.int32)
    place = np.array([0, *range(n)])
    block = L.Block(ids, np.ones(len(ids), np.int64), place, np.full(n, 100), np.array([5000, 1], np.int64))
    docs, scores = block.best([(0, 1), (1, 1)], 1, 0)
    part = 10 ** 9 // 2200
    assert docs.tolist() == [0] and scores.tolist() == [5001 * part]
    # an equal score is let in: ties are for the ids to decide
    docs, _ = block.best([(1, 1)], 1, part)
    assert len(docs) == n
    assert len(block.best([(1, 1)], 1, part + 1)[0]) == 0


def test_odd_rows(spark):
    got = found(L.search(edge_docs(spark), items_table(spark, [(1, "fox"), (2, "日本語 w3x3"), (3, "xyzzy")])))
    assert {r[0] for r in got} == {1, 2} and {r[2] for r in got if r[0] == 1} == {1, 2, 3, None}
    assert found(L.search(empty_docs(spark), items_table(spark, [(1, "fox")]))) == set()
    assert found(L.search(edge_docs(spark), items_table(spark, []))) == set()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.op13_lexical_search(spark, sf)
    want = duck(sf).sql(queries.ORACLES["op13_lexical_search"])
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(want.columns, want.fetchall())
