"""Whole jobs where an operator once stopped early."""

from __future__ import annotations

import random

import pytest

from tests.llm.data import without_repeats
from veritext.llm import lines, substrings


def firsts(rows: list[tuple[int, str]]) -> dict[str, int]:
    """First document of any alike line, per line of one leaf."""
    split = [(doc, m, m.split(" ")) for doc, m in rows]
    return {m: min(d for d, _, u in split if len(u) == len(t)
                   and 100 * sum(x == y for x, y in zip(t, u)) >= lines.SIMILAR * len(t)) for _, m, t in split}


@pytest.mark.parametrize("small,medium", [(lines.SMALL, lines.MEDIUM), (8, 60), (8, 8)])
def test_every_line_finds_its_first_alike_line(spark, small, medium):
    """Leaves of many templates; small nodes force them to grow place by place."""
    rng = random.Random(2)
    rows, want = [], {}
    for n in (4, 5, 6, 8, 10, 13, 25):
        seeds = [[rng.choice("abcdef") for _ in range(n - 3)] for _ in range(12)]
        leaf = set()
        for s in seeds:
            for _ in range(6):
                t = list(s)
                for _ in range(rng.randint(0, n * 3 // 10)):
                    t[rng.randrange(n - 3)] = rng.choice("abcdef")
                leaf.add(" ".join(["in", "this", f"leaf{'x' * n}", *t]))
        some = [(len(rows) + i, m) for i, m in enumerate(rng.sample(sorted(leaf), len(leaf)), 1)]
        rows += some
        first = firsts(some)
        want.update({doc: int(first[m] < doc) for doc, m in some})
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.dedup(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), small=small, medium=medium).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_rounds_do_not_grow_with_the_lines_of_a_frame(spark, monkeypatch):
    """3000 lines of one frame, no two alike, and 3000 alike ones: few rounds, right results."""
    names, inner = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: names.append(name) or inner(df, name))
    rows = [(i, f"the price of w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} is "
                f"v{chr(97 + i // 676)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}") for i in range(3000)]
    rows += [(3000 + i, f"Dear reader and friend n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}, " + "we write to you " * 30)
             for i in range(3000)]
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.dedup(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: int(i > 3000) if i >= 3000 else 0 for i in range(6000)}
    assert names.count("line-nodes") <= 8


def test_long_lines_are_masked_in_linear_time(spark):
    import time

    rows = [(1, "1 " + "x" * 1_000_000), (2, "2 " + "x" * 1_000_000), (3, "a1 " * 300_000), (4, "\n".join(["q r s t"] * 200_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["dropped_lines"], len(r["text"])) for r in lines.dedup(df).collect()}
    assert time.perf_counter() - began < 60
    assert got == {1: (0, 1_000_002), 2: (1, 0), 3: (0, 900_000), 4: (0, 1_599_999)}


@pytest.mark.parametrize("bits", [substrings.ANCHOR_BITS, 15, 3])  # a full bitmap lets all through
def test_automata_are_bounded(spark, monkeypatch, bits):
    """A phrase in ever different surroundings: no automaton gets more than ``shard`` passages, no window is lost."""
    rng = random.Random(4)
    phrase = [f"p{i}" for i in range(9)]
    around = [[rng.choice("abc") for _ in range(rng.randint(3, 8))] for _ in range(12)]
    texts = {i: " ".join([*rng.choice(around), *phrase, *rng.choice(around), f"own{i}"]) for i in range(80)}
    largest, inner = [], substrings._first_documents

    def watched(shards, window):
        largest.append(max((r["count"] for r in shards.groupBy("anchor").count().collect()), default=0))
        return inner(shards, window)

    monkeypatch.setattr(substrings, "_first_documents", watched)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(
        df, bits=bits, shard=4).collect()}
    want = without_repeats(texts)
    assert got == want and any(n for _, n, _ in want.values()) and max(largest) <= 4
