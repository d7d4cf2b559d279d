"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, per operator."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.data import PROSE, edge_docs, edge_rows, empty_docs, sha, simhash, without_repeats
from veritext.llm import bpe, hpylm, langid, lines, mixing, quality, simhash as S, substrings, topk, urls

N = len(edge_rows())


def test_line_dedup(spark):
    rows = lines.dedup(edge_docs(spark)).collect()
    assert len(rows) == N
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["text"] for r in by[1]] == [PROSE] * 2 and by[4][0]["text"] is None and by[5][0]["text"] == ""
    assert by[2][0]["text"] == "" and by[2][0]["dropped_lines"] == 1  # the line stays in document 1
    assert by[12][0]["dropped_lines"] == 0
    assert sorted(r["text"] for r in by[13]) == ["another text under one id", "other words"]
    assert lines.dedup(empty_docs(spark)).collect() == []


def test_similar_lines_share_a_template(spark):
    words = [f"w{chr(97 + i)}" for i in range(12)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "else"])), (3, " ".join([*words[:3], *"abcdefghi"]))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "", 3: docs[2][1]}


def test_quality(spark):
    got = quality.judge(edge_docs(spark)).collect()
    assert len(got) == N
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[4]["n_words"] == by[5]["n_words"] == by[6]["n_words"] == 0
    assert by[4]["base_failed"] and not by[4]["kept"] and by[9]["base_failed"]
    assert by[1]["n_words"] == len(PROSE.split()) and by[1]["kept"] and by[12]["n_dup_lines"] == 1
    assert quality.judge(empty_docs(spark)).collect() == []
    assert quality.accepted(edge_docs(spark)).columns == edge_docs(spark).columns


def test_repeat_words_by_brute_force(spark):
    texts = ["a b c d e f a b c d e", "x " * 20, "a b c d e", "p q r s t p q r s t p q r s t u", "a b c d", ""]

    def brute(t):
        w = t.split()
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measures(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_language(spark):
    docs = edge_docs(spark)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == N
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (4, 5, 6))
    assert by[1]["lang_pred"] == "en" and 0 <= by[11]["score"] <= 1
    nothing = langid.fit(empty_docs(spark))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty_docs(spark), langid.fit(docs)).collect() == []


@pytest.mark.parametrize("bits", [substrings.ANCHOR_BITS, 15, 3])  # a full bitmap lets all through
def test_substrings(spark, bits):
    rows = edge_rows()
    got = substrings.dedup(edge_docs(spark), bits=bits).collect()
    assert len(got) == N
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 13}
    want = without_repeats(texts)
    seen = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got if r["doc_id"] in texts}
    assert seen == want and want[2][1] == len(PROSE.split()) and want[1][1] == 0
    assert substrings.dedup(empty_docs(spark)).collect() == []


def test_urls(spark):
    pages = [(1, None, "h"), (2, "nothing", "h"), (3, "http://A.Example.COM/en/9?q=1#x", "h"), (3, "http://A.Example.COM/en/9", "h"),
             (4, "https://www.example.com/en/", "h"), (5, "https://b.net/es/5", None), (6, "ftp://x.co.uk", "h"),
             (7, "http://xcom/", "h"), (8, "http://com", "h"), (None, "http://h.org/7", "h"), (9, "x://a://b/c", "h")]
    pages += [(100 + i, f"http://bad.org/{1000 + i}", "h") for i in range(40)]
    pages += [(200 + i, f"http://good.org/{2000 + i}", "h") for i in range(400)]
    labels = [(1000 + i, 0, 1) for i in range(40)] + [(2000 + i, 1, 0) for i in range(400)] + [(None, 0, 1), (2000, 1, 0)]
    p = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, host string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))
    got = urls.judge(p, lab, rules).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1][:3] == ("", "", None) and by[2][:3] == ("", "", None)
    assert by[3] == ("a.example.com", "/en/9", "example.com/en/", "block")
    assert by[4][2:] == ("www.example.com/en/", "allow") and by[5][2:] == ("net/es/", "block")
    assert by[6][:3] == ("x.co.uk", "", None) and by[7][2] is None and by[8][2] is None
    assert by[9][:2] == ("a:", "//b/c")
    assert {by[100 + i][3] for i in range(40)} == {"block"} and {by[200 + i][3] for i in range(400)} == {"allow"}
    assert urls.judge(p.limit(0), lab.limit(0), rules).collect() == []
    assert {r["verdict"] for r in urls.judge(p, lab.limit(0)).collect()} == {"allow"}


def test_mixing(spark):
    docs = edge_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == N and mixing.mix(empty_docs(spark)).collect() == []
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - total) < 1e-6 * total
    for rs in by.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-9 and {r["copies"] for r in rs} <= {0, 1, 2, 3}
        taken = sum(r["copies"] * r["size"] for r in rs)
        assert abs(taken - rs[0]["target"]) <= max(r["size"] for r in rs)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["copies"] for r in got)


def test_bpe(spark):
    docs = edge_docs(spark)
    got = bpe.decode(bpe.encode(docs, P.VOCABULARY), P.VOCABULARY).collect()
    assert len(got) == N
    texts = {(r[0], sha(r[1] or "")) for r in edge_rows()}
    assert {(r["doc_id"], sha(bytes(r["decoded"]))) for r in got} == texts
    assert all(len(r["ids"]) == len(r["offsets"]) for r in got)
    assert bpe.encode(empty_docs(spark), P.VOCABULARY).collect() == []


def test_simhash(spark):
    got = S.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == N
    want = sorted((r[0] or -1, f"{simhash(r[1]):016x}") for r in edge_rows())
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in got) == want
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by[2] == 1 and by[4] == by[5] == by[6] == 4
    assert S.near_duplicates(empty_docs(spark)).collect() == []
    kept = S.representatives(edge_docs(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 in ids and 5 not in ids
    assert kept.columns == edge_docs(spark).columns and S.representatives(empty_docs(spark)).collect() == []


def test_language_model(spark):
    rows = edge_rows()
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = hpylm.score(edge_docs(spark), learn).collect()
    assert len(got) == N
    counts: dict = {}
    for r in rows:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1:
            for w in [*(r[1] or "").lower().encode().split(), None]:
                counts[w] = counts.get(w, 0) + 1
    assert {r["train_tokens"] for r in got} == {sum(counts.values())}
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[7]["n_tokens"] == 60_001
    assert by[1]["n_known"] == len(PROSE.split()) + 1 and all(r["score"] < 0 for r in got)
    assert hpylm.score(empty_docs(spark), learn).collect() == []
    untrained = hpylm.score(edge_docs(spark), F.lit(False)).collect()
    assert len(untrained) == N and {r["n_known"] for r in untrained} == {0}


def test_top_k(spark):
    v = [(1, [0.5, 0.5], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, None, 0), (4, [0.1, None], 0), (5, [float("nan"), 1.0], 0),
         (6, [float("inf"), 1.0], 0), (7, [-0.5, 0.25], 0), (8, [], 0), (9, [1.0], 0), (None, [0.5, 0.5], 0), (10, [0.5, 0.5], 0),
         (11, [1e30, 0.0], 0), (12, [1e14, 0.0], 0), (12, [-1e14, 1.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in v], "vec_id long, embedding array<double>, label int, score string")
    got = topk.top_k(df, F.col("id").isin(1, 9, 10, 12), k=2).collect()
    ten = [(r["rank"], r["vec_id"], int(r["score"])) for r in got if r["query_id"] == 10]
    assert sorted(ten) == [(1, 12, 128 * int(256e14)), (2, 1, 2 * 128 * 128)]  # ties go to the smaller id
    # rows of one id are candidates for each other, a row never for itself
    one = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 1)
    assert one == [(1, 12), (1, 12), (2, 1), (2, 1)]
    twelve = sorted((r["rank"], r["vec_id"], int(r["score"])) for r in got if r["query_id"] == 12)
    # the two rows of id 12 are far apart; of the others, the second one's best is 7
    assert twelve == [(1, 1, 128 * int(256e14)), (1, 7, 128 * int(256e14) + 256 * 64), (2, 1, -128 * int(256e14) + 256 * 128),
                      (2, 1, 128 * int(256e14))]
    assert not [r for r in got if r["query_id"] == 9]
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).collect() == []


def test_pipeline_stages(spark):
    for make in (edge_docs, empty_docs):
        docs = make(spark)
        for name, stage in P.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns, name
        assert all(r["round_trip"] for r in P.byte_bpe(spark, docs, "").collect())
