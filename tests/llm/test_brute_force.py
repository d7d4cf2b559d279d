"""The operators against brute force, and the queries against their SQL."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.data import components, sha, simhash, without_repeats
from tests.oracle_harness import compare, duck
from veritext.llm import bpe, simhash as S, substrings, topk
from veritext.llm.queries import ORACLES, QUERIES
from veritext.llm.sql import WORDS, deduped, mixed, quality_measured


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_its_sql(spark, key):
    got = compare(spark, duck(SF_SMALL), key, QUERIES[key], ORACLES[key], SF_SMALL)
    assert got["status"] == "ok", got


ENCODING = None


def encoding():
    global ENCODING
    ENCODING = ENCODING or tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(P.VOCABULARY), special_tokens={})
    return ENCODING


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("a'stremvdlZ  \n\t\r\x0b\x1f1é!Ⅷ中　\xa0_-😀")), max_size=8))
def test_encoding_equals_the_library(texts):
    m = bpe.merger(P.VOCABULARY)
    assert [m.ids(p) for p in bpe.slices(texts)] == [encoding().encode_ordinary(t) for t in texts]


def test_every_code_point_is_classed_like_the_library():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}!" for c in points[i:i + 400]) for i in range(0, len(points), 400)]
    m = bpe.merger(P.VOCABULARY)
    assert [m.ids(p) for p in bpe.slices(texts)] == [encoding().encode_ordinary(t) for t in texts]


def test_long_slices_merge_like_short_ones():
    m = bpe.merger(P.VOCABULARY)
    for piece in ("ab" * 150, "the" * 90, "x" * 400, "é中" * 60):
        assert list(m.merge(piece.encode())) == encoding().encode_ordinary(piece)


def test_slices_of_a_batch_merge_together_like_alone():
    """One call merges all slices of a batch, also those that repeat, are long or come after the cache started anew."""
    m = bpe.Merger(P.VOCABULARY)
    pieces = [" abab", "", "é中", "zq" * 3, "ab" * 150, "\0", "zq" * 3, "the", "x" * 65, "qzqzj1", "😀😀", "x" * 65]
    want = [encoding().encode_ordinary(p) if p else [] for p in pieces]
    found, counts = m.merge_all([p.encode() for p in pieces])
    assert (found.tolist(), counts.tolist()) == ([i for w in want for i in w], [len(w) for w in want])
    for kept in (len(set(pieces)) - 2, 1):  # slices beyond 64 characters are not kept
        found, counts = m.batch_ids(pieces)
        assert (found.tolist(), counts.tolist()) == ([i for w in want for i in w], [len(w) for w in want])
        assert len(m.cache) == kept
        m.cache.update({str(i): 0 for i in range(bpe.CACHE_SLICES)})
        m.batch_ids(["a"])
        pieces, want = ["a"], [encoding().encode_ordinary("a")]
    assert [a.tolist() for a in m.batch_ids([])] == [[], []]


def test_bpe_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op7_byte_bpe"](spark, SF_SMALL).collect():
        ids = encoding().encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(",".join(map(str, ids))), sha(docs[r["doc_id"]]))


def test_simhash_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    fps = [simhash(t) for _, t in docs]
    want = {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, components(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash"](spark, SF_SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("node_max", [8, 64, 4096])
def test_links_lose_no_component(spark, node_max):
    """Clusters with chains, spread over and within nodes; small nodes force every level of refinement."""
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for centre in fps[:4]:
        for _ in range(120):
            fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 7 << b
        fps.append(chain)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, node_max)
    root = {r["node"]: r["root"] for r in S.components(edges).collect()}
    got, want = [root.get(f, f) for f in signed], components(fps)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_substrings_of_random_texts(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(40)]
    pool = [[rng.choice(vocab) for _ in range(60)] for _ in range(6)]
    texts = {}
    for i in range(60):
        w: list = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(pool)
            a = rng.randint(0, 50)
            w += p[a:a + rng.randint(1, 40)] + [rng.choice(vocab) for _ in range(rng.randint(0, 5))]
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(df).collect()}
    assert got == without_repeats(texts)


def test_automaton_against_search():
    rng = random.Random(5)
    for _ in range(40):
        passages = [[rng.choice("abc") for _ in range(rng.randint(3, 25))] for _ in range(6)]
        automaton = substrings.Automaton()
        for doc, p in enumerate(passages):
            first = automaton.first_docs(p, 3, doc)
            for s in range(len(p) - 2):
                own = next(d for d, q in enumerate(passages) if any(q[k:k + 3] == p[s:s + 3] for k in range(len(q) - 2)))
                assert first[s] == min(own, doc)
            automaton.add(p, doc)


def test_substring_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want = {i: (n, k, sha(t)) for i, (n, k, t) in without_repeats(docs).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in QUERIES["op4_substring_dedup"](spark, SF_SMALL).collect()}
    assert got == want


def test_top_k_with_small_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 8)) * rng.gamma(1.0, size=(300, 1)), 1)
    x[200:240] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("id") % 10 == 0, k=5, v_block=16, q_block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(x * 256).astype(np.int64)
    for i in range(0, 300, 10):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
        assert sorted(got[i]) == [(k + 1, int(j), int(s[j])) for k, j in enumerate(best)]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op3_language_id"](spark, SF_CHECK).filter("held_out").join(docs, "doc_id")
    hit = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert hit > 0.97


def test_language_shares_of_a_mixed_text(spark):
    from veritext.llm import langid

    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").filter("length(text) > 500")
    model = langid.fit(docs)
    en, de = (docs.filter(F.col("lang") == x).orderBy("doc_id").first()["text"][:500] for x in ("en", "de"))
    share = langid.mixtures([en, de, en + " " + de], model[1])
    i, j = model[0].index("en"), model[0].index("de")
    assert share[0, i] > 0.9 and share[1, j] > 0.9 and 0.3 < share[2, i] < 0.7 and 0.3 < share[2, j] < 0.7


def test_model_beats_its_base_on_held_out_texts(spark):
    r = QUERIES["op9_lm_scoring"](spark, SF_CHECK).filter("held_out").agg(
        (F.sum("score") / F.sum("n_tokens")).alias("model"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).first()
    assert r["model"] > r["base"] + 0.1


def test_base_score_is_its_formula(spark):
    """base_score, n_known and train_tokens of every document, from plain counts."""
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None]
            for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    learn = {i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1}
    count = Counter(w for i in learn for w in docs[i])
    n, v = sum(count.values()), len(count)
    for r in QUERIES["op9_lm_scoring"](spark, SF_SMALL).collect():
        words = docs[r["doc_id"]]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in count for w in words), n)
        assert r["held_out"] == (r["doc_id"] not in learn) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))


def plain_mixture(text, logs):
    """Shares by loops: EM from equal shares, then nested sets while the penalised likelihood rises."""
    from veritext.llm import langid as LI

    bucket, word, _ = LI.grams([text])
    ends = [*word[1:].tolist(), len(bucket)]
    rows = []
    for a, b in zip(word.tolist(), ends):
        score = [float(sum(np.float64(t[k]) for k in bucket[a:b])) for t in logs]
        rows.append([math.exp(max(s - max(score), -60.0)) for s in score])

    def em(share, rounds):
        for _ in range(rounds):
            parts = [[x * s for x, s in zip(r, share)] for r in rows]
            share = [sum(p[j] / sum(p) for p in parts) / len(rows) for j in range(len(share))]
        return share, sum(math.log(sum(x * s for x, s in zip(r, share))) for r in rows)

    n = len(logs)
    if not rows:
        return [0.0] * n
    share, _ = em([1 / n] * n, LI.ROUNDS)
    order = sorted(range(n), key=lambda j: (-share[j], j))
    best, chosen = -math.inf, [0.0] * n
    for size in range(1, n + 1):
        inside = [max(share[j], 1e-6) if j in order[:size] else 0.0 for j in range(n)]
        inside = [x / sum(inside) for x in inside]
        fitted, value = em(inside, LI.ROUNDS // 2 if size > 1 else 0)
        value -= LI.PENALTY * (size - 1) * math.log(len(rows) + 1)
        if value <= best:
            break
        best, chosen = value, fitted
    return chosen


def test_language_mixtures_equal_a_plain_version(spark):
    from veritext.llm import langid

    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").filter("length(text) > 700")
    langs, logs = langid.fit(docs)
    one = {x: docs.filter(F.col("lang") == x).orderBy("doc_id").first()["text"][:700] for x in langs}
    texts = [*one.values(), " ".join(one.values()), one[langs[0]] + " " + one[langs[-1]], "", "12 !!", "the", one[langs[1]][:40]]
    got = langid.mixtures(texts, logs)
    for t, share in zip(texts, got):
        assert np.allclose(share, plain_mixture(t, logs), atol=1e-6)
    assert len(langs) == 4 and (got[4] > 0.1).all()  # all four languages of the text that holds them


def test_offsets_cut_the_text_into_its_tokens(spark):
    ranks = {v: k for k, v in bpe.read_ranks(P.VOCABULARY).items()}
    docs = spark.createDataFrame([(1, "Hello wörld 😀 123\n\n don't"), (2, ""), (3, "日本語 " * 50)], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for r in bpe.encode(docs, P.VOCABULARY).collect():
        text, at = texts[r["doc_id"]], list(r["offsets"])
        ends = [*at[1:], len(text)]
        assert [text[a:b] for a, b in zip(at, ends)] == [ranks[i] for i in r["ids"]]


def test_mix_of_repeated_rows_meets_its_target(spark):
    """A third of a source is one row, another third one id with different texts."""
    from veritext.llm import mixing

    rows = [(7, "same words here", "a")] * 300 + [(8, f"some words {i}", "a") for i in range(300)] + [
        (None, f"other words {i}", "a") for i in range(300)] + [(i, "b words " * 3, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"),
                                               F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in got)
    assert mixing.mixed_rows(df).count() == mixing.mix(df).agg(F.sum("copies")).first()[0]


def test_pipeline_equals_a_plain_version(spark):
    con = duck(SF_CHECK)
    con.sql(f"""CREATE TABLE d1 AS WITH {quality_measured('documents')}
        SELECT d.* FROM quality_out q JOIN documents d USING (doc_id) WHERE kept""")
    con.sql(f"""CREATE TABLE d2 AS WITH {deduped('d1')}
        SELECT doc_id, text, lang, source, length(text)::BIGINT AS n_chars FROM dedup_out""")
    rows = con.sql("SELECT doc_id, text FROM d2 ORDER BY doc_id").fetchall()
    first = components([simhash(t) for _, t in rows])
    con.execute("CREATE TABLE keep (doc_id BIGINT)")
    con.executemany("INSERT INTO keep VALUES (?)", [(rows[i][0],) for i, c in enumerate(first) if i == c])
    con.sql("CREATE TABLE d3 AS SELECT d2.* FROM d2 JOIN keep USING (doc_id)")
    taken = con.sql(f"WITH {mixed('d3', f'len({WORDS.format(chr(116) + chr(101) + chr(120) + chr(116))})::BIGINT')} "
                    "SELECT doc_id, text, lang, source, copies FROM mix_out WHERE copies > 0").fetchall()
    want = Counter()
    for doc, text, lang, source, copies in taken:
        want[(doc, lang, source, tuple(encoding().encode_ordinary(text or "")), True)] += copies
    got = Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"]), r["round_trip"])
                  for r in P.run(spark, SF_CHECK).collect())
    assert got == want
