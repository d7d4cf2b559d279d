"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from veritext.llm import (bpe, classifier, hpylm, langid, lexical, lines, mixing, quality, simhash, substrings, topk,
                          urls, whitening)
from veritext.llm.common import table
from veritext.llm.sql import ORACLES  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/"))
QUALITY_CUT = 0.3


def op1_line_dedup(spark, sf_dir):
    """Recurring line templates dropped; lines dropped and a digest of what is left, per document."""
    kept = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("dropped_lines").cast("long").alias("dropped_lines"),
                       F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_quality_rules(spark, sf_dir):
    """Adaptive thresholds from quantile sketches per language and source."""
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def _remainder(parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op3_language_id(spark, sf_dir):
    """Mixture inference over all texts; learned from three of four documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(_remainder(4) != 2))
    held = docs.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "text")
    return langid.identify(held, model).select("doc_id", "held_out", "lang_pred", "score")


def op4_substring_dedup(spark, sf_dir):
    """Words in 13-word windows that an earlier document has, removed."""
    left = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_url_filters(spark, sf_dir):
    """Explicit rules, else the empirical-Bayes reputation of the host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, table(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "host_labelled", "host_bad",
                         F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_rate_low", 6).alias("bad_rate_low"))


def op6_mixing(spark, sf_dir):
    """Hash-threshold mix of all documents."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


def op7_byte_bpe(spark, sf_dir):
    """Encode and decode every text; digests of ids and bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, VOCABULARY)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_simhash(spark, sf_dir):
    """Fingerprints linked at 3 bits or fewer, and their components."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lm_scoring(spark, sf_dir):
    """Hierarchical Pitman-Yor model of four of five documents, scoring all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = hpylm.score(docs, _remainder(5) != 1)
    return scored.select("doc_id", F.coalesce(_remainder(5) == 1, F.lit(False)).alias("held_out"), "n_tokens",
                         "n_known", "train_tokens", "base_score", "score")


def op10_top_k(spark, sf_dir):
    """The 5 best inner products of every 50th vector against all others."""
    best = topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
    return best.withColumn("score", F.expr("try_cast(score AS BIGINT)"))


def op11_embedding_whitening(spark, sf_dir):
    """32 whitened components of every vector."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_quality_classifier(spark, sf_dir):
    """Quality of every text, learned from the labels of four of five documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = classifier.classify(docs, labels, _remainder(5) != 0)
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op13_lexical_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    found = lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_language_id, op4_substring_dedup,
                                    op5_url_filters, op6_mixing, op7_byte_bpe, op8_simhash, op9_lm_scoring,
                                    op10_top_k, op11_embedding_whitening, op12_quality_classifier, op13_lexical_search)}
