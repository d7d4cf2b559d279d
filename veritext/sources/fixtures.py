"""Small hand-written parameter tables used by tests and by the registered queries.

They are parameters, not data: every query that uses them reads a provided table (the reviews) and
its work grows with that table. The words are frequent function words of the invented fixture text,
so every rule fires. The same rows are written as VALUES in the SQL oracles
(``veritext.plans.sql_lexicon``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritext.schemas import local_table

# --- test lexicons (invented for the fixture text) -----------------------------------------------

LEXICON = [("the", 0.5), ("of", -0.25), ("and", 1.5), ("or", -2.0), ("with", 2.25), ("le", 1.0),
           ("der", -1.0), ("que", 0.75)]
NEGATIONS = ["in", "not", "no", "nicht", "pas"]
BOOSTERS = [("is", 0.293), ("that", 0.293), ("a", -0.293), ("es", 0.293)]
# "but" is the published contrast word; it never occurs in the fixture text, so "est" stands in too.
CONTRAST = ["but", "est"]
TAG_LEXICON = [("is", "VERB"), ("was", "VERB"), ("be", "VERB"), ("are", "VERB"), ("ist", "VERB"),
               ("est", "VERB"), ("not", "ADV"), ("no", "ADV"), ("nicht", "ADV"), ("pas", "ADV"),
               ("very", "ADV"), ("time", "NOUN")]
SUFFIX_RULES = [(1, "ement", "ADV"), (2, "ment", "NOUN"), (3, "tion", "NOUN"), (4, "ness", "NOUN"),
                (5, "ung", "NOUN"), (6, "heit", "NOUN"), (7, "ly", "ADV"), (8, "ing", "VERB"),
                (9, "ed", "VERB"), (10, "ieren", "VERB")]
# word vocabulary for token encoding: ids from 1000 up
VOCAB_TERMS = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "with",
               "be", "as", "by", "this", "are", "at", "from", "de", "la", "le", "les", "des", "et",
               "un", "une", "en", "que", "der", "die", "das", "und", "von", "zu", "den", "sich",
               "el", "los", "es", "y"]


def lexicon_df(spark: SparkSession, rows=None) -> DataFrame:
    return local_table(spark, rows or LEXICON, "term string, valence double")


def tag_lexicon_df(spark: SparkSession, rows=None) -> DataFrame:
    return local_table(spark, rows or TAG_LEXICON, "term string, tag string")


def suffix_rules_df(spark: SparkSession, rows=None) -> DataFrame:
    return local_table(spark, rows or SUFFIX_RULES, "priority int, suffix string, tag string")


def vocab_df(spark: SparkSession, terms=None) -> DataFrame:
    terms = terms or VOCAB_TERMS
    return local_table(spark, [(t, 1000 + i) for i, t in enumerate(terms)], "term string, id int")
