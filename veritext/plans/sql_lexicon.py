"""DuckDB oracle for the lexicon jobs: the same rules written as plain token-row SQL."""

from __future__ import annotations

from veritext.constants import (BOOSTER_DAMPING, CONTRAST_AFTER, CONTRAST_BEFORE,
                                EXCLAMATION_INCREMENT, EXCLAMATION_MAX, NEGATION_SCALAR,
                                NORMALIZATION_ALPHA)
from veritext.plans.sql import _q, tokens_sql
from veritext.sources import fixtures as FX


def _d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _in_list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def lexicon_ctes(src: str = "features_docs", text: str = "cleaned_text") -> str:
    """CTEs ``lex``, ``tok``, ``trow``, ``tscore`` and ``lexagg`` over ``src``."""
    lex_rows = ", ".join(f"({_q(t)}, {_d(v)})" for t, v in FX.LEXICON)
    tag_rows = ", ".join(f"({_q(t)}, {_q(g)})" for t, g in FX.TAG_LEXICON)
    negs = _in_list(FX.NEGATIONS)
    contrast = _in_list(FX.CONTRAST)

    def boost(p: str) -> str:
        whens = " ".join(f"WHEN {_q(t)} THEN {_d(v)}" for t, v in FX.BOOSTERS)
        return f"coalesce(CASE {p} {whens} END, {_d(0.0)})"

    def neg(p: str) -> str:
        return f"coalesce({p} IN {negs}, false)"

    suffix = "CASE " + " ".join(
        f"WHEN ends_with(r.term, {_q(s)}) THEN {_q(g)}" for _, s, g in sorted(FX.SUFFIX_RULES)) + " END"
    d1, d2, d3 = (_d(x) for x in BOOSTER_DAMPING)
    return f""", lex AS (
  SELECT coalesce(a.term, b.term) AS term, a.valence, b.tag
  FROM (VALUES {lex_rows}) a(term, valence) FULL OUTER JOIN (VALUES {tag_rows}) b(term, tag)
  ON a.term = b.term),
tok AS (
  SELECT review_id, t, n_excl,
         coalesce(list_position(list_transform(t, lambda x: x IN {contrast}), true), 0) AS contrast_pos
  FROM (SELECT review_id, {tokens_sql(text)} AS t,
               length({text}) - length(replace({text}, '!', '')) AS n_excl FROM {src})),
trow AS (
  SELECT review_id, n_excl, contrast_pos, pos, t[pos] AS term,
         CASE WHEN pos > 1 THEN t[pos - 1] END AS p1,
         CASE WHEN pos > 2 THEN t[pos - 2] END AS p2,
         CASE WHEN pos > 3 THEN t[pos - 3] END AS p3
  FROM tok, unnest(generate_series(1, len(t))) AS g(pos)),
tscore AS (
  SELECT r.review_id, r.n_excl, r.pos, r.contrast_pos, l.valence,
         ({neg('p1')} OR {neg('p2')} OR {neg('p3')}) AS negated,
         {boost('p1')} * {d1} + {boost('p2')} * {d2} + {boost('p3')} * {d3} AS boost,
         coalesce(l.tag, {suffix}) AS tag
  FROM trow r LEFT JOIN lex l ON r.term = l.term),
tval AS (
  SELECT *, CASE WHEN contrast_pos > 0 AND pos < contrast_pos THEN v2 * {_d(CONTRAST_BEFORE)}
                 WHEN contrast_pos > 0 AND pos > contrast_pos THEN v2 * {_d(CONTRAST_AFTER)}
                 ELSE v2 END AS v
  FROM (SELECT *, CASE WHEN negated THEN v1 * {_d(NEGATION_SCALAR)} ELSE v1 END AS v2
        FROM (SELECT *, valence + CASE WHEN valence < 0 THEN -boost ELSE boost END AS v1
              FROM tscore))),
lexagg0 AS (
  SELECT review_id, any_value(n_excl) AS n_excl, sum(v) AS s, count(valence) AS hits,
         CAST(count_if(tag = 'VERB') AS BIGINT) AS "VERB",
         CAST(count_if(tag = 'ADV') AS BIGINT) AS "ADV",
         CAST(count_if(tag = 'NOUN') AS BIGINT) AS "NOUN"
  FROM tval GROUP BY review_id),
lexagg AS (
  SELECT f.review_id,
         CASE WHEN coalesce(a.hits, 0) = 0 THEN {_d(0.0)}
              ELSE round(greatest(-1.0, least(1.0, s2 / sqrt(s2 * s2 + {_d(NORMALIZATION_ALPHA)}))), 4)
         END AS sentiment_score,
         coalesce(a."VERB", 0) AS "VERB", coalesce(a."ADV", 0) AS "ADV", coalesce(a."NOUN", 0) AS "NOUN"
  FROM {src} f LEFT JOIN (
    SELECT *, CASE WHEN s > 0 THEN s + least(n_excl, {EXCLAMATION_MAX}) * {_d(EXCLAMATION_INCREMENT)}
                   WHEN s < 0 THEN s - least(n_excl, {EXCLAMATION_MAX}) * {_d(EXCLAMATION_INCREMENT)}
                   ELSE s END AS s2
    FROM lexagg0) a ON f.review_id = a.review_id)
"""


def full_features_prefix() -> str:
    """WITH ... up to ``full_features``: every review-level feature plus label and ``y``."""
    from veritext.plans.sql import with_views
    return (with_views("features_docs") + lexicon_ctes()
            + """, full_features AS (
  SELECT f.*, a.sentiment_score, a."VERB", a."ADV", a."NOUN"
  FROM features_docs f JOIN lexagg a USING (review_id))
""")
