"""DuckDB SQL building blocks for the oracles: the stand-in views and the text expressions.

These mirror ``veritext.sources.tables`` and ``veritext.functions.text`` expression by expression;
they are written once here and composed into each oracle as common table expressions.
"""

from __future__ import annotations

from veritext.constants import PUNCTUATION, WS_CLASS_RE2 as WS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PUNCT_SQL = _q(PUNCTUATION)
_PUNCT_CLASS = "".join("\\" + c if c in "\\[]^-" else c for c in PUNCTUATION)


def clean_sql(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    no_tags = f"regexp_replace({low}, '<.*?>', '', 'g')"
    no_links = f"regexp_replace({no_tags}, '(?:http|www)[^{WS}]+', '', 'g')"
    return f"regexp_replace({no_links}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def char_length_sql(x: str) -> str:
    return f"CAST(length({x}) AS BIGINT)"


def word_count_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{WS}]+')) AS BIGINT)"


def punct_sql(x: str) -> str:
    return f"CAST(length({x}) - length(translate({x}, {PUNCT_SQL}, '')) AS BIGINT)"


def extreme_sql(r: str) -> str:
    return f"coalesce({r} IN (1.0, 5.0), false)"


def tokens_sql(x: str) -> str:
    pattern = _q(f"^[{_PUNCT_CLASS}]+|[{_PUNCT_CLASS}]+\\z")
    strip = f"regexp_replace(w, {pattern}, '', 'g')"
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '[{WS}]+'), lambda w: {strip}), "
            f"lambda w: w <> '')")


def label_sql(q: str) -> str:
    return f"CASE {q} WHEN 1 THEN 'OR' WHEN 0 THEN 'CG' END"


VIEWS = {
    "reviews_docs": f"""reviews_docs AS (
  SELECT d.doc_id AS review_id, d.source AS category, CAST(d.doc_id % 5 + 1 AS DOUBLE) AS rating,
         {label_sql('l.quality')} AS label, d.text AS text_
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "reviews_chat": """reviews_chat AS (
  SELECT conv_id * 4294967296 + turn AS review_id, 'chat' AS category,
         CAST(turn % 5 + 1 AS DOUBLE) AS rating,
         CASE role WHEN 'user' THEN 'OR' WHEN 'assistant' THEN 'CG' END AS label, text AS text_
  FROM conversations)""",
    "reviews_pages": """reviews_pages AS (
  SELECT page_id AS review_id, 'unknown' AS category, CAST(NULL AS DOUBLE) AS rating,
         CAST(NULL AS VARCHAR) AS label, html || ' ' || url AS text_
  FROM pages)""",
    "features_chat": f"""features_chat AS (
  SELECT review_id, category, rating, label, cleaned_text,
         {char_length_sql('cleaned_text')} AS char_length,
         {word_count_sql('cleaned_text')} AS word_count,
         {punct_sql('cleaned_text')} AS punctuation_ct,
         {extreme_sql('rating')} AS is_extreme_star
  FROM (SELECT *, {clean_sql('text_')} AS cleaned_text FROM reviews_chat))""",
    "features_docs": f"""features_docs AS (
  SELECT review_id, category, rating, label, cleaned_text,
         {char_length_sql('cleaned_text')} AS char_length,
         {word_count_sql('cleaned_text')} AS word_count,
         {punct_sql('cleaned_text')} AS punctuation_ct,
         {extreme_sql('rating')} AS is_extreme_star,
         CASE label WHEN 'OR' THEN 1 WHEN 'CG' THEN 0 END AS y
  FROM (SELECT *, {clean_sql('text_')} AS cleaned_text FROM reviews_docs))""",
    # closed-form scores of the key index: p(OR) of a 'tree' and a 'text' model, 6 places
    "score_table": """score_table AS (
  SELECT review_id, label, y, char_length, word_count, punctuation_ct,
         round(1.0 / (1.0 + exp(-(4.0 * punctuation_ct / greatest(char_length, 1) - 0.1))), 6) AS p_tree,
         round(1.0 / (1.0 + exp(-(((word_count % 17) - 8) / 4.0))), 6) AS p_text,
         ((word_count % 17) - 8) / 4.0 AS z_text,
         4.0 * punctuation_ct / greatest(char_length, 1) - 0.1 AS z_tree
  FROM features_docs)""",
}

# views each view needs first
_DEPS = {"features_docs": ["reviews_docs"], "features_chat": ["reviews_chat"],
         "score_table": ["features_docs"]}


def with_views(*names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(VIEWS[n] for n in order) + "\n"
