"""Text column expressions (clean-up, counts, tokens). All JVM-side.

Semantics follow Python's ``str`` methods: ``lower``, ``re.sub`` with ``.`` stopping only at
``\\n``, ``\\S`` and ``strip`` over Python's 29 white-space characters, ``len`` in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritext.constants import PUNCTUATION, WS_CLASS, WS_CODE_POINTS

LINK_PATTERN = rf"(?:http|www)[^{WS_CLASS}]+"
# A run of WS_CLASS, written for Java: characters below 256 one by one (one lookup in a bit set), the others behind
# one range, so that most characters cost two tests and not one for each part of the class.
WS_RUN_PATTERN = ("[" + "".join(rf"\x{cp:02x}" for cp in WS_CODE_POINTS if cp < 256)
                  + r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+")
PUNCTUATION_RUN_PATTERN = "[" + "".join(rf"\x{ord(c):02x}" for c in PUNCTUATION) + "]+"
_WS, _P = WS_RUN_PATTERN[1:-2], PUNCTUATION_RUN_PATTERN[1:-2]
BETWEEN_TOKENS_PATTERN = rf"(?<![{_P}{_WS}])[{_P}]*+[{_WS}][{_P}{_WS}]*+"


WS_CHARS = "".join(chr(cp) for cp in WS_CODE_POINTS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_text(c) -> Column:
    """H1."""
    return F.lower(_col(c))


# Each clean-up regex runs only on rows where it can change something; the guards are cheap tests
# on Spark's native strings, the regexes convert and scan the whole text.

def remove_tags(c) -> Column:
    """H2: shortest ``<...>`` with no newline inside.

    Line by line, and only up to a line's last ``>``: there every ``<`` has its end, so the regex never looks
    for one in vain and the work stays linear, whatever the number of open brackets.
    """
    def without(line: Column) -> Column:
        rest = F.substring_index(line, ">", -1)
        head = F.left(line, F.length(line) - F.length(rest))
        return F.concat(F.regexp_replace(head, "<[^>]*>", ""), rest)

    t = _col(c)
    return F.when(t.contains("<") & t.contains(">"),
                  F.array_join(F.transform(F.split(t, "\n"), without), "\n")).otherwise(t)


def remove_links(c) -> Column:
    """H3: ``http``/``www`` plus at least one non-space character, anywhere in a word."""
    t = _col(c)
    return F.when(t.contains("http") | t.contains("www"),
                  F.regexp_replace(t, LINK_PATTERN, "")).otherwise(t)


def strip_ws(c) -> Column:
    """H4: Python ``str.strip()``."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def clean_text(c) -> Column:
    """H1-H4 in the reference's order. Null text is treated as ''."""
    return strip_ws(remove_links(remove_tags(lower_text(F.coalesce(_col(c), F.lit(""))))))


def char_length(c) -> Column:
    """H5: code points, as BIGINT."""
    return F.length(_col(c)).cast("bigint")


def word_count(c, pieces: Column | None = None) -> Column:
    """H6: ``len(text.split())``: non-empty pieces between white-space runs (a split is about four
    times cheaper than counting regex matches). ``pieces``: the text's ``ws_pieces``, where they exist."""
    return F.size(words(c) if pieces is None else F.array_remove(pieces, "")).cast("bigint")


def punctuation_count(c) -> Column:
    """H7: characters in Python's ``string.punctuation``."""
    t = _col(c)
    return (F.length(t) - F.length(F.regexp_replace(t, PUNCTUATION_RUN_PATTERN, ""))).cast("bigint")


def is_extreme_star(rating) -> Column:
    """Rating in {1, 5}; a null rating is False (as pandas ``isin``)."""
    return F.coalesce(_col(rating).isin(1.0, 5.0), F.lit(False))


def ws_pieces(c) -> Column:
    """What lies between white-space runs; the first and last piece may be empty."""
    return F.split(_col(c), WS_RUN_PATTERN)


def words(c) -> Column:
    """White-space split (``str.split()``) as ARRAY<STRING>, no empty elements."""
    return F.array_remove(ws_pieces(c), "")


def tokens(c, pieces: Column | None = None) -> Column:
    """H9: white-space words with leading and trailing ASCII punctuation removed; empties dropped.

    One split, at runs of white space and punctuation that hold white space. A run is tried from its start only, so
    rulers, tables and long runs of hyphens cost what other text costs. ``pieces``: the text's ``ws_pieces``, to be
    trimmed one by one instead.
    """
    if pieces is not None:
        return F.array_remove(F.transform(pieces, lambda w: F.btrim(w, F.lit(PUNCTUATION))), "")
    return F.array_remove(F.split(F.btrim(_col(c), F.lit(PUNCTUATION + WS_CHARS)), BETWEEN_TOKENS_PATTERN), "")
