"""The prepare stage as one lazy plan: clean -> row features -> lexicon features, per review.

Everything runs on the label-free reviews so the only shuffle is the lexicon aggregation (one small
row per review); labels and splits attach to the resulting scalar table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from veritext.operators import features as FE
from veritext.operators import lexicon as LX

REVIEW_SCALARS = ["category", "rating", "char_length", "word_count", "punctuation_ct", "is_extreme_star"]


def featurize(df: DataFrame, lexicon: DataFrame | None, tag_lexicon: DataFrame | None,
              negations=(), boosters=None, contrast=("but",), suffix_rules=(),
              keep_extra: list[str] = (), merged: DataFrame | None = None) -> DataFrame:
    """``review_id``, the six numeric features, ``category``, ``sentiment_score``, VERB, ADV, NOUN."""
    f = FE.text_features(df)
    keep = REVIEW_SCALARS + [c for c in keep_extra if c not in REVIEW_SCALARS]
    return LX.lexicon_scores(f, lexicon, negations, boosters, contrast, tag_lexicon, suffix_rules,
                             keep=keep, merged=merged)
