"""Scoring operators: the deterministic score table, per-model verdicts and the hybrid blend
(J5, M9, H15-H19, P11, T4, H17, P13, S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.constants import TEXT_WEIGHT, TREE_WEIGHT
from veritext.functions import scores as S
from veritext.operators.features import label_map


def score_table(features: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Closed-form stand-in for two trained models; both columns are p(OR = human), 6 places.

    Lets every metric and verdict operator be checked exactly against SQL without a model.
    """
    f = features if "y" in features.columns else label_map(features)
    z_text = ((F.col("word_count") % 17) - 8) / 4.0
    z_tree = 4.0 * F.col("punctuation_ct") / F.greatest(F.col("char_length"), F.lit(1)) - 0.1
    return f.select(
        "review_id", "label", "y", "char_length", "word_count", "punctuation_ct",
        F.round(S.sigmoid(z_tree), 6).alias("p_tree"),
        F.round(S.sigmoid(z_text), 6).alias("p_text"),
        z_text.alias("z_text"),
        z_tree.alias("z_tree"),
        *keep,
    )


def model_verdict(df: DataFrame, p_pos: str, prefix: str) -> DataFrame:
    """class = argmax of [p0, p1] (first on ties), confidence = its probability."""
    probs = S.pair_of(p_pos)
    cls = S.argmax(probs)
    return df.withColumns({
        f"label_{prefix}": S.display_label(cls),
        f"confidence_{prefix}": F.element_at(probs, cls + 1),
    })


def hybrid(df: DataFrame, p_tree: str = "p_tree", p_text: str = "p_text",
           w_tree: float = TREE_WEIGHT, w_text: float = TEXT_WEIGHT) -> DataFrame:
    """M9: both verdicts, oriented to p(AI), blended, thresholded and flagged. One projection."""
    v = model_verdict(model_verdict(df, p_tree, "tree"), p_text, "text")
    v = v.withColumn("final_score", S.blend(S.prob_ai("label_tree", "confidence_tree"),
                                            S.prob_ai("label_text", "confidence_text"),
                                            w_tree, w_text))
    v = v.withColumn("final_label", S.final_label("final_score"))
    v = v.withColumn("confidence", F.when(F.col("final_label") == "AI", F.col("final_score"))
                                    .otherwise(1.0 - F.col("final_score")))
    return v.withColumn("is_uncertain", S.is_uncertain("confidence"))


def join_model_scores(tree_scores: DataFrame, text_scores: DataFrame, key: str = "review_id") -> DataFrame:
    """J5 when the two models' scores live in separate tables: inner equi-join on the key."""
    return tree_scores.join(text_scores, key, "inner")
