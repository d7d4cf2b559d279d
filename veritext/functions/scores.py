"""Probability and verdict expressions (H15-H20, T4, P11, P13). Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritext.constants import (AI_THRESHOLD, CLASS_DISPLAY, TEXT_WEIGHT, TREE_WEIGHT,
                                UNCERTAIN_BELOW)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(z) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(z)))


def softmax(logits) -> Column:
    """Max subtracted before ``exp`` for stability."""
    l = _col(logits)
    m = F.array_max(l)
    e = F.transform(l, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(probs) -> Column:
    """T4: 0-based index of the largest element, first on ties."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def pair_of(p_pos) -> Column:
    """``[p(class 0), p(class 1)]`` from the positive-class probability."""
    p = _col(p_pos)
    return F.array(1.0 - p, p)


def display_label(cls) -> Column:
    """0 -> AI, 1 -> Human."""
    return F.when(_col(cls) == 1, F.lit(CLASS_DISPLAY[1])).otherwise(F.lit(CLASS_DISPLAY[0]))


def prob_ai(label, confidence) -> Column:
    """Orient a (label, confidence) pair to the probability of AI."""
    return F.when(_col(label) == CLASS_DISPLAY[0], _col(confidence)).otherwise(1.0 - _col(confidence))


def blend(p_ai_tree, p_ai_text, w_tree: float = TREE_WEIGHT, w_text: float = TEXT_WEIGHT) -> Column:
    """H19."""
    return w_tree * _col(p_ai_tree) + w_text * _col(p_ai_text)


def final_label(score, threshold: float = AI_THRESHOLD) -> Column:
    """Score >= threshold -> AI."""
    return F.when(_col(score) >= threshold, F.lit(CLASS_DISPLAY[0])).otherwise(F.lit(CLASS_DISPLAY[1]))


def is_uncertain(confidence, below: float = UNCERTAIN_BELOW) -> Column:
    return _col(confidence) < below


def percent_text(c) -> Column:
    """Two places and a percent sign (agrees with Python's ``f'{c*100:.2f}%'``)."""
    return F.concat(F.format_number(_col(c) * 100.0, 2), F.lit("%"))
