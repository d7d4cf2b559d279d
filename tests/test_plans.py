"""Plan shapes that matter at scale: no Python in text work, broadcast lexicon joins, pruned
scans, no full-table window without a partition key."""

from __future__ import annotations

import re

import pytest

from tests.conftest import SF_CHECK
from veritext.plans import all_queries as A


def plan(spark, key):
    return A.QUERIES[key](spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()


def test_text_features_stay_in_the_jvm(spark):
    p = plan(spark, "text_features")
    assert "Python" not in p and "ArrowEval" not in p


def test_lexicon_join_is_broadcast_and_aggregation_is_partial(spark):
    p = plan(spark, "sentiment")
    assert "BroadcastHashJoin" in p
    assert "partial_sum" in p or "HashAggregate" in p


def test_numeric_block_prunes_columns(spark):
    p = plan(spark, "numeric_block")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all("n_chars" not in s and "lang" not in s and "source" not in s for s in schemas)


def test_label_filter_reaches_the_scan(spark):
    p = plan(spark, "split_stratified")
    assert "PushedFilters" in p


def moved_columns(spark, key):
    """Columns above an exchange when nothing may be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = A.QUERIES[key](spark, SF_CHECK)._jdf.queryExecution().executedPlan()
        text = p.toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out, lines = [], text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange" in line and i + 1 < len(lines):
            out.append(lines[i + 1])
    return out


@pytest.mark.parametrize("key", ["split_exact", "null_counts"])
def test_no_text_is_shuffled(spark, key):
    below = moved_columns(spark, key)
    below = [re.sub(r"isnotnull\(text#\d+\)", "", x) for x in below]  # a flag may move
    assert not [x for x in below if re.search(r"\btext\b|cleaned_text", x)], below


def test_exact_split_moves_no_rows(spark):
    assert "Exchange" not in plan(spark, "split_exact")


def test_auc_windows_are_partitioned_by_bin(spark):
    p = plan(spark, "roc_auc")
    assert re.search(r"Window \[.*\], \[[^\]]*_bin", p)
