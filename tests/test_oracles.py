"""Every query with an SQL oracle equals DuckDB at sf0.01 (columns, row count, value hash)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF_CHECK
from tests.oracle_harness import compare

ORACLE_KEYS = sorted(E.oracle_sql())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_query_equals_oracle(spark, duck_check, key):
    r = compare(spark, duck_check, key, E.queries()[key], E.oracle_sql()[key], SF_CHECK)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["accuracy", "precision", "recall", "f1", "n"] and rows[0]["n"] > 0
