"""Operator outline of a physical plan (operators and keys, expressions elided), for plan reviews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_KEEP = re.compile(r"^(\s*[:+\- ]*)(\*\(\d+\) )?([A-Za-z]+)(.*)$")


def outline(df: DataFrame, width: int = 110) -> str:
    """One line per operator of the executed plan; long arguments cut to ``width`` characters."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        m = _KEEP.match(line)
        if not m:
            continue
        indent, codegen, op, rest = m.groups()
        rest = re.sub(r"#\d+L?", "", rest)
        if op in ("Exchange", "BroadcastExchange", "HashAggregate", "Window", "FileScan", "Generate",
                  "BroadcastHashJoin", "SortMergeJoin", "InMemoryTableScan", "TakeOrderedAndProject"):
            text = f"{indent}{op}{rest}"
        else:
            text = f"{indent}{op}"
        out.append(text[:width])
    return "\n".join(out)
