"""Spark-vs-DuckDB comparison, the same shape as the driver's gate: column names (sorted), row
count and an order-insensitive hash of the values. Usable from pytest and from the command line:

    python tests/oracle_harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
from decimal import Decimal

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

STRICT = os.environ.get("ORACLE_STRICT") == "1"  # compare floats bit for bit

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, (float, Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        if STRICT:
            return f
        r = round(f, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in sorted(v.items())}
    return v


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr([_norm(r[i]) for i in order]) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = list(sdf.columns)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"key": key, "spark_sec": round(t1 - t0, 2), "rows": len(s_rows)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con.sql(f"CREATE OR REPLACE VIEW oracle_view AS {sql}")  # the driver compares views
    rel = con.sql("SELECT * FROM oracle_view")
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return res
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    if len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT"
    elif hs != hd:
        diff_s = sorted(set(ls) - set(ld))[:3]
        diff_d = sorted(set(ld) - set(ls))[:3]
        res["status"] = "VALUES"
        res["spark_only"] = [x[:300] for x in diff_s]
        res["duck_only"] = [x[:300] for x in diff_d]
    else:
        res["status"] = "ok"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from veritext.session import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for k in (keys or list(qs)):
        try:
            r = compare(spark, con, k, qs[k], orc.get(k), sf_dir)
        except Exception as e:  # report and go on
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys or qs) - bad} good, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
