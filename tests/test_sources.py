"""Sources and sinks: charset behaviour, partitioned parquet sink with pruning, JSON contract."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF_CHECK
from veritext.plans import all_queries as A
from veritext.session import scratch_path
from veritext.sources import files as FL
from veritext.sources import tables as TB


def test_latin1_read_garbles_like_python(spark):
    got = {r["review_id"]: r["text_"] for r in A.QUERIES["csv_charset"](spark, SF_CHECK).collect()}
    want = {r["review_id"]: r["text_"] for r in TB.reviews_chat(spark, SF_CHECK).select("review_id", "text_").collect()}
    assert set(got) == set(want)
    changed = 0
    for k, text in want.items():
        assert got[k] == text.encode("utf-8").decode("latin-1")
        changed += got[k] != text
    assert changed > 0  # the fixture has non-ASCII letters


def test_csv_roundtrip_keeps_multiline_text(spark):
    df = spark.createDataFrame([(1, 'line one\nline "two", three\r\n'), (2, ""), (3, None)],
                               "review_id long, t string")
    path = FL.write_csv(df, scratch_path(spark, "csv-test"))
    back = {r["review_id"]: r["t"] for r in FL.read_csv(spark, path, df.schema).collect()}
    assert back[1] == 'line one\nline "two", three\r\n' and back[3] is None


def test_partitioned_sink_prunes_partitions(spark):
    docs = TB.documents_unlabelled(spark, SF_CHECK).select("review_id", "category", "rating")
    path = FL.write_reviews(docs, scratch_path(spark, "reviews-parquet"))
    one = spark.read.parquet(path).filter(F.col("category") == "src3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan and "src3" in plan
    assert one.count() == docs.filter(F.col("category") == "src3").count()


def test_contract_roundtrip_keeps_order(spark):
    rows = A.QUERIES["contract_roundtrip"](spark, SF_CHECK).collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    assert rows[0]["name"] == "rating" and rows[-1]["name"].startswith("category_")


def test_run_metrics_appends_json_rows(spark):
    r = A.QUERIES["run_metrics"](spark, SF_CHECK).collect()
    assert len(r) == 1 and 0.0 <= r[0]["test_auc_score"] <= 1.0
    assert r[0]["training_samples"] + r[0]["test_samples"] > 0
