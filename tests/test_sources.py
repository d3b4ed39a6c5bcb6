"""Sources: CSV landing round trip, typed date pushdown, API pages, masked softmax."""

import math
import re
import tempfile

from pyspark.sql import functions as F

from narrata.operators.filters import filter_date_cutoff
from narrata.operators.pooling import argmax, softmax
from narrata.sources import complaints as src
from narrata.sources.fixtures import complaints


def test_csv_landing_round_trip(spark):
    base = tempfile.mkdtemp(prefix="narrata-test-", dir="/tmp")
    raw = complaints(spark, "/root/testdata/sf0.001")
    src.write_complaints_csv(raw, f"{base}/csv")
    back = src.read_complaints_csv(spark, f"{base}/csv")
    assert back.columns == src.COMPLAINT_COLUMNS
    # whitespace-only narratives are kept as written (not trimmed away)
    a = raw.select("complaint_id", "narrative", "product").where("narrative IS NOT NULL")
    b = back.select("complaint_id", "narrative", "product").where("narrative IS NOT NULL")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_missing_columns_become_nulls(spark):
    df = spark.createDataFrame([(1, "x")], "complaint_id long, narrative string")
    out = src.project_columns(df)
    assert out.columns == src.COMPLAINT_COLUMNS and out.first()["issue"] is None


def test_typed_date_cutoff_is_pushed(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = filter_date_cutoff(o, "1997-01-01", "o_orderdate")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert df.count() == o.where("o_orderdate >= '1997-01-01'").count()


def test_api_pages_flatten(spark):
    pages = [
        '{"hits": {"hits": [{"_source": {"complaint_id": "1", "date_received": "2024-01-02T12:00:00",'
        ' "issue": "Fraud or scam", "complaint_what_happened": "some words here"}}]}}',
        '{"hits": {"hits": [{"_source": {"complaint_id": "2", "complaint_what_happened": "   "}}]}}',
        '{"hits": {"hits": []}}',
    ]
    df = spark.createDataFrame([(p,) for p in pages], "body string")
    rows = src.api_pages_flatten(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["date_received"] == "2024-01-02" and r["sub_issue"] == "" and r["product"] == "Credit reporting"


def test_masked_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [True, True, False])], "x array<double>, m array<boolean>")
    r = df.select(softmax("x", "m").alias("p")).select("p", argmax("p").alias("a")).first()
    e1, e2 = math.exp(1.0 - 2.0), 1.0
    assert abs(r["p"][0] - e1 / (e1 + e2)) < 1e-12 and r["p"][2] < 1e-300 and r["a"] == 1
    assert abs(sum(r["p"]) - 1.0) < 1e-12
