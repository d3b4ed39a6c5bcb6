"""A refresh of one class leaves every other class's files as they are."""

import hashlib
import os

import pytest

from narrata.sources.class_table import ClassTable

SCHEMA = "complaint_id long, product string, issue_group string, priority string, narrative string"


def _rows(spark, product, ids, group="g"):
    return [(i, product, f"{group}{i % 3}", "Low", f"text {i}") for i in ids]


def _files(folder):
    out = {}
    for d, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                p = os.path.join(d, n)
                out[os.path.relpath(p, folder)] = hashlib.md5(open(p, "rb").read()).hexdigest()
    return out


def test_only_one_class_is_rewritten(spark, tmp_path):
    rows = _rows(spark, "007", range(8)) + _rows(spark, "a/b=c", range(10, 40)) + [(99, None, "g0", "Low", "x")]
    t = ClassTable(spark, str(tmp_path), 20, 12, 1)
    t.write(spark.createDataFrame(rows, SCHEMA))
    assert {r[0]: r[1] for r in t.read().groupBy("product").count().collect()} == {"007": 12, "a/b=c": 20}
    before = _files(tmp_path)
    new = spark.createDataFrame(_rows(spark, "007", range(100, 150), "h") + _rows(spark, "other", range(5)), SCHEMA)
    t.replace("007", new)
    after = _files(tmp_path)
    kept = {p: h for p, h in before.items() if "007" not in p}
    assert kept and all(after[p] == h for p, h in kept.items())
    assert {p for p in after if "007" not in p} == set(kept)
    got = t.read().collect()
    assert {r["complaint_id"] for r in got if r["product"] == "007"} <= set(range(100, 150))
    assert {r["product"]: r["product_encoded"] for r in got} == {"007": 0, "a/b=c": 1}
    assert {r["issue_group"]: r["issue_group_encoded"] for r in got} == {
        g: i for i, g in enumerate(["g0", "g1", "g2", "h0", "h1", "h2"])}
    assert sum(r["n"] for r in t.histogram().collect()) == 40
    one = t.read("007")
    assert {r["product"] for r in one.collect()} == {"007"}
    assert "PartitionFilters: [isnotnull(_class" in one._jdf.queryExecution().executedPlan().toString()


def test_an_empty_batch_leaves_the_class(spark, tmp_path):
    t = ClassTable(spark, str(tmp_path), 20, 5, 1)
    t.write(spark.createDataFrame(_rows(spark, "a", range(9)), SCHEMA))
    before = _files(tmp_path)
    with pytest.raises(ValueError):
        t.replace("a", spark.createDataFrame([], SCHEMA))
    assert _files(tmp_path) == before
