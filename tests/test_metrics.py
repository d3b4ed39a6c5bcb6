"""Metrics against published confusion matrices and scalars (goldens)."""

import pytest
from pyspark.sql import functions as F

from narrata.operators import errors as er
from narrata.operators import metrics as mt
from tests.golden_values import COMPARISON, METRICS

NAMES = ["baseline_product", "bilstm_attention_product", "distilbert_product"]


def _long(spark, name):
    m = METRICS[name]["matrix"]
    rows = [(name, t, p, n) for t, r in enumerate(m) for p, n in enumerate(r)]
    return spark.createDataFrame(rows, "model string, t int, p int, n long")


@pytest.mark.parametrize("name", list(METRICS))
def test_metrics_from_published_matrix(spark, name):
    got = mt.metrics_from_matrix(_long(spark, name)).first()
    for k in ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]:
        assert abs(got[k] - METRICS[name][k]) < 1e-12, (name, k)
    assert got["n"] == 16050


def test_metrics_from_prediction_rows_equal_matrix(spark):
    # expand one matrix into prediction rows and go through the row path
    df = _long(spark, "baseline_product").where("n > 0")
    rows = df.select(F.col("t").alias("y_true"), F.col("p").alias("y_pred"),
                     F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("_"))
    got = mt.classification_metrics(rows).first()
    assert abs(got["f1_macro"] - METRICS["baseline_product"]["f1_macro"]) < 1e-12
    cm = mt.confusion_matrix(rows)
    assert cm.count() == 81 and cm.agg(F.sum("n")).first()[0] == 16050


def test_comparison_table_rounding(spark):
    parts = [mt.metrics_from_matrix(_long(spark, n)) for n in NAMES]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = {r["model"]: r for r in df.collect()}
    for name, row in zip(NAMES, COMPARISON):
        g = got[name]
        vals = [g["accuracy"], g["precision_macro"], g["recall_macro"], g["f1_macro"], g["f1_weighted"]]
        assert [round(v, 4) for v in vals] == row


def test_zero_division_and_absent_class(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "y_true int, y_pred int")
    pc = {r["cls"]: r for r in mt.per_class(df).collect()}
    assert pc[0]["precision"] == 0.0 and pc[0]["recall"] == 0.0 and pc[0]["f1"] == 0.0
    assert abs(pc[1]["precision"] - 1 / 3) < 1e-15 and pc[1]["recall"] == 1.0


def test_error_type_edges(spark):
    # word counts 29/30/200/201 and confidence 0.5
    rows = [(i, 0, 1, c, " ".join(["w"] * n)) for i, (n, c) in
            enumerate([(29, 0.9), (30, 0.9), (200, 0.9), (201, 0.9), (100, 0.5), (100, 0.49)])]
    df = spark.createDataFrame(rows, "id long, y_true int, y_pred int, confidence double, text string")
    got = [r["error_type"] for r in er.collect_errors(df, ["a", "b"]).orderBy("index").collect()]
    assert got == ["short_text", "class_overlap", "class_overlap", "long_noisy",
                   "class_overlap", "low_confidence"]
