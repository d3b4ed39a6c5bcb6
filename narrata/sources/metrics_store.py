"""Metrics documents: one JSON row per model (scalars, per-class F1 map,
dense confusion matrix), written and read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.operators import metrics as mt
from narrata.session import cut_lineage, scratch_path

METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision_macro", T.DoubleType()),
    T.StructField("recall_macro", T.DoubleType()),
    T.StructField("f1_macro", T.DoubleType()),
    T.StructField("f1_weighted", T.DoubleType()),
    T.StructField("per_class_f1", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
])


def metrics_documents(pred: DataFrame, names: list[str], model: str = "model") -> DataFrame:
    """One document per model, all of it from one pass over the predictions:
    their (true, predicted) counts are written once and read by every part."""
    pred = cut_lineage(mt.confusion_counts(pred, model=model), "confusion")
    pc = mt.with_names(mt.per_class(pred, model=model), names)
    summary = mt.summarize(pc, model)
    f1map = pc.groupBy(model).agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("label", "f1")))).alias("per_class_f1"))
    cm = mt.matrix_rows(mt.confusion_matrix(pred, model=model), model)
    return (summary.join(f1map, model).join(cm, model)
            .select(*[f.name for f in METRICS_SCHEMA.fields]))


def write_metrics(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def document_values(docs: DataFrame) -> DataFrame:
    """(model, part, row, col, value): the values of the per-class map (part "f1", row the
    label) and of the matrix (part "confusion", row and column the class positions)."""
    f1 = docs.select("model", F.lit("f1").alias("part"), F.explode("per_class_f1").alias("row", "value"))
    f1 = f1.select("model", "part", "row", F.lit(None).cast("int").alias("col"), F.round("value", 6).alias("value"))
    cells = docs.select("model", F.posexplode("confusion_matrix").alias("row", "cells"))
    cells = cells.select("model", F.lit("confusion").alias("part"), F.col("row").cast("string").alias("row"),
                         F.posexplode("cells").alias("col", "value"))
    return f1.unionByName(cells.withColumn("value", F.col("value").cast("double")))


def write_comparison_csv(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_comparison_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "model string, accuracy double, precision_macro double, recall_macro double, " \
             "f1_macro double, f1_weighted double"
    return spark.read.option("header", True).schema(schema).csv(path)


def metrics_roundtrip(pred: DataFrame, names: list[str]) -> DataFrame:
    spark = pred.sparkSession
    path = scratch_path(spark, "metrics")
    write_metrics(metrics_documents(pred, names), path)
    back = read_metrics(spark, path)
    return back.select("model", F.round("accuracy", 6).alias("accuracy"),
                       F.round("f1_macro", 6).alias("f1_macro"),
                       F.size("per_class_f1").alias("n_classes"),
                       F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("bigint"),
                                   lambda a, x: a + x).alias("cm_total"))
