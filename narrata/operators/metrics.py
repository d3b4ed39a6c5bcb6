"""Classification metrics from a prediction table (any size).

The only pass over the predictions is ``groupBy(model, t, p).count()`` — a
partial aggregation whose output has at most models x C x C rows. Every
metric (accuracy, per-class precision/recall/F1, macro and weighted means,
reports, comparison tables) is derived from that small table.

Conventions (scikit-learn with ``zero_division=0``): the class set is the
union of observed true and predicted codes; P = tp/predicted, R =
tp/support, F1 = 2 tp / (support + predicted), 0 where a denominator is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(model: str | None):
    return [model] if model else []


def confusion_counts(pred: DataFrame, t: str = "y_true", p: str = "y_pred",
                     model: str | None = None) -> DataFrame:
    """(model?, t, p, n): at most C x C rows a model. Rows ``(t, p, n)`` given as
    ``pred`` are such counts already and are returned as they are."""
    if {"t", "p", "n"} <= set(pred.columns):
        return pred.select(*_by(model), "t", "p", "n")
    return pred.groupBy(*_by(model), F.col(t).alias("t"), F.col(p).alias("p")) \
               .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, t: str = "y_true", p: str = "y_pred",
                     model: str | None = None) -> DataFrame:
    """Dense long matrix (model?, t, p, n) over the class set, zeros filled.

    One aggregation pass: the (t, p) counts of a model (at most C x C
    entries) are gathered into one array, and the grid over the sorted
    class set is generated from it by explode and a map lookup; no join of
    the class table with itself and no second scan of the predictions."""
    by = _by(model)
    counts = confusion_counts(pred, t, p, model)
    per = counts.groupBy(*by).agg(F.collect_list(F.struct("t", "p", "n")).alias("_l"))
    cls = F.array_sort(F.array_distinct(F.concat(F.transform("_l", lambda x: x["t"]),
                                                 F.transform("_l", lambda x: x["p"]))))
    lut = F.map_from_entries(F.transform("_l", lambda x: F.struct(
        F.concat_ws(",", x["t"].cast("string"), x["p"].cast("string")), x["n"])))
    grid = (per.select(*by, cls.alias("_c"), lut.alias("_m"))
               .select(*by, "_m", "_c", F.explode("_c").alias("t"))
               .select(*by, "_m", "t", F.explode("_c").alias("p")))
    key = F.concat_ws(",", F.col("t").cast("string"), F.col("p").cast("string"))
    return grid.select(*by, "t", "p",
                       F.coalesce(F.try_element_at("_m", key), F.lit(0)).cast("bigint").alias("n"))


def confusion_normalized(cm: DataFrame, model: str | None = None) -> DataFrame:
    """Row-normalised matrix: n / support of the true class (null if 0)."""
    w = Window.partitionBy(*_by(model), "t")
    return cm.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(w), F.lit(0)))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(pred: DataFrame, t: str = "y_true", p: str = "y_pred",
                model: str | None = None) -> DataFrame:
    """(model?, cls, tp, support, predicted, precision, recall, f1).

    One scan: predictions are counted by (true, predicted) class with partial
    aggregation; each count then adds to its true and its predicted class."""
    by = _by(model)
    zero = F.lit(0).cast("bigint")

    def rec(cls, sup, prd, tp):
        return F.struct(cls.cast("int").alias("cls"), sup.alias("s"), prd.alias("q"), tp.alias("tp"))
    n = F.col("n")
    e = confusion_counts(pred, t, p, model).select(*by, F.explode(F.array(
        rec(F.col("t"), n, zero, F.when(F.col("t") == F.col("p"), n).otherwise(zero)),
        rec(F.col("p"), zero, n, zero))).alias("e"))
    j = e.groupBy(*by, F.col("e.cls").alias("cls")).agg(
        F.sum("e.tp").alias("tp"), F.sum("e.s").alias("support"), F.sum("e.q").alias("predicted"))
    return j.select(*by, F.col("cls").cast("int").alias("cls"),
                    F.col("tp").cast("bigint").alias("tp"),
                    F.col("support").cast("bigint").alias("support"),
                    F.col("predicted").cast("bigint").alias("predicted"),
                    _div(F.col("tp"), F.col("predicted")).alias("precision"),
                    _div(F.col("tp"), F.col("support")).alias("recall"),
                    _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def summarize(pc: DataFrame, model: str | None = None) -> DataFrame:
    """Accuracy, macro precision/recall/F1 and weighted F1 from per_class."""
    by = _by(model)
    n = F.sum("support")
    return pc.groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
        n.cast("bigint").alias("n"))


def classification_metrics(pred: DataFrame, t: str = "y_true", p: str = "y_pred",
                           model: str | None = None) -> DataFrame:
    return summarize(per_class(pred, t, p, model), model)


def with_names(pc: DataFrame, names: list[str], code: str = "cls", out: str = "label") -> DataFrame:
    return pc.withColumn(out, F.element_at(F.array(*[F.lit(x) for x in names]),
                                           F.col(code) + 1))


def class_report(pred: DataFrame, names: list[str], t: str = "y_true",
                 p: str = "y_pred", digits: int = 2) -> DataFrame:
    """Per-class rows plus accuracy / macro avg / weighted avg rows, with
    precision, recall and F1 rounded as in the text report.

    The per-class table (one row per class) gets its totals from windows
    and the first class row also emits the three summary rows, so the
    predictions are aggregated once."""
    pc = with_names(per_class(pred, t, p), names, out="row")
    w = Window.partitionBy()
    s = F.sum("support").over(w)
    pc = pc.select("*", s.alias("s"), F.sum("tp").over(w).alias("tps"),
                   F.avg("precision").over(w).alias("mp"), F.avg("recall").over(w).alias("mr"),
                   F.avg("f1").over(w).alias("mf"),
                   (F.sum(F.col("precision") * F.col("support")).over(w) / s).alias("wp"),
                   (F.sum(F.col("recall") * F.col("support")).over(w) / s).alias("wr"),
                   (F.sum(F.col("f1") * F.col("support")).over(w) / s).alias("wf"),
                   F.row_number().over(Window.orderBy("cls")).alias("_first"))

    def row(name, p_, r_, f_, sup):
        return F.struct(name.alias("row"), p_.cast("double").alias("precision"),
                        r_.cast("double").alias("recall"), f_.cast("double").alias("f1"),
                        sup.cast("bigint").alias("support"))
    none = F.lit(None)
    own = row(F.col("row"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("support"))
    extra = [row(F.lit("accuracy"), none, none, F.col("tps") / F.col("s"), F.col("s")),
             row(F.lit("macro avg"), F.col("mp"), F.col("mr"), F.col("mf"), F.col("s")),
             row(F.lit("weighted avg"), F.col("wp"), F.col("wr"), F.col("wf"), F.col("s"))]
    rows = pc.select(F.explode(F.when(F.col("_first") == 1, F.array(own, *extra))
                               .otherwise(F.array(own))).alias("r")).select("r.*")
    return rows.select("row", F.round("precision", digits).alias("precision"),
                       F.round("recall", digits).alias("recall"), F.round("f1", digits).alias("f1"),
                       "support")


METRIC_COLS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]


def compare_models(pred: DataFrame, model: str = "model", t: str = "y_true",
                   p: str = "y_pred", digits: int = 4) -> DataFrame:
    m = classification_metrics(pred, t, p, model)
    return m.select(model, *[F.round(c, digits).alias(c) for c in METRIC_COLS])


def metrics_pivot(pred: DataFrame, models: list[str], model: str = "model",
                  t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Wide table: one row per metric, one column per model."""
    m = classification_metrics(pred, t, p, model)
    pairs = ", ".join(f"'{c}', {c}" for c in METRIC_COLS)
    long = m.selectExpr(model, f"stack({len(METRIC_COLS)}, {pairs}) AS (metric, value)")
    return long.groupBy("metric").pivot(model, models).agg(F.round(F.first("value"), 6))


def f1_by_model(pred: DataFrame, models: list[str], names: list[str], model: str = "model",
                t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per-class F1 per model over the union of classes; missing -> 0."""
    pc = with_names(per_class(pred, t, p, model), names)
    wide = pc.groupBy("label").pivot(model, models).agg(F.first("f1"))
    return wide.select("label", *[F.round(F.coalesce(F.col(m), F.lit(0.0)), 6).alias(m)
                                  for m in models])


def f1_bands(pc: DataFrame, hi: float = 0.85, mid: float = 0.70) -> Column:
    f1 = F.col("f1")
    return F.when(f1 >= hi, "high").when(f1 >= mid, "medium").otherwise("low")


def matrix_rows(cm: DataFrame, model: str | None = None) -> DataFrame:
    """Dense matrix as ``array<array<bigint>>`` rows (the JSON layout)."""
    by = _by(model)
    rows = cm.groupBy(*by, "t").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("r"))
    rows = rows.select(*by, "t", F.transform("r", lambda x: x["n"]).alias("row"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "row"))).alias("m")) \
               .select(*by, F.transform("m", lambda x: x["row"]).alias("confusion_matrix"))


def metrics_from_matrix(cm: DataFrame, model: str = "model") -> DataFrame:
    """Metrics from a stored long matrix (model, t, p, n) — e.g. golden files."""
    pred_like = cm.select(model, F.col("t").alias("y_true"), F.col("p").alias("y_pred"), "n")
    counts = pred_like.withColumnRenamed("y_true", "t").withColumnRenamed("y_pred", "p")
    by = [model]
    tp = counts.where(F.col("t") == F.col("p")).select(*by, F.col("t").alias("cls"),
                                                      F.col("n").alias("tp"))
    sup = counts.groupBy(*by, F.col("t").alias("cls")).agg(F.sum("n").alias("support"))
    prd = counts.groupBy(*by, F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    pc = (sup.join(prd, [*by, "cls"], "full").join(tp, [*by, "cls"], "left")
             .na.fill(0, ["tp", "support", "predicted"]))
    pc = pc.select(*by, "cls", "tp", "support", "predicted",
                   _div(F.col("tp"), F.col("predicted")).alias("precision"),
                   _div(F.col("tp"), F.col("support")).alias("recall"),
                   _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))
    return summarize(pc, model)
