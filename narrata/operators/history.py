"""Training histories: curves as rows, running best, early stopping.

A history is a table (run, epoch, train_loss, val_loss, val_f1_macro,
val_accuracy). Windows partition by run, so each task sees one run's few
epochs, whatever the number of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_KEYS = ["train_loss", "val_loss", "val_f1_macro", "val_accuracy"]


def history_rows(df: DataFrame, run: str = "run") -> DataFrame:
    """Dict-of-lists layout (one row per run, one array per metric) to
    one row per epoch (1-based)."""
    z = F.arrays_zip(*[F.col(k) for k in HISTORY_KEYS])
    return df.select(run, F.posexplode(z).alias("i", "r")).select(
        run, (F.col("i") + 1).alias("epoch"), *[F.col(f"r.{k}").alias(k) for k in HISTORY_KEYS])


def training_history(hist: DataFrame, metric: str = "val_f1_macro", run: str = "run",
                     patience: int = 3) -> DataFrame:
    """Per epoch: best-so-far metric, whether it improved on all earlier
    epochs, epochs since the last improvement, and ``stop`` on the epoch
    where patience runs out (training stops after it)."""
    w = Window.partitionBy(run).orderBy("epoch")
    prev_best = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    improved = prev_best.isNull() | (F.col(metric) > prev_best)
    h = hist.withColumn("improved", improved)
    last_imp = F.max(F.when(F.col("improved"), F.col("epoch"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    h = (h.withColumn("best_so_far", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("since_best", F.col("epoch") - last_imp))
    first_stop = F.min(F.when(F.col("since_best") >= patience, F.col("epoch"))).over(
        Window.partitionBy(run))
    return h.withColumn("stop", F.col("epoch") == first_stop)


def best_epochs(th: DataFrame, metric: str = "val_f1_macro", run: str = "run") -> DataFrame:
    """Per run: best epoch (first maximum), best value, stop epoch."""
    agg = th.groupBy(run).agg(
        F.max(F.struct(F.col(metric), (-F.col("epoch")).alias("_ne"))).alias("b"),
        F.min(F.when(F.col("stop"), F.col("epoch"))).alias("stop_epoch"),
        F.max("epoch").alias("epochs"))
    return agg.select(run, (-F.col("b._ne")).alias("best_epoch"),
                      F.round(F.col(f"b.{metric}"), 6).alias("best_value"), "stop_epoch", "epochs")


def events_history(events: DataFrame) -> DataFrame:
    """A history per user from ``events``: epoch = day number, metric =
    that day's mean value (scaled to [0, 1)), loss = 1 - metric."""
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    daily = events.groupBy(F.col("user_id").alias("run"), day.alias("day")).agg(
        F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("run").orderBy("day")
    return daily.select("run", F.row_number().over(w).alias("epoch"),
                        (F.col("v") / (F.col("v") + 1)).alias("val_f1_macro"),
                        (1 / (F.col("v") + 1)).alias("val_loss"),
                        F.col("n").alias("n_events"))
