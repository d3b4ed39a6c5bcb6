"""Error analysis: typed misclassifications, quota samples, error profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.fixed_values import (ERROR_LONG_WORDS, ERROR_LOW_CONFIDENCE, ERROR_SHORT_WORDS,
                                  RANDOM_SEED)
from narrata.functions.text import excerpt, word_count
from narrata.keys import draw
from narrata.session import broadcast_bounded


def error_type(words, confidence):
    """short_text < 30 words; long_noisy > 200; low_confidence < 0.5;
    else class_overlap (checked in this order)."""
    return (F.when(words < ERROR_SHORT_WORDS, "short_text")
             .when(words > ERROR_LONG_WORDS, "long_noisy")
             .when(confidence < ERROR_LOW_CONFIDENCE, "low_confidence")
             .otherwise("class_overlap"))


def collect_errors(pred: DataFrame, names: list[str], text: str = "text",
                   id_col: str = "id") -> DataFrame:
    """Misclassified rows with type, excerpt, word count, labels, confidence."""
    err = pred.where(F.col("y_true") != F.col("y_pred"))
    wc = F.coalesce(word_count(text), F.lit(0))
    lab = F.array(*[F.lit(x) for x in names])
    return err.select(
        F.col(id_col).alias("index"),
        excerpt(F.coalesce(F.col(text), F.lit(""))).alias("text_excerpt"),
        wc.alias("word_count"),
        F.element_at(lab, F.col("y_true") + 1).alias("true_label"),
        F.element_at(lab, F.col("y_pred") + 1).alias("predicted_label"),
        F.col("confidence"),
        error_type(wc, F.col("confidence")).alias("error_type"))


def error_sample(errors: DataFrame, n: int = 30, seed: int = RANDOM_SEED,
                 id_col: str = "index") -> DataFrame:
    """Quota sample: if more than ``n`` errors, keep per type the
    ``max(1, n // n_types)`` rows of lowest md5 key, then the first ``n``
    in (type, key) order; otherwise all errors.

    The per-type ranking is bounded by ``n`` (partial WindowGroupLimit
    before the exchange), and the quota comes from a <= 4-row table."""
    key = draw(F.col(id_col), seed, "err")
    w = Window.partitionBy("error_type").orderBy(key, id_col)
    ranked = errors.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    types = errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("_c"))
    tot = types.agg(F.sum("_c").alias("_total"), F.count(F.lit(1)).alias("_types"))
    q = tot.select("_total", F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_types"))).alias("_quota"))
    j = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(q.withColumn("_one", F.lit(1))), "_one")
    small = j.where((F.col("_total") <= n) | (F.col("_r") <= F.col("_quota")))
    return (small.orderBy("error_type", "_r").limit(n)
                 .drop("_r", "_one", "_total", "_quota"))


def error_rate(pred: DataFrame, model: str | None = None) -> DataFrame:
    by = [model] if model else []
    return pred.groupBy(*by).agg(F.avg((F.col("y_true") != F.col("y_pred")).cast("double"))
                                 .alias("error_rate"), F.count(F.lit(1)).alias("n"))


def confusion_pairs(errors: DataFrame, k: int = 15, cut: int = 15) -> DataFrame:
    c = errors.groupBy("true_label", "predicted_label").agg(F.count(F.lit(1)).alias("count"))
    top = c.orderBy(F.desc("count"), "true_label", "predicted_label").limit(k)
    return top.withColumn("pair", F.concat(F.substring("true_label", 1, cut), F.lit(" → "),
                                           F.substring("predicted_label", 1, cut)))


def confidence_hist(pred: DataFrame, model: str = "model", bins: int = 30) -> DataFrame:
    """Per model: equal-width histogram of confidence over [min, max]
    (last bin closed) plus the mean; bounds come from a per-model aggregate."""
    stats = pred.groupBy(model).agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"),
                                    F.avg("confidence").alias("mean"))
    # one stats row per model; broadcast, as a shuffle join on a handful of
    # model keys would put every prediction in a handful of tasks
    j = pred.select(model, "confidence").join(broadcast_bounded(stats), model)
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)) \
         .otherwise(F.floor((F.col("confidence") - F.col("lo")) / width))
    j = j.withColumn("bin", F.least(b, F.lit(bins - 1)).cast("int"))
    return j.groupBy(model, "bin").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.first("mean"), 6).alias("mean_confidence"))


def most_confident(pred: DataFrame, models: list[str], model: str = "model",
                   id_col: str = "id") -> DataFrame:
    """Per row id, the model of highest confidence; ties go to the model
    listed first."""
    order = F.array_position(F.array(*[F.lit(m) for m in models]), F.col(model))
    best = pred.groupBy(id_col).agg(F.max(F.struct(F.col("confidence"), (-order).alias("_o"),
                                                   F.col(model).alias("_m"))).alias("b"))
    return best.select(id_col, F.col("b._m").alias("most_confident_model"),
                       F.round("b.confidence", 6).alias("confidence"))
