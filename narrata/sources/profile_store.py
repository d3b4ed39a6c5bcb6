"""Profiles of arriving days, stored as mergeable rows and merged for any period.

One row for each (day, batch): exact row, value and sum counters, the least and greatest
value, one HyperLogLog sketch for each column whose distinct values are counted and one
KLL sketch of a measure's quantiles. Rows come from partial aggregation, so a day
that holds a third of all rows is no hot task. A period is profiled by merging its rows; no text
is read again. Rows of a day that arrive later are a further batch; a batch that is written
again replaces itself (dynamic overwrite of its partitions).

Errors: distinct counts have a relative standard error of about 1.04 / sqrt(2^lg_k)
(0.016 at 12; small sets are exact); a quantile's rank is off by about 1.65 / k^0.9 at most with 99
% confidence (0.0009 at k = 4096), and it is exact up to about k values.
The other figures are exact; the mean and deviation of integer measures come from exact sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12
KLL_K = 4096


def day_profiles(df: DataFrame, day: str | Column, value: str | Column, distinct: list[str],
                 lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """(day, n_rows, n_values, total, squares, lo, hi, quantiles, distinct_<col>...).

    ``value`` is an integer measure; nulls count as rows only. A null in a
    ``distinct`` column is no value. Rows without a day form the day null."""
    d = F.col(day) if isinstance(day, str) else day
    v = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    src = df.select(d.cast("date").alias("day"), v.alias("_v"),
                    *[F.col(c).cast("string").alias(f"_d{i}") for i, c in enumerate(distinct)])
    wide = F.col("_v").cast("decimal(19,0)")
    return src.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("_v").alias("n_values"),
        F.sum("_v").alias("total"), F.sum((wide * wide).cast("decimal(38,0)")).alias("squares"),
        F.min("_v").alias("lo"), F.max("_v").alias("hi"),
        F.kll_sketch_agg_bigint("_v", F.lit(kll_k)).alias("quantiles"),
        *[F.hll_sketch_agg(f"_d{i}", F.lit(lg_k)).alias(f"distinct_{c}") for i, c in enumerate(distinct)])


def add_batch(profiles: DataFrame, path: str, batch: int) -> None:
    """Write the day profiles of one batch; written again, they replace themselves."""
    (profiles.withColumn("_day", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("none")))
        .withColumn("_batch", F.lit(int(batch))).repartition("_day").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("_batch", "_day").parquet(path))


def period(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored rows of the days from ``first`` to ``last``, both included."""
    df = spark.read.parquet(path).drop("_day", "_batch")
    if first is not None:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(F.col("day") <= F.lit(last).cast("date"))
    return df


def merged_profile(rows: DataFrame, ps: list[float], by: list[str | Column] | None = None) -> DataFrame:
    """Stored rows merged, whole or for each ``by`` (a month of ``day``, say): n_rows, first and
    last day, n_values, mean, std (sample), min, max, ``p<percent>`` (the smallest value with at
    least that share of values up to it) and ``n_<col>`` for each distinct column."""
    cols = [c for c in rows.columns if c.startswith("distinct_")]
    m = rows.groupBy(*(by or [])).agg(
        F.sum("n_rows").alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.sum("n_values").alias("n_values"), F.sum("total").alias("_t"), F.sum("squares").alias("_s"),
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.kll_merge_agg_bigint("quantiles").alias("_q"),
        *[F.hll_union_agg(c).alias(c) for c in cols])
    keys = m.columns[:len(by or [])]
    n, t = F.col("n_values").cast("double"), F.col("_t").cast("double")
    var = (F.col("_s").cast("double") - t * t / n) / (n - 1)
    some = F.col("n_values") > 0
    return m.select(
        *keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_day", "last_day",
        F.coalesce("n_values", F.lit(0)).alias("n_values"), F.when(some, t / n).alias("mean"),
        F.when(F.col("n_values") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"), "min", "max",
        *[F.when(some, F.kll_sketch_get_quantile_bigint("_q", F.lit(float(p)))).alias(f"p{round(p * 100)}")
          for p in ps],
        *[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias("n_" + c.removeprefix("distinct_"))
          for c in cols])
