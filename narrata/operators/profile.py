"""Profiling aggregates: counts, shares, lengths, histograms, trends.

Scale notes. Every profile is a partial (map-side) aggregation. Length
statistics are computed from a compact ``(group, value) -> count`` table:
word counts have few distinct values, so exact percentiles (with the
``frequency`` argument), histogram bounds and box whiskers run on that small
table instead of on the rows; no statistic ever gathers rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.fixed_values import (CHART_STOPWORDS, CUTOFFS, EDA_STOPWORDS, LENGTH_BINS,
                                  LENGTH_CLIP, OTHER_GROUP, PERCENTILES, RANDOM_SEED)
from narrata.functions.text import tokenize, year_month
from narrata.keys import draw


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Count per value (nulls excluded), ordered by count desc then value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
              .orderBy(F.desc(out), col))


def class_share(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage (2 decimals) per value; the total comes from the
    small counts table, not from a window over the rows."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return vc.select(col, "n", F.round(F.col("n") * 100.0 / total, 2).alias("pct"))


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    return value_counts(df, col).limit(k)


def top_unmapped(df: DataFrame, issue: str = "issue", group: str = "issue_group",
                 k: int = 20) -> DataFrame:
    return top_k(df.where(F.col(group) == OTHER_GROUP), issue, k)


def dataset_summary(df: DataFrame, label: str = "product", group: str = "issue_group",
                    date: str = "date_received") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.countDistinct(label).alias("n_products"),
                  F.countDistinct(group).alias("n_issue_groups"),
                  F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def value_table(df: DataFrame, value: Column | str, by: list[str] | None = None) -> DataFrame:
    """Compact ``(by..., v, f)`` frequency table of an integer measure."""
    by = by or []
    return df.groupBy(*by, _c(value).alias("v")).agg(F.count(F.lit(1)).alias("f"))


def length_describe(df: DataFrame, value: Column | str) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear), max."""
    vt = value_table(df.where(_c(value).isNotNull()), value)
    w = Window.partitionBy()
    n = F.sum("f").over(w)
    mean = F.sum(F.col("v") * F.col("f")).over(w) / n
    vt = vt.select("v", "f", n.alias("n"), mean.alias("mean"))  # small table
    q = F.percentile(F.col("v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("f"))
    agg = vt.agg(F.first("n").alias("count"), F.first("mean").alias("mean"),
                 (F.sum(F.col("f") * (F.col("v") - F.col("mean")) ** 2)
                  / (F.first("n") - 1)).alias("_var"),
                 F.min("v").alias("min"), q.alias("_q"), F.max("v").alias("max"))
    return agg.select(
        F.col("count").cast("bigint").alias("count"), F.round("mean", 6).alias("mean"),
        F.round(F.sqrt("_var"), 6).alias("std"),
        F.col("min").cast("double").alias("min"), F.round(F.col("_q")[0], 6).alias("p25"),
        F.round(F.col("_q")[1], 6).alias("p50"), F.round(F.col("_q")[2], 6).alias("p75"),
        F.col("max").cast("double").alias("max"))


def length_percentiles(df: DataFrame, value: Column | str, ps=None) -> DataFrame:
    ps = ps or PERCENTILES
    vt = value_table(df.where(_c(value).isNotNull()), value)
    q = F.percentile(F.col("v"), F.array(*[F.lit(p) for p in ps]), F.col("f"))
    r = vt.agg(q.alias("q"))
    return r.select(F.posexplode("q").alias("i", "value")).select(
        F.element_at(F.array(*[F.lit(int(round(p * 100))) for p in ps]), F.col("i") + 1)
        .alias("pct"), F.round("value", 6).alias("value"))


def length_histogram(df: DataFrame, value: Column | str, clip: int = LENGTH_CLIP,
                     bins: int = LENGTH_BINS, by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram of ``least(value, clip)`` over [min, max];
    the last bin is closed on the right (NumPy rule)."""
    by = by or []
    vt = value_table(df.where(_c(value).isNotNull()), F.least(_c(value), F.lit(clip)), by)
    w = Window.partitionBy(*by)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    width = (hi - lo) / F.lit(float(bins))
    raw_bin = F.when(hi == lo, F.lit(0)).otherwise(F.floor((F.col("v") - lo) / width))
    binned = vt.select(*by, "f", F.least(raw_bin, F.lit(bins - 1)).cast("int").alias("bin"),
                       lo.alias("lo"), width.alias("width"))
    return (binned.groupBy(*by, "bin").agg(F.sum("f").alias("n"), F.first("lo").alias("lo"),
                                           F.first("width").alias("width"))
                  .select(*by, "bin", F.col("n").cast("bigint").alias("n"),
                          F.round(F.col("lo") + F.col("bin") * F.col("width"), 6).alias("left_edge")))


def length_by_class(df: DataFrame, label: str, value: Column | str,
                    upper: int = LENGTH_CLIP) -> DataFrame:
    """Box statistics per class for values below ``upper``: quartiles and the
    whiskers (extreme values inside 1.5 IQR), ordered by median."""
    vt = value_table(df.where(_c(value) < upper), value, [label])
    q = vt.groupBy(label).agg(
        F.percentile(F.col("v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("f")).alias("q"),
        F.sum("f").alias("n"))
    q = q.select(label, "n", F.round(F.col("q")[0], 6).alias("q1"),
                 F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2], 6).alias("q3"))
    j = vt.join(q, label)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr)
    whisk = j.groupBy(label).agg(F.min(F.when(inside, F.col("v"))).cast("double").alias("whisker_lo"),
                                 F.max(F.when(inside, F.col("v"))).cast("double").alias("whisker_hi"))
    return q.join(whisk, label).select(label, F.col("n").cast("bigint").alias("n"), "q1", "median",
                                       "q3", "whisker_lo", "whisker_hi").orderBy("median", label)


def cutoff_coverage(df: DataFrame, value: Column | str, cutoffs=None) -> DataFrame:
    cutoffs = cutoffs or CUTOFFS
    vt = value_table(df.where(_c(value).isNotNull()), value)
    agg = vt.agg(*[(F.sum(F.when(F.col("v") <= c, F.col("f")).otherwise(0)) / F.sum("f"))
                   .alias(f"c{c}") for c in cutoffs])
    pairs = ", ".join(f"{c}, c{c}" for c in cutoffs)
    return agg.selectExpr(f"stack({len(cutoffs)}, {pairs}) AS (cutoff, share)") \
              .select("cutoff", F.round(F.col("share") * 100, 6).alias("pct"))


def monthly_volume(df: DataFrame, ts: str, by: str) -> DataFrame:
    return df.groupBy(year_month(ts).alias("year_month"), by).agg(F.count(F.lit(1)).alias("n"))


def mapping_coverage(df: DataFrame, group: str = "issue_group") -> DataFrame:
    unm = F.sum((F.col(group) == OTHER_GROUP).cast("int"))
    n = F.count(F.lit(1))
    return df.agg((n - unm).alias("mapped"), unm.alias("unmapped"),
                  F.round((n - unm) * 100.0 / n, 6).alias("mapped_pct"),
                  F.round(unm * 100.0 / n, 6).alias("unmapped_pct"))


def split_distribution(df: DataFrame, label: str = "product", split: str = "split") -> DataFrame:
    c = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(split))
    return c.select(split, label, "n", F.round(F.col("n") / tot, 6).alias("share"))


def split_totals(df: DataFrame, label: str = "product", split: str = "split") -> DataFrame:
    """Counts with per-split and grand totals (rollup)."""
    return df.rollup(split, label).agg(F.count(F.lit(1)).alias("n"))


def balance_compare(before: DataFrame, after: DataFrame, label: str = "product") -> DataFrame:
    b = before.groupBy(label).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).alias("n_after"))
    return b.join(a, label, "full").select(label, F.coalesce("n_before", F.lit(0)).alias("n_before"),
                                           F.coalesce("n_after", F.lit(0)).alias("n_after"))


def class_weights(df: DataFrame, code: str = "product_encoded") -> DataFrame:
    """Weight N / (C n_c) for codes 0..max(code); absent codes get null
    (the single-machine original divides by zero)."""
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    stats = counts.select(F.sum("n").over(w).alias("_total"), F.max(code).over(w).alias("_mx"))
    codes = (stats.limit(1)
                  .select("_total", "_mx", F.explode(F.sequence(F.lit(0), F.col("_mx"))).alias(code)))
    out = codes.join(counts, code, "left")
    n_classes = F.col("_mx") + 1
    return out.select(F.col(code).cast("int").alias(code), F.coalesce("n", F.lit(0)).alias("n"),
                      F.when(F.col("n") > 0, F.col("_total") / (n_classes * F.col("n")))
                      .alias("weight"))


def top_words(df: DataFrame, label: str, text: str, n: int = 30,
              stopwords=None, sample_per_class: int | None = None,
              seed: int = RANDOM_SEED, id_col: str = "complaint_id") -> DataFrame:
    """Most frequent words (``[a-z]{3,}`` tokens, minus stop words) per class.

    Tokens are counted with a partial aggregation on (class, word); the top
    ``n`` per class come from a ranked window on the small counts table.
    """
    stop = list(EDA_STOPWORDS if stopwords is None else stopwords)
    src = df.where(F.col(text).isNotNull())
    if sample_per_class:
        w = Window.partitionBy(label).orderBy(draw(F.col(id_col), seed), id_col)
        src = src.withColumn("_s", F.row_number().over(w)).where(F.col("_s") <= sample_per_class)
    toks = src.select(label, F.explode(tokenize(text)).alias("word"))
    toks = toks.where(F.col("word").rlike("^[a-z]{3,}$") & ~F.col("word").isin(stop))
    counts = toks.groupBy(label, "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(label).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


CHART_WORDS = dict(n=150, stopwords=CHART_STOPWORDS)
