"""Seeded sampling, balancing and first-wins deduplication.

All draws come from md5 keys (:mod:`narrata.keys`), so results do not depend
on partitioning, task order or retries, and equal their SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.fixed_values import MAX_PER_CLASS, MIN_PER_CLASS, RANDOM_SEED, EXCERPT_WORDS
from narrata.functions.text import words
from narrata.keys import DRAW_BITS, draw
from narrata.operators.ranking import exact_row_number, group_histogram


def dedup_first(df: DataFrame, col: str = "narrative",
                order: str | list[str] = "complaint_id") -> DataFrame:
    """Exact dedup on ``col``; the row with the smallest ``order`` wins.

    The shuffle key is (xxhash64(text), text): the hash gives a cheap sort
    prefix, the text keeps it exact. ``row_number() = 1`` is planned with a
    partial WindowGroupLimit, so each map task already keeps one row per
    text before the exchange: a text copied a million times ships one row
    per map task, not a million.
    """
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(F.xxhash64(F.col(col)), F.col(col)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def balance_classes(df: DataFrame, label: str = "product",
                    max_per_class: int = MAX_PER_CLASS,
                    min_per_class: int = MIN_PER_CLASS,
                    seed: int = RANDOM_SEED, id_col: str = "complaint_id",
                    bits: int = 12) -> DataFrame:
    """Cap classes above ``max_per_class`` and oversample those below
    ``min_per_class`` to exactly that size (with replacement).

    Output gets ``draw``: 0 for rows kept as they are, ``j`` (1..min) for
    the j-th draw of an oversampled class. ``(id_col, draw)`` identifies a
    row. Cap: the ``max`` rows of lowest ``md5(id|seed)``. Floor: draw ``j``
    picks the row ranked ``md5(label|j|seed) mod n + 1``.

    Scale: a histogram pass reads only label and id and gives the last key
    bucket that each class needs; rows beyond it never reach the exchange, so
    about ``max_per_class`` rows of a class are shuffled with their text,
    whatever its size. Their ranks come from :func:`exact_row_number`. The
    oversampling join touches only classes smaller than ``min`` (bounded).
    """
    keyed = df.withColumn("_k", draw(F.col(id_col), seed))
    hist = group_histogram(keyed, [label], "_k", bits)
    ranked = exact_row_number(keyed, [label], "_k", [id_col], out="_r", count_out="_n",
                              bits=bits, hist=hist, cap=max(max_per_class, min_per_class))
    # draw table for the classes below the floor, from the class sizes only
    # (at most min_per_class rows per such class): (label, _r = pick, draw)
    sizes = hist.groupBy(label).agg(F.first("_n").alias("_n"))
    draws = (sizes.where(F.col("_n") < min_per_class)
                  .select(F.col(label).alias("_lab"), "_n",
                          F.explode(F.sequence(F.lit(1), F.lit(min_per_class))).alias("draw"))
                  .select("_lab", "draw",
                          (draw(F.col("_lab"), F.col("draw"), seed) % F.col("_n") + 1).alias("_pick")))
    # one pass over the ranked rows: a row of a small class meets each of
    # its draws; a row of another class is kept if ranked within the cap
    j = ranked.join(draws, (ranked[label] == draws["_lab"]) & (ranked["_r"] == draws["_pick"]), "left")
    keep = ((F.col("_n") >= min_per_class) & (F.col("_r") <= max_per_class)) | \
           ((F.col("_n") < min_per_class) & F.col("draw").isNotNull())
    return (j.where(keep).withColumn("draw", F.coalesce(F.col("draw"), F.lit(0)).cast("int"))
             .select(*df.columns, "draw"))


def sample_k(df: DataFrame, k: int, seed: int = RANDOM_SEED, id_col: str = "id",
             bits: int = 12) -> DataFrame:
    """Seeded sample of at most ``k`` rows: the ``k`` lowest md5 keys.

    A histogram over ``2^bits`` key buckets (ids only) names the buckets that
    hold them; other rows are dropped in the scan stage, so about ``k`` rows in
    all, not ``k`` from every partition, reach the task that cuts at ``k``."""
    keyed = df.withColumn("_k", draw(F.col(id_col), seed)) \
              .withColumn("_bkt", F.shiftright("_k", DRAW_BITS - bits))
    before = F.sum("count").over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1))
    needed = (keyed.groupBy("_bkt").count().withColumn("_before", F.coalesce(before, F.lit(0)))
                   .where(F.col("_before") < k).select("_bkt"))
    # at most 2^bits rows
    return (keyed.join(F.broadcast(needed), "_bkt", "left_semi")
                 .orderBy("_k", id_col).limit(k).select(*df.columns))


def first_per_class(df: DataFrame, label: str, order: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def class_preview(df: DataFrame, label: str = "product", order: str = "complaint_id",
                  text: str = "narrative", n_words: int = EXCERPT_WORDS) -> DataFrame:
    """First row per class and the first ``n_words`` words of its text."""
    first = first_per_class(df, label, order, 1)
    return first.select(label, order,
                        F.array_join(F.slice(words(text), 1, n_words), " ").alias("preview"))
