"""Exact per-group row numbers that stay balanced under skew.

``row_number() over (partition by g order by key)`` sends every row of a
group to one task; with one class holding a third of all rows that task
would sort a third of the data. When the order key is a uniform 32-bit draw
(see :mod:`narrata.keys`), the same exact numbers come from two balanced
steps:

1. a histogram ``(g, bucket) -> count`` with ``bucket = key >> (32-bits)``;
   partial aggregation makes it one small row set, and a running sum over
   the buckets of each group gives ``before`` = rows in lower buckets;
2. ``row_number`` within ``(g, bucket)``, whose partitions hold about
   ``n_g / 2^bits`` rows each, plus ``before``.

The result equals the plain window for every row (ties broken by
``tiebreak``), so SQL oracles use the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.keys import DRAW_BITS
from narrata.session import broadcast_bounded


def _null_safe_on(left: DataFrame, right: DataFrame, cols):
    return reduce(lambda a, b: a & b,
                  [left[c].eqNullSafe(right[c]) for c in cols])


def group_histogram(df: DataFrame, by: list[str], key: str, bits: int) -> DataFrame:
    """(by..., _bkt, _cnt, _before, _n) with one row per non-empty bucket."""
    h = (df.groupBy(*by, F.shiftright(F.col(key), DRAW_BITS - bits).alias("_bkt"))
           .agg(F.count(F.lit(1)).alias("_cnt")))
    w = Window.partitionBy(*by).orderBy("_bkt")
    return h.select(
        *by, "_bkt", "_cnt",
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_cnt").over(Window.partitionBy(*by)).alias("_n"))


def exact_row_number(df: DataFrame, by: list[str], key: str, tiebreak: list[str],
                     out: str = "_rn", count_out: str = "_n", bits: int = 12,
                     hist: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Add ``out`` = row number in ``by`` ordered by (key, tiebreak...) and
    ``count_out`` = group size. ``key`` must be a bigint draw in [0, 2^32).

    The input is read twice (histogram, ranking): materialise it first when
    it is expensive to recompute. A histogram already built with
    :func:`group_histogram` may be passed in (and shared by the caller).

    With ``cap`` only rows ranked up to about ``cap`` are wanted: the histogram
    names the last bucket of each group that holds such a row, and rows of later
    buckets are dropped in the scan stage, before the exchange. Every row of rank
    <= ``cap`` is returned, with its exact rank (and at most one bucket more)."""
    keyed = df.withColumn("_bkt", F.shiftright(F.col(key), DRAW_BITS - bits))
    hist = hist if hist is not None else group_histogram(df, by, key, bits)
    if cap is not None:
        last = (hist.where(F.col("_before") < cap)
                    .groupBy(*[F.col(c).alias(f"_l_{c}") for c in by]).agg(F.max("_bkt").alias("_last")))
        on = reduce(lambda a, b: a & b, [keyed[c].eqNullSafe(F.col(f"_l_{c}")) for c in by])
        keyed = (keyed.join(broadcast_bounded(last), on, "inner")  # one row per group
                      .where(F.col("_bkt") <= F.col("_last"))
                      .drop("_last", *[f"_l_{c}" for c in by]))
    w = Window.partitionBy(*by, "_bkt").orderBy(F.col(key), *[F.col(c) for c in tiebreak])
    ranked = keyed.withColumn("_rb", F.row_number().over(w))
    h = hist.select(*[F.col(c).alias(f"_h_{c}") for c in by], F.col("_bkt").alias("_h_bkt"),
                    "_before", "_n")
    cond = reduce(lambda a, b: a & b,
                  [ranked[c].eqNullSafe(h[f"_h_{c}"]) for c in by] + [ranked["_bkt"] == h["_h_bkt"]])
    joined = ranked.join(h, cond, "inner")
    res = (joined.withColumn(out, (F.col("_before") + F.col("_rb")).cast("bigint"))
                 .withColumn(count_out, F.col("_n").cast("bigint"))
                 .drop("_rb", "_before", "_bkt", "_h_bkt", *[f"_h_{c}" for c in by]))
    return res if count_out == "_n" else res.drop("_n")
