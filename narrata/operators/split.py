"""Stratified train/validation/test split and the leakage guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.fixed_values import RANDOM_SEED
from narrata.keys import draw, unit
from narrata.operators.ranking import exact_row_number


def stratified_split(df: DataFrame, stratify: str = "product_encoded",
                     seed: int = RANDOM_SEED, id_cols=("complaint_id", "draw"),
                     mode: str = "exact", bits: int = 12) -> DataFrame:
    """Add ``split`` in {train, val, test}: 70/15/15 within each class.

    exact: rank r by ``md5(id|draw|seed|split)`` within the class of size n;
    train if r <= round(0.7 n), val if r <= round(0.85 n), else test (integer
    rounding, half up), e.g. 15000 -> 10500/2250/2250. Ranks come from the
    skew-safe :func:`exact_row_number`.

    hash: threshold on the draw fraction, no shuffle at all; proportions are
    exact only in expectation.
    """
    key = draw(*[F.col(c) for c in id_cols], seed, "split")
    if mode == "hash":
        u = unit(key)
        return df.withColumn("split", F.when(u < 0.7, "train").when(u < 0.85, "val")
                             .otherwise("test"))
    keyed = df.withColumn("_sk", key)
    r = exact_row_number(keyed, [stratify], "_sk", list(id_cols), out="_r", count_out="_n",
                         bits=bits)
    n = F.col("_n")
    train_cut = F.floor((n * 7 + 5) / 10)
    val_cut = F.floor((n * 85 + 50) / 100)
    return (r.withColumn("split", F.when(F.col("_r") <= train_cut, "train")
                         .when(F.col("_r") <= val_cut, "val").otherwise("test"))
             .drop("_sk", "_r", "_n"))


def split_leakage(df: DataFrame, text: str = "narrative", a: str = "train",
                  b: str = "test") -> DataFrame:
    """Rows of split ``b`` whose text also occurs in split ``a`` (left semi)."""
    left = df.where(F.col("split") == b)
    # distinct texts first: a text copied many times ships once per map task
    right = df.where(F.col("split") == a).select(F.col(text).alias("_t")).distinct()
    return left.join(right, left[text] == right["_t"], "left_semi")
