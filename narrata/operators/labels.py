"""Label lookups: normalisation maps, issue groups, encoders, decoders.

Fixed maps (tens of entries, known at plan time) are inlined as literal
``map`` expressions: a lookup is then a codegen'd hash probe inside the scan
stage, with no join and no exchange at all. Label encoders have one row per
label and are broadcast behind a checked row limit (a shuffle join on a
low-cardinality key would put a whole class in one task).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.fixed_values import (ISSUE_GROUP_MAP, OTHER_GROUP, PRIORITY_ORDER,
                                  PRODUCT_LABEL_MAP)
from narrata.session import bounded, broadcast_bounded


def map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(col, mapping: dict) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_element_at(map_literal(mapping), c)


def product_normalize(df: DataFrame, mapping: dict | None = None,
                      col: str = "product") -> DataFrame:
    """Map raw product labels; rows whose label is not in the map are dropped."""
    mapped = lookup(col, mapping or PRODUCT_LABEL_MAP)
    return df.withColumn(col, mapped).where(F.col(col).isNotNull())


def add_issue_groups(df: DataFrame, mapping: dict | None = None,
                     col: str = "issue", out: str = "issue_group",
                     default: str = OTHER_GROUP) -> DataFrame:
    return df.withColumn(out, F.coalesce(lookup(col, mapping or ISSUE_GROUP_MAP),
                                         F.lit(default)))


def label_encoder(df: DataFrame, col: str, code: str | None = None) -> DataFrame:
    """Table (label, code): 0-based codes in sorted label order.

    Ranking runs on the distinct labels only, so the single-partition
    ``dense_rank`` sees one row per class, never the data; a column of more
    labels than :func:`narrata.session.bounded` allows is refused.
    """
    code = code or f"{col}_encoded"
    labels = bounded(df.select(col).where(F.col(col).isNotNull()).distinct())
    return labels.select(col, (F.dense_rank().over(Window.orderBy(col)) - 1)
                         .cast("int").alias(code))


def encode_labels(df: DataFrame, cols=("product", "issue_group")) -> DataFrame:
    """Add ``<col>_encoded`` codes. Each encoder has one row per label and
    is broadcast: a shuffle join on a label key would send a whole class
    (possibly a third of the rows) to one task."""
    out = df
    for c in cols:
        out = out.join(F.broadcast(label_encoder(df, c)), c, "left")
    return out


def decode_labels(df: DataFrame, encoder: DataFrame, code_col: str,
                  enc_code: str, enc_label: str, out: str) -> DataFrame:
    """Code -> label name through an encoder table (one row per class,
    broadcast)."""
    e = encoder.select(F.col(enc_code).alias("_code"), F.col(enc_label).alias(out))
    return df.join(broadcast_bounded(e), F.col(code_col) == F.col("_code"), "left").drop("_code")


def priority_reindex(df: DataFrame, col: str = "priority",
                     order: list[str] | None = None) -> DataFrame:
    """Counts in a fixed category order with zeros, plus share in percent."""
    spark = df.sparkSession
    order = order or PRIORITY_ORDER
    ref = spark.createDataFrame([(i, v) for i, v in enumerate(order)],
                                f"ord int, {col} string")
    # counts has one row per category: the windows below run on a few rows
    counts = df.groupBy(col).count().withColumn("_total", F.sum("count").over(Window.partitionBy()))
    out = F.broadcast(ref).join(counts, col, "left")
    total = F.max("_total").over(Window.partitionBy())
    n = F.coalesce("count", F.lit(0))
    return out.select("ord", col, n.cast("bigint").alias("n"),
                      F.round(n * 100.0 / F.nullif(total, F.lit(0)), 2).alias("pct"))
