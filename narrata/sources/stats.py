"""Dataset statistics (sizes and distributions) as rows and as one JSON row.

All statistics come from one compact aggregate ``(split, product,
issue_group, priority) -> n`` (a few hundred rows at most), written once to
the shared folder, so the prepared data is scanned once whatever the number of
statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.session import cut_lineage

DIST_COLS = [("product_distribution", "product"),
             ("issue_group_distribution", "issue_group"),
             ("priority_distribution", "priority")]


def _compact(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "product", "issue_group", "priority").agg(
        F.count(F.lit(1)).alias("n"))


def dataset_stats_long(df: DataFrame) -> DataFrame:
    """Rows (stat, key, value): sizes, class counts and distributions."""
    c = cut_lineage(_compact(df), "stats")
    nul = F.lit(None).cast("string")
    parts = [
        c.agg(F.lit("total_filtered").alias("stat"), nul.alias("key"), F.sum("n").alias("value")),
        c.groupBy("split").agg(F.sum("n").alias("value"))
         .select(F.concat("split", F.lit("_size")).alias("stat"), nul.alias("key"), "value"),
        c.agg(F.lit("num_product_classes").alias("stat"), nul.alias("key"),
              F.countDistinct("product").cast("bigint").alias("value")),
        c.agg(F.lit("num_issue_groups").alias("stat"), nul.alias("key"),
              F.countDistinct("issue_group").cast("bigint").alias("value")),
    ]
    for stat, col in DIST_COLS:
        parts.append(c.groupBy(col).agg(F.sum("n").alias("value"))
                      .select(F.lit(stat).alias("stat"), F.col(col).alias("key"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.col("value").cast("bigint"))


def dataset_stats_row(df: DataFrame) -> DataFrame:
    """One row: scalar sizes plus three ``map<string,bigint>`` distributions."""
    c = cut_lineage(_compact(df), "stats")
    size = [F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_size")
            for s in ("train", "val", "test")]
    scalars = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_filtered"), *size,
                    F.countDistinct("product").alias("num_product_classes"),
                    F.countDistinct("issue_group").alias("num_issue_groups"))
    out = scalars
    for stat, col in DIST_COLS:
        dist = (c.where(F.col(col).isNotNull()).groupBy(col).agg(F.sum("n").alias("value"))
                 .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "value")))).alias(stat)))
        out = out.crossJoin(F.broadcast(dist))  # one row each, from global aggregates
    return out


def write_dataset_stats(df: DataFrame, path: str) -> None:
    dataset_stats_row(df).coalesce(1).write.mode("overwrite").json(path)
