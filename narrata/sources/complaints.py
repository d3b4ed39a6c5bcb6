"""Complaint sources and sinks.

CSV landing files are read with a fixed all-string schema (no inference,
no per-read type drift), renamed to snake_case and projected onto the
expected columns; absent columns become typed null literals. Quoted multi-line
files are read in byte ranges by many tasks (``quoted_csv``); a zipped one is
not splittable. Files are landed once as Parquet and every later job reads the
Parquet (partition pruning on ``split``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.sources.quoted_csv import read_csv

# raw CSV header -> column name
RAW_COLUMNS = {
    "Complaint ID": "complaint_id",
    "Date received": "date_received",
    "Product": "product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Consumer complaint narrative": "narrative",
    "Company response to consumer": "company_response",
    "Timely response?": "timely",
}
COMPLAINT_COLUMNS = list(RAW_COLUMNS.values())


def project_columns(df: DataFrame, columns=None, types: dict | None = None) -> DataFrame:
    """Select ``columns`` in order; those absent from ``df`` become nulls."""
    columns = columns or COMPLAINT_COLUMNS
    types = types or {}
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present
                       else F.lit(None).cast(types.get(c, "string")).alias(c)
                       for c in columns])


def read_complaints_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw complaint CSV (header, quoted multi-line fields) -> raw frame.

    The header is read as data-independent strings; only the eight known
    columns are kept (pruned by the CSV reader), ids become bigint. Each file is
    one task's, and all files must have the first one's header, else the read
    fails; :func:`read_complaints_ranges` has neither limit.
    """
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", False)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .csv(path))
    renamed = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in RAW_COLUMNS.items()
                           if k in raw.columns])
    out = project_columns(renamed)
    return out.withColumn("complaint_id", F.expr("try_cast(complaint_id AS BIGINT)"))


def read_complaints_ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As :func:`read_complaints_csv`, by byte ranges over many tasks; columns
    are found by each file's own header."""
    raw = read_csv(spark, path, list(RAW_COLUMNS))
    out = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in RAW_COLUMNS.items()])
    return out.withColumn("complaint_id", F.expr("try_cast(complaint_id AS BIGINT)"))


def write_complaints_csv(df: DataFrame, path: str) -> None:
    """Complaint rows as a landing CSV with the raw header names (quoted,
    multi-line fields, whitespace kept)."""
    inv = {v: k for k, v in RAW_COLUMNS.items()}
    out = df.select(*[F.col(c).cast("string").alias(inv[c]) for c in COMPLAINT_COLUMNS if c in df.columns])
    (out.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path))


def land_as_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, base: str, fmt: str = "parquet") -> None:
    """All splits in one write, partitioned by ``split`` (train/val/test)."""
    w = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(base)
    else:
        w.parquet(base)


def read_split(spark: SparkSession, base: str, split: str | None = None) -> DataFrame:
    """Read the split table; a ``split`` filter prunes partitions."""
    df = spark.read.parquet(base)
    return df if split is None else df.where(F.col("split") == split)


# --------------------------------------------------------------------------
# API pages: {"hits": {"hits": [{"_source": {...}}, ...]}}
# --------------------------------------------------------------------------

API_SOURCE = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("date_received", T.StringType()),
    T.StructField("issue", T.StringType()),
    T.StructField("sub_issue", T.StringType()),
    T.StructField("complaint_what_happened", T.StringType()),
    T.StructField("company_response", T.StringType()),
    T.StructField("timely", T.StringType()),
])
API_PAGE = T.StructType([T.StructField("hits", T.StructType([
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("_source", API_SOURCE)])))]))])


def api_pages_flatten(pages: DataFrame, body_col: str = "body",
                      product: str = "Credit reporting") -> DataFrame:
    """JSON page bodies -> complaint rows (one per hit).

    Blank narratives are dropped, the date is cut to 10 characters, absent
    fields become empty strings, the product is the constant ``product``.
    Pages are parsed where they sit: no shuffle.
    """
    parsed = pages.select(F.from_json(F.col(body_col), API_PAGE).alias("p"))
    hits = parsed.select(F.explode_outer("p.hits.hits").alias("h")).where(F.col("h").isNotNull())
    s = "h._source."
    narrative = F.coalesce(F.col(s + "complaint_what_happened"), F.lit(""))
    out = hits.select(
        F.coalesce(F.col(s + "complaint_id"), F.lit("")).alias("complaint_id"),
        F.substring(F.coalesce(F.col(s + "date_received"), F.lit("")), 1, 10).alias("date_received"),
        F.lit(product).alias("product"),
        F.coalesce(F.col(s + "issue"), F.lit("")).alias("issue"),
        F.coalesce(F.col(s + "sub_issue"), F.lit("")).alias("sub_issue"),
        narrative.alias("narrative"),
        F.coalesce(F.col(s + "company_response"), F.lit("")).alias("company_response"),
        F.coalesce(F.col(s + "timely"), F.lit("")).alias("timely"),
    )
    return out.where(F.col("narrative").rlike(r"(?U)\S"))


def to_api_pages(complaints: DataFrame, page_size: int = 100) -> DataFrame:
    """Render complaint rows as API page bodies (page = id div page_size).

    Used to feed :func:`api_pages_flatten` from the driver tables; each page
    holds at most ``page_size`` hits, so no group grows with the data.
    """
    src = F.struct(
        F.col("complaint_id").cast("string").alias("complaint_id"),
        F.concat(F.col("date_received"), F.lit("T12:00:00-05:00")).alias("date_received"),
        F.col("issue").alias("issue"),
        F.col("sub_issue").alias("sub_issue"),
        F.col("narrative").alias("complaint_what_happened"),
        F.col("company_response").alias("company_response"),
        F.col("timely").alias("timely"))
    pages = (complaints.groupBy(F.floor(F.col("complaint_id") / page_size).alias("page"))
             .agg(F.collect_list(F.struct(src.alias("_source"))).alias("hits")))
    return pages.select("page", F.to_json(F.struct(F.struct(F.col("hits").alias("hits"))
                                                   .alias("hits"))).alias("body"))
