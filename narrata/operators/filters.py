"""Row filters and predicates (all lazy, all pushed into the scan stage).

Every filter is a plain ``where`` over built-in expressions, so Catalyst
keeps them inside one whole-stage-codegen span with the scan and pushes the
simple ones (null checks, comparisons) down to the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.fixed_values import DATE_CUTOFF, GATE_MIN_WORDS, MIN_WORD_COUNT
from narrata.functions.text import has_min_words, has_text, parse_date

TEXT = "narrative"


def filter_date_cutoff(df: DataFrame, cutoff: str = DATE_CUTOFF,
                       col: str = "date_received") -> DataFrame:
    """Parse dates (bad ones become null) and keep ``date >= cutoff``.

    A column that is already a date/timestamp is compared as it is, so the
    predicate reaches the Parquet reader (row-group skipping on min/max)."""
    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
    typ = df.schema[col].dataType
    if isinstance(typ, (DateType, TimestampType, TimestampNTZType)):
        return df.where(F.col(col) >= F.lit(cutoff).cast(typ)) \
                 .withColumn(col, F.col(col).cast("date"))
    return (df.withColumn(col, parse_date(col))
              .where(F.col(col) >= F.lit(cutoff).cast("date")))


def filter_blank(df: DataFrame, col: str = TEXT) -> DataFrame:
    return df.where(has_text(col))


def filter_min_words(df: DataFrame, min_words: int = MIN_WORD_COUNT,
                     col: str = TEXT) -> DataFrame:
    """Rows with at least ``min_words`` whitespace-separated words (checked
    by an anchored match that stops at that word, not by counting all)."""
    return df.where(has_min_words(col, min_words))


def gate_min_words(df: DataFrame, min_words: int = GATE_MIN_WORDS,
                   col: str = TEXT) -> DataFrame:
    """Validity gate: adds ``accepted`` (at least ``min_words`` words)."""
    return df.withColumn("accepted", has_min_words(col, min_words))


def drop_class(df: DataFrame, label: str, col: str = "product") -> DataFrame:
    """Rows whose class differs from ``label`` (nulls are kept out, as ``!=``)."""
    return df.where(F.col(col) != F.lit(label))


def fill_text(df: DataFrame, cols=(TEXT,)) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in cols})


def null_profile(df: DataFrame) -> DataFrame:
    """Missing-value count per column as long rows (column, n_null)."""
    cols = df.columns
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(f"c{i}")
                   for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, n_null)") \
              .withColumn("n_null", F.coalesce(F.col("n_null"), F.lit(0)).cast("bigint"))


def log_records(events: DataFrame, json_col: str = "props",
                present: str = "k", absent: str = "eval_k") -> DataFrame:
    """Rows whose JSON payload has key ``present`` and lacks ``absent``."""
    p = F.get_json_object(F.col(json_col), f"$.{present}")
    a = F.get_json_object(F.col(json_col), f"$.{absent}")
    return events.where(p.isNotNull() & a.isNull()).withColumn(present, p.cast("double"))
