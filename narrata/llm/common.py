"""Helpers shared by the training-data operators.

Words are runs of anything but the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``). On UTF-8 bytes that is exactly ``bytes.split()``,
and ``bytes.lower()`` lower-cases A-Z only, so Python tasks work on bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from narrata.session import scratch_path, ship_package

WORD = r"[^\x20\x09-\x0D]+"
#: rows of one Arrow batch: texts may be long, so batches stay small
BATCH_ROWS = 128
#: a table of more rows than this is joined by a salted shuffle, not broadcast
BROADCAST_ROWS = 200_000


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"")).alias(col)


def words(col: str = "text") -> Column:
    """Native word array of a text (null: none)."""
    return F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(col: str = "text") -> Column:
    """Native word count: code points that begin a word."""
    t = F.coalesce(F.col(col), F.lit(""))
    return F.regexp_count(t, F.lit(WORD)).cast("long")


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_arrow(df: DataFrame, ddl: str,
              fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` for a generator of column dicts; casts to ``ddl``."""
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                 for f, c in ((f, cols[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_spec(ddl: str) -> pa.Schema:
    return to_arrow_schema(schema_of(ddl))


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, keeps column pruning and size figures."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a (materialised) table has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def join_keyed(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left",
               limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join on ``keys`` where one key may hold a third of ``big``.

    ``small`` holds one row per key. It is broadcast when its row count, which
    is checked, allows it; beyond that its rows are replicated over ``salts``
    and the join shuffles on (keys, salt), so a hot key meets many tasks.
    Null keys match."""
    cond = [big[k].eqNullSafe(small[k]) for k in keys]
    if is_small(small, limit):
        joined = big.join(F.broadcast(small), _all(cond), how)
    else:
        salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        plain = [f.name for f in big.schema.fields if f.dataType.typeName() in ("long", "integer", "string", "double")]
        left = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
        joined = left.join(salted, _all([left[k].eqNullSafe(salted[k]) for k in [*keys, "_salt"]]), how)
        small = salted
        joined = joined.drop(left["_salt"]).drop(salted["_salt"])
    for k in keys:
        joined = joined.drop(small[k])
    return joined


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def pack(docs: DataFrame, *plain: str) -> DataFrame:
    """The ``plain`` columns, and all others as one struct column ``others``, so
    that no column of the caller can clash with an operator's."""
    rest = [c for c in docs.columns if c not in plain]
    others = F.struct(*[docs[f"`{c}`"] for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    return docs.select(*plain, others.alias("others"))


def unpack(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that :func:`pack` took, in their order."""
    return packed.select(*[F.col(c) if c in packed.columns and c != "others"
                           else F.col("others").getField(c).alias(c) for c in columns])
