"""Reproducible draw keys.

Sampling, balancing and splitting order rows by a 32-bit draw taken from
``md5(id | seed | salt)``. The same expression exists in Spark and DuckDB,
so every seeded operator is checkable against SQL and gives the same rows on
any cluster layout (unlike ``rand``/``sample``/``dropDuplicates``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 32


def draw(*parts) -> Column:
    """32-bit unsigned draw of ``md5(p1|p2|...)`` as bigint in [0, 2^32)."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit("|"))
        cols.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.conv(F.substring(F.md5(F.concat(*cols)), 1, 8), 16, 10).cast("bigint")


def draw_sql(*parts: str) -> str:
    """DuckDB text of the same draw; parts are SQL expressions."""
    inner = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"


def unit(key: Column) -> Column:
    """Draw as a fraction in [0, 1)."""
    return key / F.lit(float(2 ** DRAW_BITS))
