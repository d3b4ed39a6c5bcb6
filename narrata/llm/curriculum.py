"""Op 8. Mixing sources to target weights over a time-varying curriculum.

DataFrame functions only. Targets: source weights share the total size; a
source stops at ``CAP`` times its own size and the excess is reshared by
weight. That fixed point is a water level: sources sorted by cap/weight stop
one after the other, so one running sum over the per-source table finds it.

Documents of a source are ordered by a hash of their id. Every document is
taken ``floor(target / source_size)`` times; the remaining demand is met by one
more copy of the documents whose running middle lies inside it, so the taken
size misses the target by half a document at most.

Curriculum: a source's weight over training time t in [0, 1] is piecewise
linear, ``1 + slope * (2t - 1)`` times its target, by default falling for the
first and rising for the last source. Its integral ``t + slope * (t^2 - t)`` is
the share of the target consumed by time t; a copy that begins after share u
gets the time that solves it. Documents are range-sorted by that position.

A hot source never meets in one task: running sums go over a bounded histogram
(source, hash bucket) first and inside one bucket second. The per-source table
has one row per source; it is joined by broadcast only if its checked row
count allows, else by a salted shuffle.

Defined results: a null or blank text has size 0 and is taken 0 times; the
null source is a source of its own, last in order; rows with the same doc_id
are ordered by a hash of their text, equal rows get equal shares of their
joint demand in some order; without any words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import BROADCAST_ROWS, is_small, join_keyed, materialise, n_words

CAP = 3
BUCKETS = 1024
SEED = "mix"
SLOPE = 0.6


def _key(seed: str) -> Column:
    """64 uniform bits from md5, the same in every engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """One row per source with its rank by code point, null last. The table
    is one row per source, not per document."""
    return sizes.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))


def water_targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds ``target``. ``sources``: source, source_size, weight. With sources
    in order of cap/weight, the first k stop exactly if the level
    (total - their caps) / (remaining weight) reaches their cap/weight."""
    total = sources.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    ratio = F.col("source_size") / F.col("weight")
    order = Window.orderBy(ratio, F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    seq = (sources.crossJoin(F.broadcast(total))  # one row
           .withColumn("ratio", cap * ratio)
           .withColumn("caps_before", F.coalesce(F.sum(F.col("source_size") * cap).over(order), F.lit(0)))
           .withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
           .withColumn("level", (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weight_before"))))
    # the first source that does not stop fixes the level for all after it
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (seq.withColumn("first", level)
            .withColumn("target", F.least((F.col("source_size") * cap).cast("double"),
                                          F.col("weight") * F.col("first.level")))
            .withColumn("target", F.coalesce("target", F.lit(0.0)))
            .drop("ratio", "caps_before", "weight_before", "level", "first", "total", "weights"))


def position(share: Column, slope: Column) -> Column:
    """Time at which ``share`` of a source's target is consumed: the root of
    slope * t^2 + (1 - slope) * t = share in [0, 1], in its stable form."""
    b = F.lit(1.0) - slope
    return (F.lit(2.0) * share) / (b + F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * share, F.lit(0.0))))


def mix(docs: DataFrame, cap: int = CAP, seed: str = SEED, slope: float = SLOPE) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken, ``position`` (of
    the first copy) and the demand columns ``copies`` needs; lazily, in no order.
    Sources weigh 1, 2, 3, repeating, in code point order."""
    own = ("size", "source_size", "target", "copies", "taken", "position", "before", "slope", "_key", "_tie", "_bucket")
    base = docs.select(*[c for c in docs.columns if c not in own]) \
        .withColumn("size", n_words()) \
        .withColumn("_key", _key(seed)) \
        .withColumn("_tie", F.xxhash64(F.coalesce("text", F.lit("")))) \
        .withColumn("_bucket", F.pmod("_key", F.lit(BUCKETS)).cast("int"))
    # one narrow pass: sizes by (source, bucket), at most BUCKETS rows a source
    hist = materialise(base.groupBy("source", "_bucket").agg(F.sum("size").alias("n")), "mix-hist")
    sources = ranked_sources(hist.groupBy("source").agg(F.sum("n").alias("source_size"))) \
        .withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    last = F.max("rank").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    plan = materialise(water_targets(sources, cap).withColumn(
        "slope", F.when(last > 1, F.lit(slope) * (F.lit(2.0) * (F.col("rank") - 1) / (last - 1) - 1)).otherwise(F.lit(0.0))),
        "mix-plan")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = join_keyed(hist.withColumn("bucket_before", F.coalesce(before, F.lit(0))).drop("n"),
                         plan.select("source", "source_size", "target", "slope"), ["source"])
    offsets = materialise(offsets, "mix-offsets")
    inner = Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last(), "_tie") \
        .rowsBetween(Window.unboundedPreceding, -1)
    inside = base.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    got = join_keyed(inside, offsets, ["source", "_bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    got = (got.withColumn("before", F.col("bucket_before") + F.col("inside"))
           .withColumn("_whole", F.least(whole, F.lit(cap)))
           .withColumn("copies", F.when(F.col("size") > 0, F.least(
               F.lit(cap).cast("long"), F.col("_whole") + (F.col("before") + F.col("size") / 2.0 < rest).cast("long"))
           ).otherwise(F.lit(0).cast("long")))
           .withColumn("taken", F.col("copies") * F.col("size"))
           .withColumn("position", F.when(F.col("copies") > 0, position(
               F.least(F.lit(1.0), F.col("before") / F.col("target")), F.col("slope")))))
    return got.drop("_key", "_tie", "_bucket", "bucket_before", "inside", "_whole")


def train_order(mixed: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per taken copy, range-sorted by training position (globally:
    partition by partition). Copy k begins after k whole passes of its source."""
    copies = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    share = F.least(F.lit(1.0), (F.col("copy") * F.col("source_size") + F.col("before")) / F.col("target"))
    placed = copies.withColumn("position", position(share, F.col("slope")))
    return placed.repartitionByRange(F.col("position"), F.col("doc_id"), F.col("copy")) \
        .sortWithinPartitions("position", "doc_id", "copy")


#: the same result by DuckDB over the registered views
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, max(rank) OVER () AS last FROM s),
q AS (
  SELECT *, {CAP} * (source_size / weight) AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size * {CAP}) OVER b, 0) AS caps_before, coalesce(sum(weight) OVER b, 0) AS weight_before
  FROM w WINDOW b AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - caps_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) AS level FROM q),
f AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, rank LIMIT 1),
p AS (
  SELECT source, source_size,
         coalesce(least(CAST(source_size * {CAP} AS DOUBLE), weight * (SELECT level FROM f)), 0.0) AS target,
         CASE WHEN last > 1 THEN {SLOPE} * (2.0::DOUBLE * (rank - 1) / (last - 1) - 1) ELSE 0.0 END AS slope FROM l),
o AS (
  SELECT d.doc_id, d.size, p.*,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k % {BUCKETS}, d.k, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (
  SELECT *, least({CAP}, CAST(floor(target / source_size) AS BIGINT)) AS whole FROM o),
r AS (
  SELECT *, CASE WHEN size > 0 THEN least({CAP}, whole + CAST(before + size / 2.0::DOUBLE < target - whole * source_size AS BIGINT))
            ELSE 0 END AS copies,
         least(1.0::DOUBLE, CAST(before AS DOUBLE) / target) AS share FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken,
       round(CAST(CASE WHEN copies > 0 THEN (2.0::DOUBLE * share) / ((1.0::DOUBLE - slope) + sqrt(greatest(
         (1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * share, 0.0::DOUBLE))) END AS DOUBLE), 9) AS position
FROM r
"""

__all__ = ["mix", "train_order", "water_targets", "position", "ORACLE", "BROADCAST_ROWS", "is_small"]
