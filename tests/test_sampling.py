"""Balancing, exact ranking and splitting properties (F-edge, scaled)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.keys import draw
from narrata.operators.ranking import exact_row_number
from narrata.operators.sampling import balance_classes, dedup_first, sample_k
from narrata.operators.split import stratified_split
from narrata.session import broadcast_bounded

# class sizes around a floor of 10 and a cap of 15 (scaled 999/1000/1001/15000/15001)
SIZES = {"a": 9, "b": 10, "c": 11, "d": 15, "e": 16, "f": 1}


def _frame(spark):
    rows, i = [], 0
    for lab, n in SIZES.items():
        for _ in range(n):
            rows.append((i, lab, f"text {i}"))
            i += 1
    return spark.createDataFrame(rows, "complaint_id long, product string, narrative string")


def test_balance_sizes_exact(spark):
    out = balance_classes(_frame(spark), "product", 15, 10, 42)
    got = {r[0]: r[1] for r in out.groupBy("product").count().collect()}
    assert got == {"a": 10, "b": 10, "c": 11, "d": 15, "e": 15, "f": 10}
    # copies are draws 1..min; kept rows draw 0; (id, draw) is unique
    assert out.select("complaint_id", "draw").distinct().count() == out.count()


def test_balance_is_deterministic(spark):
    a = balance_classes(_frame(spark), "product", 15, 10, 42)
    b = balance_classes(_frame(spark).repartition(3), "product", 15, 10, 42)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_exact_row_number_equals_window(spark):
    # one hot key holding most rows
    df = spark.range(0, 5000).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(
            (F.col("id") % 5).cast("string")).alias("g"))
    df = df.withColumn("k", draw(F.col("id"), 7))
    fast = exact_row_number(df, ["g"], "k", ["id"], out="r", count_out="n", bits=6)
    w = Window.partitionBy("g").orderBy("k", "id")
    slow = df.withColumn("r2", F.row_number().over(w)).withColumn(
        "n2", F.count(F.lit(1)).over(Window.partitionBy("g")))
    j = fast.join(slow, ["id", "g"])
    assert j.where((F.col("r") != F.col("r2")) | (F.col("n") != F.col("n2"))).count() == 0
    assert j.count() == 5000


def test_split_counts_and_disjoint(spark):
    df = spark.range(0, 150).select(F.col("id").alias("complaint_id"), F.lit(0).alias("draw"),
                                     F.lit(3).alias("product_encoded"))
    out = stratified_split(df)
    got = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert got == {"train": 105, "val": 23, "test": 22}
    assert out.select("complaint_id").distinct().count() == 150


def test_split_15000_golden(spark):
    df = spark.range(0, 15000).select(F.col("id").alias("complaint_id"), F.lit(0).alias("draw"),
                                       F.lit(0).alias("product_encoded"))
    got = {r[0]: r[1] for r in stratified_split(df).groupBy("split").count().collect()}
    assert got == {"train": 10500, "val": 2250, "test": 2250}


def test_dedup_first_wins_and_idempotent(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (5, "y"), (4, "z")],
                               "complaint_id long, narrative string")
    once = dedup_first(df)
    assert sorted(r[0] for r in once.collect()) == [1, 2, 4]
    assert sorted(map(tuple, dedup_first(once).collect())) == sorted(map(tuple, once.collect()))


def test_class_weights_absent_class_and_total(spark):
    from narrata.operators.profile import class_weights
    # codes 0, 1, 3 present; code 2 absent
    rows = [(0,)] * 6 + [(1,)] * 3 + [(3,)] * 1
    df = spark.createDataFrame(rows, "product_encoded int")
    got = {r["product_encoded"]: r for r in class_weights(df).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert got[2]["weight"] is None and got[2]["n"] == 0
    n_total = 10
    assert abs(got[0]["weight"] - n_total / (4 * 6)) < 1e-12
    # sum of weight * n over present classes = N * (present / C)
    s = sum(r["weight"] * r["n"] for r in got.values() if r["weight"] is not None)
    assert abs(s - n_total * 3 / 4) < 1e-12


def test_dedup_plans_partial_limit_before_exchange(spark):
    """A text copied many times ships at most one row per map task."""
    df = spark.range(0, 1000).select(F.col("id").alias("complaint_id"),
                                     (F.col("id") % 3).cast("string").alias("narrative"))
    plan = dedup_first(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) and final
    assert dedup_first(df).count() == 3


def test_capped_rank_returns_every_wanted_row(spark):
    df = spark.range(0, 5000).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 8, None)
        .otherwise((F.col("id") % 5).cast("string")).alias("g")).withColumn("k", draw(F.col("id"), 7))
    capped = exact_row_number(df, ["g"], "k", ["id"], out="r", count_out="n", bits=6, cap=100)
    full = exact_row_number(df, ["g"], "k", ["id"], out="r", count_out="n", bits=6)
    want = sorted(map(str, full.where("r <= 100").collect()))
    assert sorted(map(str, capped.where("r <= 100").collect())) == want
    assert capped.where("g = 'hot'").count() < 300  # the cap plus at most one bucket of 3500 rows


def test_balance_drops_rows_before_the_class_exchange(spark, tmp_path):
    rows = spark.range(20000).select(F.col("id").alias("complaint_id"), F.lit("hot").alias("product"),
                                     F.concat(F.lit("text "), F.col("id")).alias("narrative"))
    rows.write.parquet(str(tmp_path / "in"))
    out = balance_classes(spark.read.parquet(str(tmp_path / "in")), "product", 100, 10, 42)
    assert out.count() == 100
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("row_number()")
    assert "_last" in plan[window:]  # the cut lies below the ranking window


def test_sample_k_equals_global_order(spark):
    df = spark.range(3000).withColumn("t", F.lit("x"))
    want = sorted(r[0] for r in df.orderBy(draw(F.col("id"), 42), "id").limit(50).collect())
    assert sorted(r[0] for r in sample_k(df, 50, 42).collect()) == want
    assert sample_k(df, 5000, 42).count() == 3000
    assert sample_k(df.limit(0), 5, 42).count() == 0


def test_bounded_broadcast_refuses_large_tables(spark):
    small = spark.range(5)
    assert broadcast_bounded(small, 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        broadcast_bounded(small, 4).collect()


def test_vocab_of_the_most_frequent_with_ties(spark):
    from narrata.operators.features import reaching_rank, vocab_build
    words = [w for k, w in enumerate("m n a b c d e f".split()) for _ in range([9, 7, 4, 4, 4, 4, 2, 1][k])]
    df = spark.createDataFrame([(" ".join(words[i::5]),) for i in range(5)], "t string").repartition(4)
    for n, want in ((1, "m"), (3, "mna"), (5, "mnabc"), (50, "mnabcdef")):
        got = vocab_build(df, "t", n, 1).orderBy("id").collect()
        assert "".join(r.token for r in got) == want and [r.id for r in got] == list(range(2, 2 + len(got)))
    counts = spark.createDataFrame([(w, words.count(w)) for w in set(words)], "token string, freq long")
    assert {r.token for r in reaching_rank(counts, "freq", 3).collect()} == set("mnabcd")
    assert reaching_rank(counts, "freq", 99).count() == 8
    assert vocab_build(df.limit(0), "t").count() == 0
