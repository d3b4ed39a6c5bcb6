"""Merged day profiles against the exact answers."""

import datetime as dt

from pyspark.sql import functions as F

from narrata.sources.profile_store import add_batch, day_profiles, merged_profile, period

PS = [0.5, 0.9, 0.99]


def test_merge_within_the_stated_errors(spark, tmp_path):
    """60,000 rows, one day with a third of them, three batches, one written twice."""
    path = str(tmp_path / "profiles")
    df = spark.range(60_000).select(
        F.expr("date_add(DATE'2024-01-01', CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id % 20 END AS INT))").alias("d"),
        F.expr("CAST((id * 7919) % 50021 AS INT)").alias("v"), F.col("id").cast("string").alias("text"),
        F.expr("concat('p', id % 9)").alias("product"), "id")
    for b in range(3):
        part = day_profiles(df.where(F.col("id") % 3 == b), "d", "v", ["text", "product"], kll_k=400)
        add_batch(part, path, b)
        if b == 1:
            add_batch(part, path, b)
    for first, last in ((None, None), ("2024-01-05", "2024-01-11")):
        got = merged_profile(period(spark, path, first, last), PS).first()
        want = df.where(F.col("d").between(first or "2000-01-01", last or "2100-01-01"))
        n = want.count()
        assert got["n_rows"] == got["n_values"] == n and got["n_product"] == 9
        assert abs(got["n_text"] - n) <= 4 * 0.017 * n
        e = want.agg(F.avg("v"), F.stddev_samp("v"), F.min("v"), F.max("v")).first()
        assert abs(got["mean"] - e[0]) < 1e-6 and abs(got["std"] - e[1]) < 1e-5 and (got["min"], got["max"]) == (e[2], e[3])
        for p in PS:
            rank = want.where(F.col("v") <= got[f"p{round(p * 100)}"]).count() / n
            assert abs(rank - p) <= 1.65 / 400 ** 0.9 + 1 / n


def test_a_new_day_reads_no_old_rows_and_months_merge(spark, tmp_path):
    path = str(tmp_path / "profiles")
    rows = [(dt.date(2024, 1, 31), 5, "a"), (dt.date(2024, 1, 31), None, None), (None, 3, "b")]
    schema = "d date, v int, c string"
    add_batch(day_profiles(spark.createDataFrame(rows, schema), "d", "v", ["c"]), path, 0)
    add_batch(day_profiles(spark.createDataFrame([(dt.date(2024, 2, 1), 9, "a")], schema), "d", "v", ["c"]), path, 1)
    got = {r["m"]: r for r in merged_profile(period(spark, path, "2024-01-01"), [0.5],
                                              [F.date_format("day", "yyyy-MM").alias("m")]).collect()}
    assert (got["2024-01"]["n_rows"], got["2024-01"]["n_values"], got["2024-01"]["p50"], got["2024-01"]["std"]) == (2, 1, 5, None)
    assert got["2024-02"]["max"] == 9 and got["2024-01"]["n_c"] == 1
    all_rows = merged_profile(period(spark, path), [0.5]).first()
    assert (all_rows["n_rows"], all_rows["n_c"], all_rows["p50"]) == (4, 2, 5)
    none = merged_profile(period(spark, path, "2030-01-01"), [0.5]).first()
    assert (none["n_rows"], none["n_values"], none["mean"], none["p50"], none["n_c"]) == (0, 0, None, None, 0)
