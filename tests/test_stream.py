"""The streaming triage equals the batch projection on the same rows."""

import tempfile

from narrata.streaming.triage_stream import run_triage_stream, triage_rows


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="narrata-test-", dir="/tmp")
    run_triage_stream(spark, "/root/testdata/sf0.001", f"{base}/out", f"{base}/ckpt",
                      glob="documents.parquet")
    got = spark.read.parquet(f"{base}/out")
    want = triage_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert got.count() == want.count() == 200
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def _write(spark, rows, path):
    spark.createDataFrame(rows, "complaint_id long, narrative string, n int").coalesce(1).write.mode("append").parquet(path)


def test_dedup_over_batches_and_restarts(spark):
    from narrata.streaming.dedup_stream import run_dedup_stream
    from narrata.operators.sampling import dedup_first
    base = tempfile.mkdtemp(prefix="narrata-test-", dir="/tmp")
    every = [(i, ["a", "b", None, "", "c\n“d”"][i % 5] if i % 3 else f"own {i}", None if i % 4 else i) for i in range(60)]

    def run():
        stream = spark.readStream.schema("complaint_id long, narrative string, n int") \
            .option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        run_dedup_stream(stream, f"{base}/out", f"{base}/ckpt")
        return sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()), key=str)

    for k in range(0, 40, 20):
        _write(spark, every[k:k + 20][::-1], f"{base}/in")
    run()
    _write(spark, every[40:], f"{base}/in")  # arrives after a restart
    got = run()
    want = dedup_first(spark.createDataFrame(every, "complaint_id long, narrative string, n int"))
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert run() == got  # a restart without new files adds none


def test_dedup_forgets_after_expiry(spark):
    from narrata.streaming.dedup_stream import run_dedup_stream
    base = tempfile.mkdtemp(prefix="narrata-test-", dir="/tmp")
    schema = "complaint_id long, narrative string, at timestamp"
    for rows in ([(1, "a", "2024-01-01")], [(2, "a", "2024-01-02")], [(3, "b", "2024-03-01")], [(4, "b", "2024-03-02")], [(5, "a", "2024-03-02")]):
        spark.createDataFrame(rows, "complaint_id long, narrative string, at string") \
            .selectExpr("complaint_id", "narrative", "to_timestamp(at) AS at").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_dedup_stream(stream, f"{base}/out", f"{base}/ckpt", event_time="at", expiry="7 days")
    assert sorted(r.complaint_id for r in spark.read.parquet(f"{base}/out").collect()) == [1, 3, 5]


def test_summaries_of_accepted_rows_only(spark):
    base = tempfile.mkdtemp(prefix="narrata-test-", dir="/tmp")
    run_triage_stream(spark, "/root/testdata/sf0.001", f"{base}/out", f"{base}/ckpt",
                      glob="documents.parquet", summaries_path=f"{base}/sum")
    ids = {r.doc_id for r in spark.read.parquet(f"{base}/out").where("accepted").collect()}
    got = [r.doc_id for r in spark.read.parquet(f"{base}/sum").collect()]
    assert len(got) == len(set(got)) and set(got) == ids


def test_source_is_a_folder_of_files(spark):
    """A table of several files lies in a folder of the table's name."""
    base = tempfile.mkdtemp(prefix="narrata-test-", dir="/tmp")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(f"{base}/in/documents.parquet")
    docs.limit(5).write.parquet(f"{base}/in/other.parquet")  # is not read
    run_triage_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", glob="documents.parquet",
                      summaries_path=f"{base}/sum")
    got = spark.read.parquet(f"{base}/out")
    want = triage_rows(docs)
    assert got.count() == want.count() == 200
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert spark.read.parquet(f"{base}/sum").count() == got.where("accepted").count()
