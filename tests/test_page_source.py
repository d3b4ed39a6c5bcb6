"""Pages through the data source: batch, stream, restart, gaps."""

import pytest

from narrata.sources.page_source import _ranges, land_pages, landed, page_name, register_api_pages


def _land(spark, path, numbers):
    land_pages(spark.createDataFrame([(n, f'{{"n": "é{n}"}}') for n in numbers], "page long, body string"), path)


def test_landed_stops_at_a_gap(spark, tmp_path):
    path = str(tmp_path / "p")
    assert landed(path) == 0
    for n in list(range(600)) + [601]:
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / page_name(n)).write_text("{}")
    assert landed(path) == 600 == landed(path, 590)
    assert [(r.start, r.end) for r in _ranges(3, 8, 2)] == [(3, 5), (5, 7), (7, 8)] and _ranges(4, 4, 2) == []


def test_batch_and_restarted_stream(spark, tmp_path):
    path, out, ckpt = (str(tmp_path / x) for x in ("p", "out", "ckpt"))
    register_api_pages(spark)
    _land(spark, path, range(5))
    _land(spark, path, [7])

    def run():
        s = spark.readStream.format("api_pages").option("path", path).option("pagesPerPartition", 2).load()
        s.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True) \
            .start(out).awaitTermination()
        return sorted(r["page"] for r in spark.read.parquet(out).collect())

    assert run() == list(range(5))     # 7 waits for 5 and 6
    assert run() == list(range(5))     # nothing new: nothing twice
    _land(spark, path, [5, 6, 2])      # the gap closes; an old page is written again
    assert run() == list(range(8))
    batch = spark.read.format("api_pages").option("path", path).load()
    assert sorted(map(tuple, batch.collect())) == [(n, f'{{"n": "é{n}"}}') for n in range(8)]


def test_an_empty_folder_has_no_pages(spark, tmp_path):
    register_api_pages(spark)
    assert spark.read.format("api_pages").option("path", str(tmp_path)).load().collect() == []


def test_the_path_is_needed(spark):
    register_api_pages(spark)
    with pytest.raises(Exception):
        spark.read.format("api_pages").load().collect()
