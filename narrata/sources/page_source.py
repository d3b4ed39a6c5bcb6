"""API pages as a Spark data source, in batch and as a stream.

Landed pages are files ``page-<number>.json`` in one folder, numbered from 0 without gaps
in the order of the page cursor (``from`` / ``size`` of the API); each file is one response
body. ``spark.read.format("api_pages")`` gives (page, body) for all of them,
``spark.readStream`` for those that arrive. The stream's offset is the cursor: the
number of the next page. A page counts as landed once it and all pages before it are
there, so a page that is written late is neither skipped nor read twice, and a
restart goes on at the cursor kept in the query's checkpoint. A gap in a batch read
ends it there as well.

Only page numbers and a folder path are in offsets and partitions; bodies are read by the
tasks, a range of pages each. Folders are reached through ``pyarrow.fs``, so
the path may be a URI of any file system it knows (a plain path or ``file:`` is one
that all executors share). Options: ``path``; ``pagesPerPartition`` (32). A batch takes
all pages that have landed, in as many tasks as that needs. There is no limit a batch: Spark
asks for the latest cursor without naming the last one, so a limit couldn't be kept over a
restart. Pages must stay in the folder, at least the numbers: a cursor only grows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from narrata.session import ship_package

SCHEMA = "page bigint, body string"
PREFIX, SUFFIX = "page-", ".json"


def page_name(page: int) -> str:
    return f"{PREFIX}{page:010d}{SUFFIX}"


def _filesystem(path: str):
    from pyarrow import fs
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def landed(path: str, start: int = 0) -> int:
    """The first page number from ``start`` on that isn't there, asked 256 names a call.
    Numbers below ``start`` are not looked at again."""
    from pyarrow import fs
    files, folder = _filesystem(path)
    while True:
        info = files.get_file_info([f"{folder}/{page_name(start + i)}" for i in range(256)])
        there = [i.type == fs.FileType.File for i in info]
        if not all(there):
            return start + there.index(False)
        start += len(there)


class PageRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _ranges(start: int, end: int, size: int) -> list[PageRange]:
    return [PageRange(p, min(p + size, end)) for p in range(start, end, size)]


def _bodies(path: str, part: PageRange) -> Iterator[tuple]:
    files, folder = _filesystem(path)
    for page in range(part.start, part.end):
        with files.open_input_stream(f"{folder}/{page_name(page)}") as f:
            yield page, f.read().decode("utf-8")


class _Options:
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.size = max(1, int(options.get("pagesPerPartition", 32)))


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self):
        # a read of no pages still needs one partition
        return _ranges(0, landed(self.o.path), self.o.size) or [PageRange(0, 0)]

    def read(self, partition):
        return _bodies(self.o.path, partition)


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.o = _Options(options)
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        self.seen = landed(self.o.path, self.seen)
        return {"page": self.seen}

    def partitions(self, start: dict, end: dict):
        return _ranges(start["page"], end["page"], self.o.size)

    def read(self, partition):
        return _bodies(self.o.path, partition)


class ApiPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "api_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(self.options)


def register_api_pages(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ApiPages)


def land_pages(pages: DataFrame, path: str, page: str = "page", body: str = "body") -> None:
    """Write page bodies to the folder, each by the task that holds it; a page is
    written under another name and moved when whole. Written again, it is replaced."""
    def write(batches):
        import pyarrow as pa
        files, folder = _filesystem(path)
        for batch in batches:
            n = 0
            for r in batch.to_pylist():
                target = f"{folder}/{page_name(r['page'])}"
                part = f"{folder}/_part-{r['page']:010d}"
                with files.open_output_stream(part) as f:
                    f.write(r["body"].encode("utf-8"))
                files.move(part, target)
                n += 1
            yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))
    ship_package(pages.sparkSession)
    files, folder = _filesystem(path.rstrip("/"))
    files.create_dir(folder, recursive=True)
    out = pages.selectExpr(f"{page} AS page", f"{body} AS body").mapInArrow(write, "n long")
    out.write.format("noop").mode("overwrite").save()
