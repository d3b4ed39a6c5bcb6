"""Quoted multi-line CSV read by many tasks.

Spark's own multi-line reader gives each file to one task. Here a file is
scanned in byte ranges, cut at line feeds by the text source:

1. every range counts its quotes; a prefix sum of the counts over a file's ranges
   tells whether a range begins inside a quoted field;
2. every range is scanned again from that state: records that lie within it are
   parsed in place; what is left at its borders (the end of a record begun
   before, the beginning of one that goes on) becomes fragments;
3. fragments, at most two a range, are put together by range order and parsed.

Records are arrays of fields. The first record of each file is its header, and
columns are found by name, so files may order their columns differently.

The format is RFC 4180: a field that holds a quote, a separator or a line feed
is quoted, and quotes within are doubled. Empty fields, quoted or not, are null.
Records end with LF or CRLF. Blank lines between records are skipped, a record
with too few fields has nulls, further ones are ignored; an empty file has no
records, a file of a header only no rows. A column absent from a file is null.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.session import broadcast_bounded, cut_lineage, ship_package

#: rows of a broadcast table with one row per range or file
MAX_RANGES = 2_000_000
_OUT = "file string, block long, first boolean, whole boolean, head boolean, text string, fields array<string>"


def parse(record: str, sep: str = ",") -> list[str | None]:
    """Fields of one record; empty ones are null."""
    csv.field_size_limit(2 ** 31 - 1)
    row = next(csv.reader([record], delimiter=sep), [])
    return [f if f else None for f in row]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")


def _scan(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at = None            # the range being read
        held: list[str] = []  # lines of the record being read
        inside = head = first = False

        def end_of_range() -> None:
            if held:  # a fragment: the record ends in a later range
                out.append((*at, first, False, head, "\n".join(held), None))

        for b in batches:
            for file, block, opened, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "opened", "value")), strict=True):
                if (file, block) != at:
                    end_of_range()
                    at, held, inside, head, first = (file, block), [], opened, opened, block == 0
                held.append(value)
                if value.count('"') % 2:
                    inside = not inside
                if inside:
                    continue
                text = "\n".join(held)
                if head:  # the end of a record that an earlier range began
                    out.append((*at, False, True, True, text, None))
                elif text.strip("\r"):
                    out.append((*at, first, True, False, None, parse(text.removesuffix("\r"), sep)))
                    first = False
                held, head = [], False
            if len(out) >= 512:
                yield _batch(out)
                out = []
        end_of_range()
        yield _batch(out)
    return run


_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("whole", pa.bool_()),
                     ("head", pa.bool_()), ("text", pa.string()), ("fields", pa.list_(pa.string()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def read_records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """file, first (the file's first record), fields: every record of the files."""
    ship_package(spark)
    quotes = _lines(spark, path).groupBy("file", "block").agg(
        F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = cut_lineage(quotes.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("opened")),
                        "csv-ranges")
    # one row per range; a map-side join, so the lines keep their order
    marked = _lines(spark, path).join(broadcast_bounded(state, MAX_RANGES), ["file", "block"])
    found = cut_lineage(marked.select("file", "block", "opened", "value").mapInArrow(_scan(sep), _OUT), "csv-records")
    inner = found.where("fields IS NOT NULL").select("file", "first", "fields")

    # a record's fragments: its beginning (a tail of a range) and all heads after it, up to the next beginning
    order = Window.partitionBy("file").orderBy("block", F.col("head").desc())
    pieces = found.where("fields IS NULL") \
        .withColumn("record", F.sum((~F.col("head")).cast("long")).over(order))
    joined = pieces.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"), F.max("first").alias("first"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "\n")

    def parse_rows(batches):
        for b in batches:
            texts = [t.removesuffix("\r") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("first"),
                                              pa.array([parse(t, sep) for t in texts], pa.list_(pa.string()))],
                                             names=["file", "first", "fields"])

    rest = joined.select("file", "first", whole.alias("text")).mapInArrow(
        parse_rows, "file string, first boolean, fields array<string>")
    return inner.unionByName(rest)


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",") -> DataFrame:
    """``columns`` of the files by header name, as strings."""
    records = cut_lineage(read_records(spark, path, sep), "csv-all")
    headers = records.where("first").select("file", F.col("fields").alias("names"))  # one row per file
    rows = records.where("NOT first").join(broadcast_bounded(headers, MAX_RANGES), "file")

    def value(name: str):
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.when((at > 0) & (at <= F.size("fields")), F.try_element_at("fields", F.nullif(at, F.lit(0)))).alias(name)

    return rows.select(*[value(c) for c in columns])
