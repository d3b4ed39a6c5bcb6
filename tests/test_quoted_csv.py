"""The range reader equals the one-task reader at every range size."""

import csv
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from narrata.sources.quoted_csv import read_csv

COLS = ["id", "a b", "text"]


def write(path, header, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        for r in rows:
            w.writerow([r[h] for h in header])


def some_rows(n, seed):
    r = random.Random(seed)
    def text():
        parts = [r.choice(['say "no"', "line\nfeed", "a,b", "é“x”", '"', "\n\n", "", "plain words", "x" * r.randrange(400)])
                 for _ in range(r.randrange(4))]
        return " ".join(parts)
    return [{"id": str(i), "a b": r.choice(["", "v", 'q"', "w\nz"]), "text": text()} for i in range(n)]


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_ranges_equal_the_one_task_reader(spark, size):
    base = tempfile.mkdtemp(prefix="narrata-csv-", dir="/tmp")
    write(f"{base}/one.csv", COLS, some_rows(120, 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_csv(spark, f"{base}/one.csv", COLS)
        want = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/one.csv")
        a, b = (sorted(map(tuple, d.collect()), key=str) for d in (got, want))
        assert len(a) == 120 and a == b
        if size == 64:
            n = spark.read.text(f"{base}/one.csv").select(F.col("_metadata.file_block_start")).distinct().count()
            assert n > 50  # many ranges, most records cross a border
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_map_by_name(spark):
    base = tempfile.mkdtemp(prefix="narrata-csv-", dir="/tmp")
    rows = some_rows(10, 2)
    write(f"{base}/1.csv", COLS, rows[:4])
    write(f"{base}/2.csv", ["text", "id", "a b"], rows[4:8], "\r\n")
    with open(f"{base}/3.csv", "w") as f:
        f.write('id,more\n8,x\n\n9\n"",y,z\n')  # a column less, a short record, a blank line, a long record
    write(f"{base}/4.csv", COLS, [])
    open(f"{base}/5.csv", "w").close()
    got = {r.id: r for r in read_csv(spark, base, COLS).collect()}
    assert set(got) == {*(str(i) for i in range(8)), "8", "9", None}
    for r in rows[:8]:
        assert (got[r["id"]]["a b"], got[r["id"]].text) == (r["a b"] or None, r["text"] or None)
    assert got["8"].text is None and got["9"].text is None
    assert read_csv(spark, f"{base}/4.csv", COLS).count() == 0 and os.path.exists(f"{base}/5.csv")
