"""Prepared rows kept by class, so that a new batch of one class rewrites that class only.

Two tables under one folder, both partitioned by ``_class`` ("c-" and the label, so that
no label is read back as a number or a null):

- ``rows``: the balanced rows of a class with their split;
- ``counts``: their histogram (split, issue group, priority, n).

A class's cap or oversampling, and its ranks in the split, depend on its own rows only, so
they are final in its files. Label codes depend on all classes; they aren't stored but
come from the histograms when the table is read. A write replaces the partitions of
the classes it holds (dynamic overwrite) and no other file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.fixed_values import MAX_PER_CLASS, MIN_PER_CLASS, RANDOM_SEED
from narrata.operators.labels import label_encoder
from narrata.operators.sampling import balance_classes, sample_k
from narrata.operators.split import stratified_split
from narrata.session import cut_lineage

ENCODED = ("product", "issue_group")
HISTOGRAM = ("product", "split", "issue_group", "priority")


def _partition(label) -> Column:
    return F.concat(F.lit("c-"), F.lit(label) if isinstance(label, str) else label)


class ClassTable:
    """The table at ``path``. Rows need the columns ``product``, ``issue_group``,
    ``priority`` and ``complaint_id``; rows without a product belong to no class and are
    not kept. At most ``max(max_per_class, min_per_class)`` rows of a class are
    stored, and one task writes a class's rows of one split."""

    def __init__(self, spark: SparkSession, path: str, max_per_class: int = MAX_PER_CLASS,
                 min_per_class: int = MIN_PER_CLASS, seed: int = RANDOM_SEED):
        self.spark, self.seed = spark, seed
        self.max, self.min = max_per_class, min_per_class
        self.rows, self.counts = f"{path}/rows", f"{path}/counts"

    def _write(self, df: DataFrame, path: str, *by: str) -> None:
        out = df.withColumn("_class", _partition(F.col("product")))
        (out.repartition("_class", *by).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("_class").parquet(path))

    def write(self, prepared: DataFrame) -> None:
        """Balance and split the classes of ``prepared`` and replace them in the table."""
        own = cut_lineage(prepared.where(F.col("product").isNotNull()), "class-rows")
        bal = cut_lineage(balance_classes(own, "product", self.max, self.min, self.seed), "class-balanced")
        done = cut_lineage(stratified_split(bal, "product", self.seed), "class-split")
        self._write(done, self.rows, "split")
        self._write(done.groupBy(*HISTOGRAM).agg(F.count(F.lit(1)).alias("n")), self.counts)

    def replace(self, product: str, new_rows: DataFrame) -> None:
        """One class's rows give way to a seeded sample of at most ``max_per_class``
        of ``new_rows``. Without new rows the class stays as it is, and the
        call fails: an empty fetch must not empty a class."""
        new = cut_lineage(new_rows.where(F.col("product") == product), "class-new")
        if new.isEmpty():
            raise ValueError(f"no new rows of class {product!r}")
        self.write(sample_k(new, self.max, self.seed, "complaint_id"))

    def histogram(self) -> DataFrame:
        """(product, split, issue_group, priority, n) of all classes: what the dataset
        statistics need, without a look at the rows."""
        return self.spark.read.parquet(self.counts).drop("_class")

    def encoder(self, col: str) -> DataFrame:
        """(label, code) over all classes, from the histograms."""
        return label_encoder(self.histogram(), col)

    def read(self, product: str | None = None) -> DataFrame:
        """Rows with the codes of ``ENCODED``; of one class, its files only."""
        df = self.spark.read.parquet(self.rows)
        if product is not None:
            df = df.where(F.col("_class") == _partition(product))
        for col in ENCODED:
            df = df.join(F.broadcast(self.encoder(col)), col, "left")
        return df.drop("_class")
