"""What scoring holds and exchanges must not grow with a task's share of the table."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from narrata.operators import models as ml
from narrata.operators.row_scoring import SLICE, TermIndex, add_scores, in_slices
from narrata.plans.queries_models import _replayed
from narrata.session import BATCH_ROWS, scratch_path
from tests.test_models import _corpus


@pytest.fixture(scope="module")
def fitted(spark):
    rows = _corpus(spark)
    return rows, ml.fit_nb(ml.term_matrix(rows, ["y"], "row_id", values=("counts",)), "y")


def test_terms_of_many_documents_at_once():
    terms = ["a", "a b", "b", "ü c"]
    index = TermIndex(pa.array(terms), np.array([1.0, 2.0, 3.0, 4.0]))
    docs = [["a", "b", "a", "b"], [], None, ["x"], ["ü", "c", "ü", "c", "a"]] * 3
    got = index.encode(pa.array(docs, pa.list_(pa.string())))
    for i, d in enumerate(docs):
        d = d or []
        n = collections.Counter(t for t in d + [" ".join(p) for p in zip(d, d[1:])] if t in terms)
        w = {t: (1 + math.log(c)) * index.idf[terms.index(t)] for t, c in n.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        at = got.doc == i
        assert {terms[k]: c for k, c in zip(got.idx[at], got.tf[at])} == n
        assert {terms[k]: x for k, x in zip(got.idx[at], got.weight[at])} == pytest.approx({t: x / norm for t, x in w.items()})
    # rows of one document: no pair across them
    parts = index.encode(pa.array([[["a"], ["b"]], [["a", "b"]], None], pa.list_(pa.list_(pa.string()))))
    assert parts.doc.tolist() == [0, 0, 1, 1, 1] and parts.idx.tolist() == [0, 2, 0, 1, 2]


def test_a_task_works_on_few_documents(spark, fitted):
    """Arrow batches and the arrays beside them are bounded."""
    seen = []
    out = in_slices(lambda c: seen.append(len(c)) or c, pa.array(range(3 * SLICE + 1)))
    assert seen == [SLICE] * 3 + [1] and len(out) == 3 * SLICE + 1
    rows, clf = fitted
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 10_000)
    add_scores(rows, {"m": clf}, "narrative_clean")
    assert int(spark.conf.get(name)) <= BATCH_ROWS


def test_texts_are_exchanged_not_their_words(fitted):
    """(F13, F16) Nothing is tokenised before an exchange."""
    rows, clf = fitted
    given = rows.select("row_id", F.lit(0).alias("y_pred"))
    for df in (clf.predict(rows), ml.token_attribution(clf, rows, given)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" in plan
        assert "regexp_extract_all" not in plan[plan.index("Aggregate"):]


def test_landed_files_share_a_trigger(spark):
    """A file a trigger is a task at a time."""
    rows = spark.range(60).select(F.col("id").alias("row_id"), F.lit("x").alias("narrative_clean")).repartition(6)
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    q = _replayed(spark, rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 60 and q.lastProgress["batchId"] == 0
