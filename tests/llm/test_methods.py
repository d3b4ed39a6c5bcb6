"""That the methods act: line labels differ within documents, searches stop
early, the mixture's order reaches the pipeline's result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from narrata.llm import curriculum, line_crf, stable_ann
from narrata.llm.common import documents, materialise
from tests.conftest import SF01


@pytest.fixture(scope="module")
def crf(spark):
    return line_crf.train(documents(spark, SF01), documents(spark, SF01, "labels"))


def test_lines_are_labelled_not_documents(spark, crf):
    got = line_crf.judge(documents(spark, SF01).select("doc_id", "text"), crf).select("line_labels").collect()
    mixed = [r for r in got if "b" in r.line_labels and "c" in r.line_labels]
    assert len(mixed) >= 20


def test_line_accuracy_on_known_lines(crf):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abdeginorst") for _ in range(r.randrange(2, 9)))
    content = lambda: " ".join(word() for _ in range(r.randrange(10, 30))).capitalize() + "."
    menu = lambda: " | ".join(word() for _ in range(r.randrange(4, 9))) + " |"
    advert = lambda: " ".join(word().upper() + "!!" for _ in range(r.randrange(4, 9)))
    symbols = lambda: " ".join(word() + r.choice(["###", "$$$", "%%%", "***"]) for _ in range(r.randrange(4, 9)))
    right = n = 0
    for _ in range(300):
        junk = r.choice([menu, advert, symbols])
        lines = [junk(), junk(), *(content() for _ in range(8)), junk(), junk()]
        want = np.array([True] * 2 + [False] * 8 + [True] * 2)
        got = crf.viterbi(line_crf.scan("\n".join(lines).encode()).features)
        right, n = right + (got == want).sum(), n + len(want)
    assert right / n >= 0.9


def test_constraint_holds_for_every_document(crf):
    r = np.random.default_rng(2)
    for _ in range(200):
        x = r.random((r.integers(1, 12), len(line_crf.FEATURES)))
        x[:, 6] = 1 / r.integers(1, 40, len(x))
        size = np.rint(1 / x[:, 6])
        for good in (True, False):
            marks = line_crf.constrained(crf, x, good)
            assert (size[~marks].sum() >= 0.5 * size.sum()) == good


def test_searches_stop_early_on_clusters():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 64))[r.integers(0, 200, 20_000)] + 0.2 * r.normal(size=(20_000, 64))
    top = (x * x).sum(1).max() * (1 + 1e-9)
    axes = stable_ann.directions(64)
    q = x[::100]
    row, _, verified = stable_ann.search_block(x, stable_ann.project(x, top, axes), q, stable_ann.project(q, top, axes, True),
                                               np.full(len(q), -np.inf), 21, top, stable_ann.stop_quantile())
    true = np.argsort(-(q @ x.T), axis=1)[:, :21]
    recall = np.mean([len(set(a) & set(b)) / 21 for a, b in zip(row.tolist(), true.tolist(), strict=True)])
    assert verified / (len(q) * len(x)) < 0.3 and recall >= 0.9


def test_training_order_reaches_the_result(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (5 + i % 7)), "en", f"s{i % 3}", 1) for i in range(400)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        placed = materialise(corpus_pipeline.mixture(spark, docs, ""), "mix-test")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = corpus_pipeline.token_ids(spark, placed, "").orderBy("file_no", "row_no").collect()
    want = curriculum.train_order(curriculum.mix(docs)).orderBy("position", "doc_id", "copy").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in want] and len({r.file_no for r in got}) > 1
    loose = corpus_pipeline.token_ids(spark, docs, "")
    assert loose.count() == 400 and loose.where(F.col("file_no").isNotNull()).count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF01)
        assert docs.count() == 0, name
