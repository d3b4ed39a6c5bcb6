"""Weighted copies, in-row scoring, and the trained attention classifier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.operators import attention as att
from narrata.operators import models as ml
from narrata.operators.features import documents_by_id, term_statistics, tfidf_terms
from narrata.operators.history import training_history
from narrata.operators.row_scoring import add_scores
from narrata.session import scratch_path
from tests.test_models import _corpus


@pytest.fixture(scope="module")
def copied(spark):
    """Texts with multiplicities, and the same table with real copies."""
    once = _corpus(spark).withColumn("copies", 1 + F.col("row_id") % 4)
    twice = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))) \
        .withColumn("row_id", F.col("row_id") * 10 + F.col("k")).drop("copies", "k")
    return once.cache(), twice.cache()


def test_copies_are_weights(copied):
    once, twice = copied
    a = ml.term_matrix(once, ["y"], "row_id", copies="copies")
    b = ml.term_matrix(twice, ["y"], "row_id")
    va, vb = ([(r.term, r.df, r.idx, round(r.idf, 12)) for r in m.vocab.orderBy("idx").collect()] for m in (a, b))
    assert va == vb and a.n_features == b.n_features == len(va)
    fa, fb = (ml.fit_lr(m, "y", max_iter=400, tol=1e-12).model for m in (a, b))
    assert np.abs(fa.coefficientMatrix.toArray() - fb.coefficientMatrix.toArray()).max() < 1e-6
    na, nb = (ml.fit_nb(m, "y").model for m in (a, b))
    assert np.abs(na.theta.toArray() - nb.theta.toArray()).max() < 1e-9


def test_scores_in_the_row_equal_predict(spark, copied):
    once, _ = copied
    m = ml.term_matrix(once, ["y"], "row_id", copies="copies")
    models = {"lr": ml.fit_lr(m, "y", max_iter=30), "nb": ml.fit_nb(m, "y")}
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "words nobody knows"), (903, "Cárd fraud” fraud")],
                                  "row_id long, narrative_clean string")
    rows = once.select("row_id", "narrative_clean").union(extra)
    scored = add_scores(rows, models, "narrative_clean")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    got = {r.row_id: r for r in scored.collect()}
    assert len(got) == 64
    for name, clf in models.items():
        for p in clf.predict(rows).collect():
            mine = got[p.row_id][name]
            assert mine.y_pred == p.y_pred and np.allclose(mine.proba, p.proba, atol=1e-12)


def test_terms_are_weighed_inside_the_row(spark):
    """Rows of one id are one document; words are exchanged with their text and as sums only."""
    rows = [(1, "a b a b"), (1, "b c"), (2, "a b"), (2, None), (3, ""), (None, "c c"), (None, "a")]
    df = spark.createDataFrame(rows, "id long, text string")
    stats = term_statistics(documents_by_id(df, "id", "text"))
    assert "id" not in stats._jdf.queryExecution().analyzed().toString().split("\n")[0]
    got = {r["term"]: (r["df"], r["total"]) for r in stats.collect()}
    assert got == {"a": (3, 4), "b": (2, 4), "c": (2, 3), "a b": (2, 3), "b a": (1, 1), "b c": (1, 1), "c c": (1, 1)}
    terms = tfidf_terms(df, "id", "text", min_df=2)
    assert "Window" not in terms._jdf.queryExecution().optimizedPlan().toString()
    tf = {(r["id"], r["term"]): r["tf"] for r in terms.collect()}
    assert tf == {(1, "a"): 2, (1, "b"): 3, (1, "c"): 1, (1, "a b"): 2, (2, "a"): 1, (2, "b"): 1, (2, "a b"): 1,
                  (None, "a"): 1, (None, "c"): 2}


def test_attribution_inside_the_row(spark, copied):
    once, _ = copied
    clf = ml.train_tfidf_nb(once, "y", "row_id", copies="copies")
    rows = spark.createDataFrame([(1, "cárd fraud unknown card"), (2, ""), (3, None), (None, "card")],
                                 "row_id long, narrative_clean string")
    att = ml.token_attribution(clf, rows, clf.predict(rows))
    assert "Window" not in att._jdf.queryExecution().optimizedPlan().toString()
    got = {r["pos"]: (r["token"], r["weight"]) for r in att.where("row_id = 1").collect()}
    assert att.count() == 4 and [got[i][0] for i in range(4)] == ["cárd", "fraud", "unknown", "card"]
    coef = clf.model.theta.toArray()[1]
    f = {r["term"]: coef[r["idx"]] * r["weight"] for r in tfidf_terms(rows, "row_id", "narrative_clean", vocab=clf.vocab).where("row_id = 1").collect()}
    s = np.exp([f["card"], f["fraud"], 0.0, f["card"]])
    assert np.allclose([got[i][1] for i in range(4)], s / s.sum(), atol=1e-12)


def test_scores_on_a_stream(spark, copied):
    once, _ = copied
    clf = ml.train_tfidf_nb(once, "y", "row_id", copies="copies")
    src, out = scratch_path(spark, "score-in"), scratch_path(spark, "score-out")
    once.select("row_id", "narrative_clean", "y").write.parquet(src)
    stream = spark.readStream.schema("row_id long, narrative_clean string, y int").parquet(src)
    q = add_scores(stream, {"m": clf}, "narrative_clean").select("row_id", "y", "m.y_pred").writeStream \
        .format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "score-ck")) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 60 and all(r.y == r.y_pred for r in rows)


def test_gradient_matches_differences():
    r = np.random.default_rng(0)
    p = att.initial(12, 3, 5, 1)
    ids, y, w = r.integers(0, 12, (6, 7)), r.integers(0, 3, 6), r.random(6) + .5
    ids[2] = 0  # a text without tokens
    _, g, tokens = att.gradient(p, ids, y, w)
    for k in p:
        full = np.zeros_like(p[k])
        full[tokens if k == "E" else ...] = g[k]
        for i in np.ndindex(*p[k].shape):
            if k == "E" and i[0] == 0:
                continue
            lo, hi = ({n: x.copy() for n, x in p.items()} for _ in range(2))
            lo[k][i] -= 1e-6
            hi[k][i] += 1e-6
            diff = (att.gradient(hi, ids, y, w)[0] - att.gradient(lo, ids, y, w)[0]) / 2e-6
            assert abs(diff - full[i]) < 1e-5


def test_forward_computes_each_token_once():
    r = np.random.default_rng(2)
    p = att.initial(20, 3, 5, 1)
    ids = r.integers(0, 20, (8, 50))  # tokens come often, padding stands between them
    ids[3], ids[ids == 7] = 0, 8
    tokens, x, h, a, share, context, q = att.forward(p, ids)
    assert tokens.tolist() == sorted(set(ids.ravel().tolist()) - {0}) and len(x) == len(h) == len(tokens)
    weights = att.token_weights(ids, tokens, a)
    for i, row in enumerate(ids):  # place by place
        e = np.exp(np.tanh(p["E"][row] @ p["W"] + p["b"]) @ p["v"]) * (row > 0)
        want = e / e.sum() if e.any() else e
        logits = (want @ p["E"][row]) @ p["U"].T + p["c"]
        assert np.allclose(weights[i], want) and np.allclose(context[i], want @ p["E"][row])
        assert np.allclose(share[i].sum(), want.sum()) and np.allclose(q[i], np.exp(logits) / np.exp(logits).sum())
    none = att.forward(p, np.zeros((2, 4), dtype=np.int64))
    assert len(none[0]) == 0 and not none[-2].any() and np.allclose(none[-1].sum(axis=1), 1)


def test_steps_sum_over_tasks(spark, monkeypatch):
    r = np.random.default_rng(1)
    p = att.initial(1300, 2, 4, 1)  # several parameter blocks
    rows = [([int(x) for x in r.integers(0, 1300, 6)], int(r.integers(0, 2)), float(r.random())) for _ in range(40)]
    df = spark.createDataFrame(rows, "ids array<int>, label int, weight double").repartition(5)
    want_loss, g, tokens = att.gradient(p, np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]))
    for fan in (64, 2):  # one level of sums, two levels
        monkeypatch.setattr(att, "FAN_IN", fan)
        loss, weight, got = att.step_gradient(df, p)
        assert np.isclose(loss, want_loss) and np.isclose(weight, sum(x[2] for x in rows))
        assert np.allclose(got["E"][tokens], g["E"]) and all(np.allclose(got[k], g[k]) for k in "WbvUc")


def test_attention_trains_stops_and_weighs(spark, copied):
    once, _ = copied
    kinds = once.withColumn("narrative_clean", F.concat("narrative_clean", F.lit(" the of and the")))
    clf = att.train_attention(kinds, kinds, "y", copies="copies", dims=16, n_batches=2, epochs=15, patience=2, max_len=12)
    h = training_history(clf.history_frame(spark), patience=2).orderBy("epoch").collect()
    assert [x.epoch for x in h] == list(range(1, len(h) + 1)) and len(h) < 15  # stopped early
    assert h[-1].stop and max(x.val_f1_macro for x in h) == 1.0 and h[-1].train_loss < h[0].train_loss
    rows = clf.add_scores(kinds, "m").collect()
    assert all(r.m.y_pred == r.y and len(r.m.weights) == 12 and abs(sum(r.m.weights) - 1) < 1e-9 for r in rows)
    none = clf.add_scores(spark.createDataFrame([(None,), ("",)], "narrative_clean string"), "m").collect()
    assert all(len(r.m.weights) == 0 and abs(sum(r.m.proba) - 1) < 1e-9 for r in none)
