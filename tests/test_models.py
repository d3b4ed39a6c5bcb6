"""Model properties on a small separable corpus."""

import tempfile

from pyspark.sql import functions as F

from narrata.operators import models as ml

# FIXED VALUES: two classes with disjoint vocabularies
WORDS = {0: ["mortgage", "escrow", "payment", "loan", "house"],
         1: ["card", "charge", "fraud", "merchant", "refund"]}


def _corpus(spark):
    rows = []
    for i in range(60):
        c = i % 2
        ws = WORDS[c]
        text = " ".join(ws[(i + k) % 5] for k in range(8))
        rows.append((i, text, c))
    return spark.createDataFrame(rows, "row_id long, narrative_clean string, y int")


def test_lr_separates_and_probabilities_sum_to_one(spark):
    df = _corpus(spark)
    clf = ml.train_tfidf_lr(df, "y", "row_id", "narrative_clean", max_iter=30, min_df=2)
    p = clf.predict(df).join(df, "row_id")
    assert p.where(F.col("y_pred") != F.col("y")).count() == 0
    sums = p.select(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    top = {r["label"]: r["term"] for r in ml.top_features(clf, ["a", "b"], 1).collect()}
    assert top["a"] in " ".join(WORDS[0]) and top["b"] in " ".join(WORDS[1])


def test_model_save_load_same_predictions(spark):
    df = _corpus(spark)
    clf = ml.train_tfidf_lr(df, "y", "row_id", "narrative_clean", max_iter=10, min_df=2)
    path = tempfile.mkdtemp(prefix="narrata-model-", dir="/tmp")
    clf.save(path)
    back = ml.TextClassifier.load(spark, path, "row_id", "narrative_clean")
    a = clf.predict(df).select("row_id", "y_pred", "confidence")
    b = back.predict(df).select("row_id", "y_pred", "confidence")
    assert a.exceptAll(b).count() == 0


def test_naive_bayes_separates(spark):
    df = _corpus(spark)
    clf = ml.train_tfidf_nb(df, "y", "row_id", "narrative_clean", min_df=2)
    p = clf.predict(df).join(df, "row_id")
    assert p.where(F.col("y_pred") != F.col("y")).count() == 0


def test_every_model_restores(spark):
    df = _corpus(spark)
    nb = ml.train_tfidf_nb(df, "y", "row_id", "narrative_clean", min_df=2)
    w2v = ml.train_word2vec_lr(df, "y", "row_id", dims=8, min_count=1, max_iter=20, epochs=2)
    for clf in (nb, w2v):
        path = tempfile.mkdtemp(prefix="narrata-model-", dir="/tmp")
        clf.save(path)
        ml.save_labels(["a", "b"], spark, path)
        back = type(clf).load(spark, path, "row_id", "narrative_clean")
        assert clf.predict(df).select("row_id", "y_pred").exceptAll(back.predict(df).select("row_id", "y_pred")).count() == 0
        assert ml.load_labels(spark, path) == ["a", "b"]


def test_naive_bayes_fits_counts(spark):
    df = _corpus(spark)
    nb = ml.train_tfidf_nb(df, "y", "row_id", "narrative_clean", min_df=2)
    sizes = [sum(r["features"].values) for r in nb.features(df).collect()]
    assert sizes == [15.0] * 60  # eight words and seven pairs a text


def test_triage_uses_the_issue_model_and_reports_absent_models(spark):
    from narrata.plans.score import triage_batch
    import json
    df = _corpus(spark).withColumn("narrative", F.col("narrative_clean"))
    clf = ml.train_tfidf_nb(df, "y", "row_id", "narrative_clean", min_df=2)
    rows = triage_batch(df, {"nb": clf, "deep": None}, ["home", "card"], "row_id",
                        issue_model=clf, issue_names=["g0", "g1"]).collect()
    assert len(rows) == 60
    for r in rows:
        assert r["nb_prediction"] == ["home", "card"][r["row_id"] % 2]
        assert r["issue_group"] == f"g{r['row_id'] % 2}" and r["most_confident_model"] == "nb"
        got = json.loads(r["results"])
        assert got["deep"]["error"] and got["nb"]["prediction"] == r["nb_prediction"]
    ruled = triage_batch(df, {"nb": None}, ["home", "card"], "row_id").collect()
    assert len(ruled) == 60 and {r["issue_confidence"] for r in ruled} == {0.6}
