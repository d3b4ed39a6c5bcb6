"""Model, summary and scoring queries.

Model training queries are property-checked (rows only): a fitted model
has no SQL twin. The TextRank summaries have a brute-force pairwise SQL
oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.fixed_values import MAX_PER_CLASS, MIN_PER_CLASS
from narrata.functions.text import round6
from narrata.operators import metrics as mt
from narrata.operators import models as ml
from narrata.operators.attention import train_attention
from narrata.operators.history import training_history
from narrata.operators.labels import encode_labels
from narrata.operators.row_scoring import add_scores
from narrata.operators.summarize import summarize, summarize_groups
from narrata.plans import oracle as o
from narrata.plans.catalog import register
from narrata.plans.prepare import filter_and_clean, prepare_cleaned
from narrata.plans.queries_core import SEED
from narrata.plans.score import score_rows, triage_batch
from narrata.session import cut_lineage, read_table, scratch_path
from narrata.sources.fixtures import complaints
from narrata.streaming.triage_stream import open_source

MAX_ITER = 1000  # the optimiser stops earlier by its tolerance


#: columns of the prepared complaints that fits and scoring read
PREPARED = ("narrative", "narrative_clean", "product", "issue_group")


def _all_rows(spark, sf, columns=PREPARED):
    """Every prepared complaint: what the scoring queries score. Only the fit
    uses the balanced sample, at most ``MAX_PER_CLASS`` rows per class. Written
    once: the scan, the dedup by text and the cleaning serve sample and scoring."""
    rows = filter_and_clean(complaints(spark, sf)).select("complaint_id", *columns)
    return cut_lineage(rows, "prepared").withColumn("row_id", F.col("complaint_id"))


def _splits(rows):
    """Train and test rows of the balanced sample: each complaint once a split,
    with ``copies``, the number of its draws (an oversampled class is a few
    texts drawn many times). Written once: fits and evaluation read them often."""
    df = prepare_cleaned(rows.drop("row_id"), MAX_PER_CLASS, MIN_PER_CLASS, SEED)
    keep = ["narrative", "narrative_clean", "product", "product_encoded", "issue_group", "issue_group_encoded"]
    once = ml.distinct_rows(df.withColumn("_k", F.struct("split", "complaint_id")), "_k", keep)
    return cut_lineage(once.select("_k.split", F.col("_k.complaint_id").alias("row_id"), *keep, "copies"), "splits")


def _test_rows(df):
    """The test split, one row a draw again."""
    return df.where("split = 'test'").withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def _metrics(df, clf, label):
    """Metrics over the drawn test rows; a text is scored once."""
    scored = add_scores(df.where("split = 'test'"), {"m": clf}, "narrative_clean") \
        if isinstance(clf, ml.TextClassifier) else clf.add_scores(df.where("split = 'test'"), "m")
    judged = scored.select(F.col("m.y_pred").alias("y_pred"), F.col(label).alias("y_true"), "copies", F.lit("test").alias("split"))
    m = mt.classification_metrics(_test_rows(judged))
    return m.select(*[round6(c).alias(c) if c != "n" else F.col(c) for c in m.columns])


def _matrix(df, *values):
    """One term matrix of the training texts for every classifier; ``values`` names the vectors they read."""
    return ml.term_matrix(df.where("split = 'train'"), ["product_encoded", "issue_group_encoded"], "row_id",
                          "narrative_clean", copies="copies", values=values or ("counts", "features"))


def _fit_lr(rows, label="product_encoded"):
    df = _splits(rows)
    return df, ml.fit_lr(_matrix(df, "features"), label, max_iter=MAX_ITER)


def _fit_word2vec(df):
    return ml.train_word2vec_lr(df.where("split = 'train'"), "product_encoded", "row_id", max_iter=MAX_ITER,
                                copies="copies")


@register("train_product")
def q_train_product(spark, sf):
    df, clf = _fit_lr(_all_rows(spark, sf))
    return _metrics(df, clf, "product_encoded")


@register("train_issue_group")
def q_train_issue_group(spark, sf):
    df, clf = _fit_lr(_all_rows(spark, sf), "issue_group_encoded")
    return _metrics(df, clf, "issue_group_encoded")


@register("predict_batch")
def q_predict_batch(spark, sf):
    """Every prepared complaint scored inside its row: no exchange after the fit."""
    rows = _all_rows(spark, sf)
    _, clf = _fit_lr(rows)
    p = add_scores(rows, {"m": clf}, "narrative_clean")
    return p.select("row_id", F.col("m.y_pred").alias("y_pred"), round6("m.confidence").alias("confidence"),
                    F.size("m.proba").alias("n_classes"))


@register("train_word2vec")
def q_train_word2vec(spark, sf):
    df = _splits(_all_rows(spark, sf))
    return _metrics(df, _fit_word2vec(df), "product_encoded")


def _fit_attention(df):
    return train_attention(df.where("split = 'train'"), df.where("split = 'val'"), "product_encoded", copies="copies")


@register("train_attention")
def q_train_attention(spark, sf):
    """The early-stopped training run of the attention classifier, epoch by epoch."""
    rows = training_history(_fit_attention(_splits(_all_rows(spark, sf))).history_frame(spark))
    floats = ["train_loss", "val_loss", "val_f1_macro", "val_accuracy", "best_so_far"]
    return rows.select("run", "epoch", *[round6(c).alias(c) for c in floats], "improved", "since_best", "stop")


@register("attention_metrics")
def q_attention_metrics(spark, sf):
    """Test metrics of the attention classifier's best epoch."""
    df = _splits(_all_rows(spark, sf))
    return _metrics(df, _fit_attention(df), "product_encoded")


@register("train_nb")
def q_train_nb(spark, sf):
    df = _splits(_all_rows(spark, sf))
    return _metrics(df, ml.fit_nb(_matrix(df, "counts"), "product_encoded"), "product_encoded")


def _names(df, col="product"):
    rows = df.select(col, f"{col}_encoded").distinct().orderBy(f"{col}_encoded").collect()
    return [r[col] for r in rows]  # one row per class


def _fit_all(df, matrix, **more):
    """The three product models of one training split, and ``more`` fits."""
    return ml.fit_together({"baseline": lambda: ml.fit_lr(matrix, "product_encoded", max_iter=MAX_ITER),
                            "naive_bayes": lambda: ml.fit_nb(matrix, "product_encoded"),
                            "word2vec": lambda: _fit_word2vec(df), **more})


@register("train_compare")
def q_train_compare(spark, sf):
    """Train every model, predict the test split in one pass, compare: one row a model."""
    df = _splits(_all_rows(spark, sf))
    models = _fit_all(df, _matrix(df))
    scored = score_rows(df.where("split = 'test'"), models, "narrative_clean")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"{n}.y_pred").alias("y_pred")) for n in models]))
    return mt.compare_models(_test_rows(scored).select(each.alias("p"), F.col("product_encoded").alias("y_true"))
                             .select("p.model", "p.y_pred", "y_true"))


def _replayed(spark, rows):
    """``rows`` as a stream of landed files, many a trigger: their tasks run side by side."""
    landed = scratch_path(spark, "score-in")
    rows.write.parquet(landed)
    return open_source(spark, landed, rows.schema)


@register("score_stream")
def q_score_stream(spark, sf):
    """The prepared complaints replayed as a file stream, scored inside the row."""
    prepared = _all_rows(spark, sf)
    models = {"naive_bayes": ml.fit_nb(_matrix(_splits(prepared), "counts"), "product_encoded")}
    stream, out = _replayed(spark, prepared.select("row_id", "narrative_clean")), scratch_path(spark, "score-out")
    scored = score_rows(stream, models, "narrative_clean").select(
        "row_id", F.col("naive_bayes.y_pred").alias("y_pred"), round6("naive_bayes.confidence").alias("confidence"))
    scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "score-ckpt")) \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


@register("top_features")
def q_top_features(spark, sf):
    df, clf = _fit_lr(_all_rows(spark, sf))
    return ml.top_features(clf, _names(df), 20)


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    test = _all_rows(spark, sf)
    df, clf = _fit_lr(test)
    path = scratch_path(spark, "model")
    clf.save(path)
    ml.save_labels(_names(df), spark, path)
    back = ml.TextClassifier.load(spark, path, "row_id", "narrative_clean")
    labels = F.array(*[F.lit(x) for x in ml.load_labels(spark, path)])
    names = F.array(*[F.lit(x) for x in _names(df)])
    a = clf.predict(test).select("row_id", F.element_at(names, F.col("y_pred") + 1).alias("a"), F.col("confidence").alias("ca"))
    b = back.predict(test).select("row_id", F.element_at(labels, F.col("y_pred") + 1).alias("b"), F.col("confidence").alias("cb"))
    j = a.join(b, "row_id")
    return j.agg(F.count(F.lit(1)).alias("n"),
                 F.sum((F.col("a") == F.col("b")).cast("int")).alias("same_class"),
                 F.max(F.abs(F.col("ca") - F.col("cb"))).alias("max_conf_diff"))


@register("token_attribution")
def q_token_attribution(spark, sf):
    test = _all_rows(spark, sf)
    df, clf = _fit_lr(test)
    att = ml.token_attribution(clf, test, clf.predict(test))
    return att.select("row_id", "pos", "token", round6("weight").alias("weight"))


@register("triage_batch")
def q_triage_batch(spark, sf):
    prepared = _all_rows(spark, sf)
    df = _splits(prepared)
    matrix = _matrix(df)
    models = _fit_all(df, matrix, issue=lambda: ml.fit_lr(matrix, "issue_group_encoded", max_iter=MAX_ITER))
    issue = models.pop("issue")
    rows = prepared.select("row_id", "narrative", "narrative_clean")
    return triage_batch(rows, models, _names(df), "row_id",
                        issue_model=issue, issue_names=_names(df, "issue_group"))


# --------------------------------------------------------------------------
# naive Bayes has a closed form: parameters, predictions and attributions in SQL
# --------------------------------------------------------------------------

_NB = f"""WITH {o.filtered_ctes()},
docs AS (SELECT complaint_id AS id, product,
                regexp_extract_all(lower(strip_accents(narrative_clean)), '[\\p{{L}}\\p{{N}}_]+') AS t FROM prep),
terms AS (SELECT id, product, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1),
                                                                   lambda i: t[i] || ' ' || t[i + 1]))) AS term
          FROM docs),
tf AS (SELECT id, product, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS big_n FROM docs),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
top AS (SELECT term, df, ln((1 + big_n) / (1 + df)) + 1 AS idf FROM st, n
        WHERE df >= 5 AND df <= 0.95 * big_n ORDER BY total DESC, term LIMIT 50000),
cl AS (SELECT product, CAST(row_number() OVER (ORDER BY product) - 1 AS INTEGER) AS cls, count(*) AS nc
       FROM prep GROUP BY product),
wt AS (SELECT cl.*, big_n / ((SELECT count(*) FROM cl) * CAST(nc AS DOUBLE)) AS w FROM cl, n),
ct AS (SELECT cls, term, sum(tf) * w AS s FROM tf JOIN top USING (term) JOIN wt USING (product) GROUP BY cls, term, w),
tot AS (SELECT cls, sum(s) + (SELECT count(*) FROM top) AS t FROM ct GROUP BY cls),
th AS (SELECT wt.product, cls, term, ln(coalesce(s, 0) + 1) - ln(t) AS lp
       FROM wt CROSS JOIN top JOIN tot USING (cls) LEFT JOIN ct USING (cls, term)),
sc AS (SELECT id, cls, sum(tf * lp) AS s FROM tf JOIN th USING (term) GROUP BY ALL),
al AS (SELECT docs.id, wt.cls, coalesce(s, 0) AS s, max(coalesce(s, 0)) OVER (PARTITION BY docs.id) AS m
       FROM docs CROSS JOIN wt LEFT JOIN sc ON sc.id = docs.id AND sc.cls = wt.cls),
pd AS (SELECT id, min(cls) FILTER (WHERE s = m) AS y_pred, 1 / sum(exp(s - m)) AS confidence FROM al GROUP BY id)"""


def _closed_nb(spark, sf):
    """Naive Bayes on every prepared complaint, saved and loaded again."""
    df = _all_rows(spark, sf, ("product", "narrative_clean")).drop("complaint_id")
    df = cut_lineage(encode_labels(df, ("product",)))
    clf = ml.fit_nb(ml.term_matrix(df, ["product_encoded"], "row_id", values=("counts",)), "product_encoded")
    path = scratch_path(spark, "bayes")
    clf.save(path)
    return df, ml.TextClassifier.load(spark, path, "row_id", "narrative_clean")


@register("nb_parameters", _NB + "\nSELECT cls, term, round(lp, 6) AS log_prob FROM th")
def q_nb_parameters(spark, sf):
    """Log probability of every vocabulary term in every class."""
    _, clf = _closed_nb(spark, sf)
    terms = clf.vocab.select("idx", "term")
    return ml.coefficient_table(clf).join(F.broadcast(terms), "idx").select(
        "cls", "term", round6("coef").alias("log_prob"))


@register("nb_top_features", _NB + """
SELECT product AS label, CAST(row_number() OVER (PARTITION BY product ORDER BY round(lp, 9) DESC, term) AS INTEGER) AS rank,
       term, round(lp, 6) AS log_prob FROM th QUALIFY rank <= 20""")
def q_nb_top_features(spark, sf):
    """The ranking step of the model report over the naive Bayes parameters."""
    df, clf = _closed_nb(spark, sf)
    return ml.top_features(clf, _names(df), digits=9).select("label", "rank", "term", round6("coef").alias("log_prob"))


@register("nb_predict", _NB + """
SELECT id AS row_id, y_pred, round(confidence, 6) AS confidence FROM pd""")
def q_nb_predict(spark, sf):
    """Predictions of the loaded naive Bayes model inside the row."""
    df, clf = _closed_nb(spark, sf)
    return add_scores(df, {"m": clf}, "narrative_clean").select(
        "row_id", F.col("m.y_pred").alias("y_pred"), round6("m.confidence").alias("confidence"))


@register("nb_attribution", _NB + f""",
wd AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN top USING (term)),
nw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM wd),
raw AS (SELECT complaint_id AS id, {o.tokens_sql('narrative_clean')} AS t FROM prep),
tk AS (SELECT id, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS token FROM raw),
ts AS (SELECT tk.id, pos, token, coalesce(lp * w, 0) AS s FROM tk JOIN pd USING (id)
       LEFT JOIN nw ON nw.id = tk.id AND nw.term = strip_accents(token)
       LEFT JOIN th ON th.cls = y_pred AND th.term = nw.term)
SELECT id AS row_id, CAST(pos - 1 AS INTEGER) AS pos, token,
       round(exp(s - max(s) OVER d) / sum(exp(s)) OVER d * exp(max(s) OVER d), 6) AS weight
FROM ts WINDOW d AS (PARTITION BY id)""")
def q_nb_attribution(spark, sf):
    """Token weights of the predicted class, a softmax over each text."""
    df, clf = _closed_nb(spark, sf)
    pred = add_scores(df, {"m": clf}, "narrative_clean").select("row_id", F.col("m.y_pred").alias("y_pred"))
    return ml.token_attribution(clf, df, pred).select("row_id", "pos", "token", round6("weight").alias("weight"))


# --------------------------------------------------------------------------
# summaries (pairwise brute-force SQL oracle)
# --------------------------------------------------------------------------

@register("textrank_docs", "WITH src AS (SELECT conv_id * 100000 + turn AS id, text FROM conversations),\n"
          + o.textrank_sql("src") + "\nSELECT id, summary FROM summ")
def q_textrank_docs(spark, sf):
    c = read_table(spark, sf, "conversations")
    src = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    return summarize(src, "id", "text", 2)


@register("textrank_category", f"""WITH {o.filtered_ctes()},
cat AS (SELECT product, narrative, row_number() OVER (PARTITION BY product ORDER BY complaint_id) AS r
        FROM prep WHERE narrative IS NOT NULL),
src AS (SELECT product AS id, string_agg(narrative, ' ' ORDER BY r) AS text FROM cat WHERE r <= 50
        GROUP BY product),
""" + o.textrank_sql("src") + """
SELECT s.id AS product, CASE WHEN length(regexp_replace(src.text, '^\\s+|\\s+$', '', 'g')) < 100
       THEN 'Insufficient text for summarization.' ELSE s.summary END AS summary
FROM summ s JOIN src USING (id)""")
def q_textrank_category(spark, sf):
    prep = filter_and_clean(complaints(spark, sf))
    return summarize_groups(prep, "product", "complaint_id", "narrative", 50, 2)


@register("textrank_category_all")
def q_textrank_category_all(spark, sf):
    """Summaries of each category over all its texts. SQL over all pairs of a category's
    sentences takes minutes even at sf0.01; tests hold the ranks against such pairs."""
    prep = filter_and_clean(complaints(spark, sf)).select("product", "complaint_id", "narrative")
    return summarize_groups(prep, "product", "complaint_id", "narrative", None, 2)
