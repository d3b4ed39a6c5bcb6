"""Evaluation queries over the prediction fixtures (F-pred, F-models,
F-pred-big): scores, confusion matrices, metrics, reports, errors,
histories, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions.text import round6
from narrata.operators import errors as er
from narrata.operators import history as hi
from narrata.operators import metrics as mt
from narrata.operators.labels import decode_labels
from narrata.operators.pooling import attention_pool, normalize_weights, top_probabilities
from narrata.plans import oracle as o
from narrata.plans.catalog import register
from narrata.session import read_table
from narrata.sources import fixtures as fx
from narrata.sources.metrics_store import metrics_roundtrip

LABELS = fx.PRED_LABELS
MODELS = [m for m, _ in fx.MODEL_SCALES]
_P = f"WITH {fx.predictions_sql()}"
_M = f"WITH {fx.models_sql()}"
_B = f"WITH {fx.big_predictions_sql()}"
_LAB = o.values_cte("lab", ["code", "label"], list(enumerate(LABELS)))


def _pred(spark, sf):
    return fx.predictions(spark, sf)


def _r6(df, cols):
    return df.select(*[round6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("softmax_scores", _P + """
SELECT id, y_true, y_pred, round(confidence, 6) AS confidence, round(list_sum(proba), 6) AS p_sum
FROM pred""")
def q_softmax(spark, sf):
    p = _pred(spark, sf)
    return p.select("id", "y_true", "y_pred", round6("confidence").alias("confidence"),
                    round6(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)).alias("p_sum"))


@register("confusion_matrix", _P + """,
cnt AS (SELECT y_true AS t, y_pred AS p, count(*) AS n FROM pred GROUP BY ALL),
cls AS (SELECT t AS c FROM cnt UNION SELECT p FROM cnt)
SELECT a.c AS t, b.c AS p, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM cls a, cls b LEFT JOIN cnt ON cnt.t = a.c AND cnt.p = b.c""")
def q_confusion_matrix(spark, sf):
    return mt.confusion_matrix(_pred(spark, sf))


@register("confusion_normalized", _P + """,
cnt AS (SELECT y_true AS t, y_pred AS p, count(*) AS n FROM pred GROUP BY ALL),
cls AS (SELECT t AS c FROM cnt UNION SELECT p FROM cnt),
cm AS (SELECT a.c AS t, b.c AS p, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
       FROM cls a, cls b LEFT JOIN cnt ON cnt.t = a.c AND cnt.p = b.c)
SELECT t, p, n, round(n / nullif(sum(n) OVER (PARTITION BY t), 0), 6) AS share FROM cm""")
def q_confusion_normalized(spark, sf):
    cm = mt.confusion_normalized(mt.confusion_matrix(_pred(spark, sf)))
    return _r6(cm, ["share"])


_METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]


@register("classification_metrics", _P + ",\n" + o.per_class_ctes("pred") + "\n"
          + o.summary_select())
def q_classification_metrics(spark, sf):
    return _r6(mt.classification_metrics(_pred(spark, sf)), _METRICS)


@register("metrics_big", _B + ",\n" + o.per_class_ctes("bigp") + "\n" + o.summary_select())
def q_metrics_big(spark, sf):
    return _r6(mt.classification_metrics(fx.big_predictions(spark, sf)), _METRICS)


@register("per_class_f1", _P + ",\n" + o.per_class_ctes("pred") + """
SELECT cls, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM pc""")
def q_per_class_f1(spark, sf):
    return _r6(mt.per_class(_pred(spark, sf)), ["precision", "recall", "f1"])


def _rh(x):
    return o.round_half_up_sql(x, 2)


@register("class_report", _P + ",\n" + o.per_class_ctes("pred") + f""",
{_LAB},
t AS (SELECT sum(support) AS s, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
             sum(f1 * support) / sum(support) AS wf FROM pc)
SELECT lab.label AS row, {_rh('precision')} AS precision, {_rh('recall')} AS recall, {_rh('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM pc JOIN lab ON lab.code = pc.cls
UNION ALL SELECT 'accuracy', NULL, NULL, {_rh('CAST(tp AS DOUBLE) / s')}, CAST(s AS BIGINT) FROM t
UNION ALL SELECT 'macro avg', {_rh('mp')}, {_rh('mr')}, {_rh('mf')}, CAST(s AS BIGINT) FROM t
UNION ALL SELECT 'weighted avg', {_rh('wp')}, {_rh('wr')}, {_rh('wf')}, CAST(s AS BIGINT) FROM t""")
def q_class_report(spark, sf):
    return mt.class_report(_pred(spark, sf), LABELS)


@register("compare_models", _M + ",\n" + o.per_class_ctes("models", model=True) + f"""
SELECT model, {', '.join(o.round_half_up_sql(x, 4) + ' AS ' + c for x, c in [
    ('CAST(sum(tp) AS DOUBLE) / sum(support)', 'accuracy'), ('avg(precision)', 'precision_macro'),
    ('avg(recall)', 'recall_macro'), ('avg(f1)', 'f1_macro'),
    ('sum(f1 * support) / sum(support)', 'f1_weighted')])}
FROM pc GROUP BY model""")
def q_compare_models(spark, sf):
    return mt.compare_models(fx.model_predictions(spark, sf))


@register("metrics_pivot", _M + ",\n" + o.per_class_ctes("models", model=True) + ",\n"
          + "s AS (" + o.summary_select(model=True) + """)
SELECT metric, max(CASE WHEN model = 'm1' THEN v END) AS m1, max(CASE WHEN model = 'm2' THEN v END) AS m2,
       max(CASE WHEN model = 'm3' THEN v END) AS m3
FROM (SELECT model, metric, v FROM s
      UNPIVOT (v FOR metric IN (accuracy, precision_macro, recall_macro, f1_macro, f1_weighted)))
GROUP BY metric""")
def q_metrics_pivot(spark, sf):
    return mt.metrics_pivot(fx.model_predictions(spark, sf), MODELS)


@register("f1_by_model", _M + ",\n" + o.per_class_ctes("models", model=True) + f""",
{_LAB}
SELECT lab.label, round(coalesce(max(CASE WHEN model = 'm1' THEN f1 END), 0.0), 6) AS m1,
       round(coalesce(max(CASE WHEN model = 'm2' THEN f1 END), 0.0), 6) AS m2,
       round(coalesce(max(CASE WHEN model = 'm3' THEN f1 END), 0.0), 6) AS m3
FROM pc JOIN lab ON lab.code = pc.cls GROUP BY lab.label""")
def q_f1_by_model(spark, sf):
    return mt.f1_by_model(fx.model_predictions(spark, sf), MODELS, LABELS)


@register("f1_bands", _M + ",\n" + o.per_class_ctes("models", model=True) + """
SELECT model, cls, round(f1, 6) AS f1,
       CASE WHEN f1 >= 0.85 THEN 'high' WHEN f1 >= 0.70 THEN 'medium' ELSE 'low' END AS band
FROM pc""")
def q_f1_bands(spark, sf):
    pc = mt.per_class(fx.model_predictions(spark, sf), model="model")
    return pc.select("model", "cls", round6("f1").alias("f1"), mt.f1_bands(pc).alias("band"))


@register("decode_labels", _P + f""",
{_LAB}
SELECT id, a.label AS true_label, b.label AS predicted_label
FROM pred LEFT JOIN lab a ON a.code = pred.y_true LEFT JOIN lab b ON b.code = pred.y_pred""")
def q_decode_labels(spark, sf):
    enc = spark.createDataFrame(list(enumerate(LABELS)), "code int, label string")
    p = _pred(spark, sf)
    p = decode_labels(p, enc, "y_true", "code", "label", "true_label")
    p = decode_labels(p, enc, "y_pred", "code", "label", "predicted_label")
    return p.select("id", "true_label", "predicted_label")


# --------------------------------------------------------------------------
# errors
# --------------------------------------------------------------------------

def _errors_sql():
    lab = "[" + ", ".join(o.q(x) for x in LABELS) + "]"
    w = o.wc_sql("coalesce(text, '')")
    return f""",
err AS (
  SELECT id AS "index", {o.excerpt_sql("coalesce(text, '')")} AS text_excerpt,
         {w} AS word_count, {lab}[y_true + 1] AS true_label, {lab}[y_pred + 1] AS predicted_label,
         confidence,
         CASE WHEN {w} < 30 THEN 'short_text' WHEN {w} > 200 THEN 'long_noisy'
              WHEN confidence < 0.5 THEN 'low_confidence' ELSE 'class_overlap' END AS error_type
  FROM pred WHERE y_true <> y_pred)"""


_ERR = _P + _errors_sql()


@register("collect_errors", _ERR + """
SELECT "index", text_excerpt, word_count, true_label, predicted_label,
       round(confidence, 6) AS confidence, error_type FROM err""")
def q_collect_errors(spark, sf):
    return _r6(er.collect_errors(_pred(spark, sf), LABELS), ["confidence"])


@register("error_sample", _ERR + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY error_type
                                   ORDER BY {o.draw_sql('"index"', '42', "'err'")}, "index") AS _r FROM err),
q AS (SELECT count(*) AS total, greatest(1, 30 // count(DISTINCT error_type)) AS quota FROM err)
SELECT "index", text_excerpt, word_count, true_label, predicted_label, round(confidence, 6) AS confidence,
       error_type
FROM r, q WHERE q.total <= 30 OR r._r <= q.quota
ORDER BY error_type, _r LIMIT 30""")
def q_error_sample(spark, sf):
    return _r6(er.error_sample(er.collect_errors(_pred(spark, sf), LABELS), 30), ["confidence"])


@register("error_types", _ERR + """
SELECT error_type, count(*) AS n FROM err GROUP BY error_type""")
def q_error_types(spark, sf):
    errs = er.collect_errors(_pred(spark, sf), LABELS)
    return errs.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@register("error_rate", _M + """
SELECT model, round(avg(CASE WHEN y_true <> y_pred THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
       count(*) AS n FROM models GROUP BY model""")
def q_error_rate(spark, sf):
    return _r6(er.error_rate(fx.model_predictions(spark, sf), "model"), ["error_rate"])


@register("confusion_pairs", _ERR + """,
c AS (SELECT true_label, predicted_label, count(*) AS count FROM err GROUP BY ALL
      ORDER BY count DESC, true_label, predicted_label LIMIT 15)
SELECT true_label, predicted_label, count, substr(true_label, 1, 15) || ' → ' || substr(predicted_label, 1, 15) AS pair
FROM c""")
def q_confusion_pairs(spark, sf):
    return er.confusion_pairs(er.collect_errors(_pred(spark, sf), LABELS))


@register("confidence_hist", _M + """,
s AS (SELECT model, min(confidence) AS lo, max(confidence) AS hi, avg(confidence) AS mean
      FROM models GROUP BY model),
b AS (SELECT m.model, CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((confidence - lo) / ((hi - lo) / 30)) END, 29)
                          AS INTEGER) AS bin, mean FROM models m JOIN s USING (model))
SELECT model, bin, count(*) AS n, round(any_value(mean), 6) AS mean_confidence FROM b GROUP BY model, bin""")
def q_confidence_hist(spark, sf):
    return er.confidence_hist(fx.model_predictions(spark, sf))


@register("most_confident", _M + """
SELECT id, arg_max(model, (confidence, -(CASE model WHEN 'm1' THEN 1 WHEN 'm2' THEN 2 ELSE 3 END)))
         AS most_confident_model, round(max(confidence), 6) AS confidence
FROM models GROUP BY id""")
def q_most_confident(spark, sf):
    return er.most_confident(fx.model_predictions(spark, sf), MODELS)


@register("top_probabilities", _P + f""",
z AS (SELECT id, y_pred, unnest(generate_series(1, 10)) AS pos, unnest(proba) AS probability FROM pred),
r AS (SELECT id, y_pred, pos, probability,
             row_number() OVER (PARTITION BY id ORDER BY probability DESC, ({'[' + ', '.join(o.q(x) for x in LABELS) + ']'})[pos]) AS rank
      FROM z)
SELECT id, CAST(rank AS INTEGER) AS rank, ({'[' + ', '.join(o.q(x) for x in LABELS) + ']'})[pos] AS label,
       round(probability, 6) AS probability, pos - 1 = y_pred AS is_pred
FROM r WHERE rank <= 8""")
def q_top_probabilities(spark, sf):
    return top_probabilities(_pred(spark, sf), "id", "proba", LABELS, "y_pred", 8)


# --------------------------------------------------------------------------
# histories and pooling
# --------------------------------------------------------------------------

_HIST = """WITH d AS (
  SELECT user_id AS run, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day,
         avg(value) AS v, count(*) AS n FROM events GROUP BY ALL),
h AS (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY day) AS INTEGER) AS epoch,
             v / (v + 1) AS val_f1_macro FROM d),
a AS (SELECT *, max(val_f1_macro) OVER (PARTITION BY run ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM h),
b AS (SELECT *, prev_best IS NULL OR val_f1_macro > prev_best AS improved,
             max(val_f1_macro) OVER (PARTITION BY run ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM a),
c AS (SELECT *, CAST(epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS since_best FROM b),
th AS (SELECT *, epoch = min(CASE WHEN since_best >= 3 THEN epoch END) OVER (PARTITION BY run) AS stop
       FROM c)"""


@register("training_history", _HIST + """
SELECT run, epoch, round(val_f1_macro, 6) AS val_f1_macro, round(best_so_far, 6) AS best_so_far,
       improved, since_best, coalesce(stop, false) AS stop FROM th""")
def q_training_history(spark, sf):
    th = hi.training_history(hi.events_history(read_table(spark, sf, "events")))
    return th.select("run", "epoch", round6("val_f1_macro").alias("val_f1_macro"),
                     round6("best_so_far").alias("best_so_far"), "improved", "since_best",
                     F.coalesce("stop", F.lit(False)).alias("stop"))


@register("best_epochs", _HIST + """
SELECT run, CAST(arg_max(epoch, (val_f1_macro, -epoch)) AS INTEGER) AS best_epoch,
       round(max(val_f1_macro), 6) AS best_value,
       CAST(min(CASE WHEN stop THEN epoch END) AS INTEGER) AS stop_epoch,
       CAST(max(epoch) AS INTEGER) AS epochs FROM th GROUP BY run""")
def q_best_epochs(spark, sf):
    th = hi.training_history(hi.events_history(read_table(spark, sf, "events")))
    return hi.best_epochs(th)


@register("token_weights_norm", """SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(w, 6) AS w FROM (
  SELECT vec_id, unnest(generate_series(1, 45)) AS pos,
         unnest(list_transform(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))),
                lambda v: v / (list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) + 1e-9))[1:45]) AS w
  FROM embeddings)""")
def q_token_weights_norm(spark, sf):
    e = read_table(spark, sf, "embeddings")
    w = normalize_weights(F.transform("embedding", lambda x: F.abs(x.cast("double"))), 45)
    return e.select("vec_id", F.posexplode(w).alias("pos", "w")).select(
        "vec_id", (F.col("pos") + 1).alias("pos"), round6("w").alias("w"))


@register("token_weights_clipped", """WITH e AS (
  SELECT vec_id, list_transform(embedding[1:30], lambda x: abs(CAST(x AS DOUBLE))) AS w FROM embeddings)
SELECT vec_id, CAST(unnest(generate_series(1, len(w))) AS INTEGER) AS pos,
       round(unnest(list_transform(w, lambda v: v / (list_max(w) + 1e-9))), 6) AS w FROM e""")
def q_token_weights_clipped(spark, sf):
    """The first 30 weights over their own maximum."""
    e = read_table(spark, sf, "embeddings")
    w = normalize_weights(F.transform("embedding", lambda x: F.abs(x.cast("double"))), first=30)
    return e.select("vec_id", F.posexplode(w).alias("pos", "w")).select(
        "vec_id", (F.col("pos") + 1).alias("pos"), round6("w").alias("w"))


_ATTENTION_V = [1.0, -1.0] * 32  # over the 64 dimensions of an embedding


@register("attention_pool", """WITH l AS (
  SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT vec_id, label, sum(CASE WHEN dim % 2 = 0 THEN 1.0 ELSE -1.0 END * tanh(x)) AS s
      FROM l GROUP BY vec_id, label),
e AS (SELECT vec_id, label, exp(s - max(s) OVER (PARTITION BY label)) AS e FROM s),
w AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY label) AS w FROM e)
SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(w * x), 6) AS value
FROM l JOIN w USING (vec_id) GROUP BY label, dim""")
def q_attention_pool(spark, sf):
    return attention_pool(read_table(spark, sf, "embeddings"), "label", "embedding", _ATTENTION_V)


@register("metrics_store", _M + ",\n" + o.per_class_ctes("models", model=True) + """
SELECT model, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
       round(avg(f1), 6) AS f1_macro, CAST(count(*) AS INTEGER) AS n_classes,
       CAST(sum(support) AS BIGINT) AS cm_total
FROM pc GROUP BY model""")
def q_metrics_store(spark, sf):
    """Metrics documents (scalars, per-class F1 map, dense matrix) written
    as JSON to the shared scratch folder and read back with a fixed schema."""
    return metrics_roundtrip(fx.model_predictions(spark, sf), LABELS)


@register("metrics_store_values", _M + ",\n" + o.per_class_ctes("models", model=True) + f""",
{_LAB},
codes AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS at
          FROM (SELECT y_true AS c FROM models UNION SELECT y_pred FROM models)),
n AS (SELECT model, y_true, y_pred, count(*) AS n FROM models GROUP BY ALL)
SELECT pc.model, 'f1' AS part, lab.label AS row, CAST(NULL AS INTEGER) AS col, round(f1, 6) AS value
FROM pc JOIN lab ON pc.cls = lab.code
UNION ALL
SELECT m.model, 'confusion', CAST(t.at AS VARCHAR), CAST(p.at AS INTEGER), CAST(coalesce(n.n, 0) AS DOUBLE)
FROM (SELECT DISTINCT model FROM models) m CROSS JOIN codes t CROSS JOIN codes p
LEFT JOIN n ON n.model = m.model AND n.y_true = t.c AND n.y_pred = p.c""")
def q_metrics_store_values(spark, sf):
    """Every value of the stored per-class map and confusion matrix, read back."""
    from narrata.session import scratch_path
    from narrata.sources.metrics_store import document_values, metrics_documents, read_metrics, write_metrics
    path = scratch_path(spark, "metrics")
    write_metrics(metrics_documents(fx.model_predictions(spark, sf), LABELS), path)
    return document_values(read_metrics(spark, path))


@register("comparison_csv", _M + ",\n" + o.per_class_ctes("models", model=True) + f"""
SELECT model, {', '.join(o.round_half_up_sql(x, 4) + ' AS ' + c for x, c in [
    ('CAST(sum(tp) AS DOUBLE) / sum(support)', 'accuracy'), ('avg(precision)', 'precision_macro'),
    ('avg(recall)', 'recall_macro'), ('avg(f1)', 'f1_macro'),
    ('sum(f1 * support) / sum(support)', 'f1_weighted')])}
FROM pc GROUP BY model""")
def q_comparison_csv(spark, sf):
    """Comparison table written as a CSV with header and read back."""
    from narrata.session import scratch_path
    from narrata.sources.metrics_store import read_comparison_csv, write_comparison_csv
    path = scratch_path(spark, "comparison")
    write_comparison_csv(mt.compare_models(fx.model_predictions(spark, sf)), path)
    return read_comparison_csv(spark, path)
