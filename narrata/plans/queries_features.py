"""Feature queries: vocabulary, id sequences, TF-IDF, batched scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions.text import round6
from narrata.operators.features import encode_sequences, tfidf_terms, vocab_build
from narrata.operators.scoring import linear_scores, linear_weights_sql
from narrata.plans import oracle as o
from narrata.plans.catalog import register
from narrata.plans.prepare import filter_and_clean
from narrata.session import read_table
from narrata.sources.fixtures import complaints

_F = f"WITH {o.filtered_ctes()}"
_TOK = o.tokens_sql("narrative_clean")


def _prep(spark, sf):
    return filter_and_clean(complaints(spark, sf))


_VOCAB_SQL = f""",
vt AS (SELECT unnest({_TOK}) AS token FROM prep),
vc AS (SELECT token, count(*) AS freq FROM vt GROUP BY token HAVING count(*) >= 3),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS INTEGER) AS id, freq
          FROM vc QUALIFY id <= 50001)"""


@register("vocab_build", _F + _VOCAB_SQL + "\nSELECT token, id, freq FROM vocab")
def q_vocab_build(spark, sf):
    return vocab_build(_prep(spark, sf), "narrative_clean")


@register("encode_sequences", _F + _VOCAB_SQL + f""",
pt AS (SELECT complaint_id, unnest(generate_series(1, len({_TOK}[1:256]))) AS pos,
              unnest({_TOK}[1:256]) AS token FROM prep),
lk AS (SELECT complaint_id, pos, coalesce(v.id, 1) AS tid FROM pt LEFT JOIN vocab v USING (token)),
sq AS (SELECT complaint_id, list(tid ORDER BY pos) AS ids FROM lk GROUP BY complaint_id),
al AS (SELECT p.complaint_id, list_resize(coalesce(sq.ids, []), 256, 0) AS ids
       FROM (SELECT DISTINCT complaint_id FROM prep) p LEFT JOIN sq USING (complaint_id))
SELECT complaint_id, CAST(len(list_filter(ids, lambda x: x <> 0)) AS INTEGER) AS n_real,
       CAST(len(list_filter(ids, lambda x: x = 1)) AS INTEGER) AS n_unk,
       array_to_string(ids, ' ') AS ids FROM al""")
def q_encode_sequences(spark, sf):
    prep = _prep(spark, sf)
    seq = encode_sequences(prep, "complaint_id", "narrative_clean", vocab_build(prep, "narrative_clean"))
    return seq.select("complaint_id",
                      F.size(F.filter("ids", lambda x: x != 0)).cast("int").alias("n_real"),
                      F.size(F.filter("ids", lambda x: x == 1)).cast("int").alias("n_unk"),
                      F.array_join("ids", " ").alias("ids"))


@register("tfidf_terms", _F + """,
docs AS (SELECT complaint_id AS id,
                regexp_extract_all(lower(strip_accents(narrative_clean)), '[\\p{L}\\p{N}_]+') AS t FROM prep),
terms AS (SELECT id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1),
                                                          lambda i: t[i] || ' ' || t[i + 1]))) AS term
          FROM docs),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS big_n FROM docs),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
top AS (SELECT term, df, ln((1 + big_n) / (1 + df)) + 1 AS idf FROM st, n
        WHERE df >= 5 AND df <= 0.95 * big_n ORDER BY total DESC, term LIMIT 50000),
voc AS (SELECT *, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM top),
j AS (SELECT tf.id, tf.term, voc.idx, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term))
SELECT id AS complaint_id, term, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM j""")
def q_tfidf_terms(spark, sf):
    t = tfidf_terms(_prep(spark, sf), "complaint_id", "narrative_clean")
    return t.select("complaint_id", "term", "idx", round6("weight").alias("weight"))


def _score_sql():
    cols = linear_weights_sql()
    logits = "[" + ", ".join(f"list_dot_product(CAST(embedding AS DOUBLE[]), {c})" for c in cols) + "]"
    return f"""WITH l AS (SELECT vec_id, {logits} AS z FROM embeddings),
e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS ex FROM l),
p AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS pr FROM e)
SELECT vec_id, CAST(list_position(pr, list_max(pr)) - 1 AS INTEGER) AS y_pred,
       round(list_max(pr), 6) AS confidence FROM p"""


@register("score_with_udf", _score_sql())
def q_score_with_udf(spark, sf):
    e = read_table(spark, sf, "embeddings")
    s = e.select("vec_id", linear_scores("embedding").alias("s"))
    return s.select("vec_id", F.col("s.y_pred").alias("y_pred"), round6("s.confidence").alias("confidence"))


@register("vocab_roundtrip", _F + _VOCAB_SQL + "\nSELECT token, id FROM vocab")
def q_vocab_roundtrip(spark, sf):
    """Vocabulary saved as Parquet (token, id) and loaded back."""
    from narrata.session import scratch_path
    path = scratch_path(spark, "vocab")
    vocab_build(_prep(spark, sf), "narrative_clean").select("token", "id") \
        .write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
