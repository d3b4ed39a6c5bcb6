"""Deterministic fixture views over the driver's read-only tables.

Each view exists twice: as a DataFrame expression and as the DuckDB text of
the same expression (used as a ``WITH`` prefix by the SQL oracles). No view
uses a random function, so both sides see identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.fixed_values import ISSUE_GROUP_MAP, PRODUCT_LABEL_MAP
from narrata.session import read_table

# FIXED VALUES of the fixture recipe: seed phrases appended to narratives so
# that URL, e-mail, phone, redaction and keyword branches are exercised.
SEED_PHRASES = [
    "see https://bank.example.com/a?b=1 or www.help.example",
    "mail me at jane.doe@example.org or call 555-123-4567",
    "account XXXX on XX was stolen fraud",
    "this is an issue with my bill",
    "a billing dispute here",
    "late fee and penalty and wrong amount",
    "they threaten wage garnishment",
    "nothing more to add",
]
UNMAPPED_PRODUCT = "Other financial service"
UNLISTED_ISSUE = "Unlisted issue"

PRODUCT_KEYS = list(PRODUCT_LABEL_MAP)
ISSUE_KEYS = list(ISSUE_GROUP_MAP)


def _arr(values):
    return F.array(*[F.lit(v) for v in values])


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "[" + ", ".join(_sql_str(v) for v in values) + "]"


# --------------------------------------------------------------------------
# F-complaints
# --------------------------------------------------------------------------

def complaints_from_documents(documents: DataFrame) -> DataFrame:
    """Raw complaint rows (all text columns, id as bigint) from ``documents``."""
    d = documents
    k = F.expr("try_cast(substring(source, 4) AS INT)")
    i = (F.col("doc_id") % 75).cast("int")
    r = F.col("doc_id") % 97
    return d.select(
        F.col("doc_id").alias("complaint_id"),
        F.when(F.col("doc_id") % 50 == 0, F.lit("bad-date"))
         .otherwise(F.date_format(F.date_add(F.lit("2023-07-01").cast("date"),
                                             (F.col("doc_id") % 400).cast("int")),
                                  "yyyy-MM-dd")).alias("date_received"),
        F.when(k <= 17, F.element_at(_arr(PRODUCT_KEYS[:18]), k + 1))
         .when(k == 18, F.lit(UNMAPPED_PRODUCT))
         .otherwise(F.lit(None).cast("string")).alias("product"),
        F.when(i < 71, F.element_at(_arr(ISSUE_KEYS), i + 1))
         .when(i < 73, F.lit(UNLISTED_ISSUE))
         .otherwise(F.lit(None).cast("string")).alias("issue"),
        F.lit(None).cast("string").alias("sub_issue"),
        F.when(r == 0, F.lit(None).cast("string"))
         .when(r == 1, F.lit("   "))
         .otherwise(F.concat(F.col("text"), F.lit(" "),
                             F.element_at(_arr(SEED_PHRASES),
                                          (F.col("n_chars") % 8).cast("int") + 1)))
         .alias("narrative"),
        F.col("lang").alias("company_response"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("timely"),
    )


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complaints_from_documents(read_table(spark, sf_dir, "documents"))


def complaints_sql() -> str:
    """``complaints`` CTE body in DuckDB."""
    return f"""
SELECT doc_id AS complaint_id,
  CASE WHEN doc_id % 50 = 0 THEN 'bad-date'
       ELSE strftime(DATE '2023-07-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') END AS date_received,
  CASE WHEN TRY_CAST(substr(source, 4) AS INTEGER) <= 17
         THEN ({_sql_list(PRODUCT_KEYS[:18])})[TRY_CAST(substr(source, 4) AS INTEGER) + 1]
       WHEN TRY_CAST(substr(source, 4) AS INTEGER) = 18 THEN {_sql_str(UNMAPPED_PRODUCT)}
       ELSE NULL END AS product,
  CASE WHEN doc_id % 75 < 71 THEN ({_sql_list(ISSUE_KEYS)})[CAST(doc_id % 75 AS INTEGER) + 1]
       WHEN doc_id % 75 < 73 THEN {_sql_str(UNLISTED_ISSUE)}
       ELSE NULL END AS issue,
  CAST(NULL AS VARCHAR) AS sub_issue,
  CASE WHEN doc_id % 97 = 0 THEN NULL
       WHEN doc_id % 97 = 1 THEN '   '
       ELSE text || ' ' || ({_sql_list(SEED_PHRASES)})[CAST(n_chars % 8 AS INTEGER) + 1] END AS narrative,
  lang AS company_response,
  CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS timely
FROM documents"""


# --------------------------------------------------------------------------
# F-pred / F-models / F-pred-big: prediction tables from embeddings / orders
# --------------------------------------------------------------------------

N_PRED_CLASSES = 10
PRED_LABELS = [f"label_{i}" for i in range(N_PRED_CLASSES)]
MODEL_SCALES = [("m1", 4), ("m2", 8), ("m3", 12)]


def pred_logits(emb: DataFrame, scale: float | Column = 8, bump: float = 3,
                n: int = N_PRED_CLASSES) -> DataFrame:
    """(id, y_true, logits): logit i = e[i]*scale (+bump on the true class
    unless id % 4 = 0), first ``n`` dimensions."""
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    logits = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.element_at("embedding", i + 1).cast("double") * factor
        + F.when((i == F.col("label")) & (F.col("vec_id") % 4 != 0), F.lit(float(bump)))
           .otherwise(F.lit(0.0)))
    rest = [c for c in emb.columns if c == "model"]
    return emb.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y_true"),
                      logits.alias("logits"), *rest)


def _scored(emb: DataFrame, scale) -> DataFrame:
    from narrata.operators.pooling import argmax, softmax
    p = pred_logits(emb, scale).withColumn("proba", softmax("logits"))
    return p.withColumn("y_pred", argmax("proba")).withColumn("confidence", F.array_max("proba"))


def predictions(spark: SparkSession, sf_dir: str, scale: float = 8) -> DataFrame:
    """F-pred: (id, y_true, y_pred, confidence, proba, text)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.agg(F.count(F.lit(1)).alias("_nd"))
    p = _scored(read_table(spark, sf_dir, "embeddings"), scale)
    # text of document (id mod #documents); the one-row count is broadcast
    # (a shuffle join on a constant key would send every row to one task)
    p = p.withColumn("_one", F.lit(1)).join(F.broadcast(n_docs.withColumn("_one", F.lit(1))), "_one")
    p = p.withColumn("_doc", F.col("id") % F.col("_nd"))
    return (p.join(docs, p["_doc"] == docs["doc_id"], "left")
             .select("id", "y_true", "y_pred", "confidence", "proba", "text"))


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-models: F-pred without its text under three logit scales, column
    ``model``; each row is read once and scored under every scale."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(k)).alias("scale")) for m, k in MODEL_SCALES])
    emb = read_table(spark, sf_dir, "embeddings").withColumn("_m", F.explode(models)) \
        .select("*", "_m.model", "_m.scale")
    return _scored(emb, F.col("scale")).select("id", "y_true", "y_pred", "confidence", "proba", "model")


def big_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-pred-big from orders: 5 classes from the order priority digit."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    t = (F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    bad = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1) >= F.lit("b")
    return o.select(F.col("o_orderkey").alias("id"), t.alias("y_true"),
                    F.when(bad, (t + 1 + F.col("o_orderkey") % 4) % 5).otherwise(t)
                    .cast("int").alias("y_pred"))


def logits_sql(scale: float = 8, bump: float = 3, n: int = N_PRED_CLASSES) -> str:
    return (f"list_transform(generate_series(0, {n - 1}), lambda i: "
            f"CAST(embedding[i + 1] AS DOUBLE) * {float(scale)} + "
            f"CASE WHEN i = label AND vec_id % 4 <> 0 THEN {float(bump)} ELSE 0.0 END)")


def predictions_sql(scale: float = 8, name: str = "pred") -> str:
    """CTE ``name``: (id, y_true, y_pred, confidence, proba, text)."""
    lg = logits_sql(scale)
    return f"""{name}_l AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y_true, {lg} AS logits
             FROM embeddings),
{name}_e AS (SELECT id, y_true, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex
             FROM {name}_l),
{name}_p AS (SELECT id, y_true, list_transform(ex, lambda x: x / list_sum(ex)) AS proba FROM {name}_e),
{name} AS (SELECT p.id, p.y_true, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS y_pred,
                  list_max(proba) AS confidence, proba, d.text
           FROM {name}_p p LEFT JOIN documents d
             ON d.doc_id = p.id % (SELECT count(*) FROM documents))"""


def models_sql() -> str:
    parts = [predictions_sql(s, n) for n, s in MODEL_SCALES]
    union = " UNION ALL ".join(f"SELECT *, '{n}' AS model FROM {n}" for n, _ in MODEL_SCALES)
    return ",\n".join(parts) + f",\nmodels AS ({union})"


def big_predictions_sql() -> str:
    return """bigp AS (
  SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS y_true,
    CAST(CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) >= 'b'
         THEN (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 + 1 + o_orderkey % 4) % 5
         ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 END AS INTEGER) AS y_pred
  FROM orders)"""
