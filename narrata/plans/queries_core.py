"""Core queries: scans, filters, lookups, text functions, preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.fixed_values import MAX_PER_CLASS, MIN_PER_CLASS, MIN_WORD_COUNT, OTHER_GROUP
from narrata.functions.priority import (issue_rule_confidence, issue_rule_group,
                                        keyword_hits, score_priority)
from narrata.functions.text import (clean_text, excerpt, prefix_fallback, strip_accents,
                                    tokenize, word_count)
from narrata.fixed_values import PRIORITY_KEYWORDS
from narrata.operators import filters as flt
from narrata.operators.labels import add_issue_groups, encode_labels, product_normalize
from narrata.operators.sampling import balance_classes, class_preview, sample_k
from narrata.operators.split import split_leakage
from narrata.plans import oracle as o
from narrata.plans.catalog import register
from narrata.plans.prepare import (filter_and_clean, prepare_pipeline, preprocess_texts,
                                   scan_filter, triage_counts)
from narrata.session import read_table
from narrata.sources import complaints as src
from narrata.sources.fixtures import complaints

# scaled-down balance parameters of ``balance_classes`` alone (FIXTURES.md §3)
T_MAX, T_MIN, SEED = 100, 40, 42


def _prep(spark, sf):
    return filter_and_clean(complaints(spark, sf))


# --------------------------------------------------------------------------
# slice and preparation
# --------------------------------------------------------------------------

@register("triage_counts", f"""WITH {o.filtered_ctes()}
SELECT product, priority, count(*) AS n FROM prep GROUP BY product, priority""")
def q_triage_counts(spark, sf):
    return triage_counts(complaints(spark, sf))


@register("scan_filter", f"""WITH {o.filtered_ctes()}
SELECT complaint_id, date_received, product, issue, narrative FROM dedup""")
def q_scan_filter(spark, sf):
    return scan_filter(complaints(spark, sf)).select(
        "complaint_id", "date_received", "product", "issue", "narrative")


@register("project_columns", f"""WITH {o.complaints_cte()}
SELECT complaint_id, product, issue, narrative, CAST(NULL AS VARCHAR) AS consumer_state
FROM complaints""")
def q_project_columns(spark, sf):
    df = complaints(spark, sf).drop("sub_issue", "timely", "company_response", "date_received")
    return src.project_columns(df, ["complaint_id", "product", "issue", "narrative",
                                    "consumer_state"])


@register("filter_date_cutoff", f"""WITH {o.complaints_cte()}
SELECT complaint_id, {o.date_sql('date_received')} AS date_received FROM complaints
WHERE {o.date_sql('date_received')} >= DATE '2023-08-01'""")
def q_filter_date(spark, sf):
    return flt.filter_date_cutoff(complaints(spark, sf)).select("complaint_id", "date_received")


@register("filter_blank", f"""WITH {o.complaints_cte()}
SELECT complaint_id FROM complaints WHERE {o.has_text_sql('narrative')}""")
def q_filter_blank(spark, sf):
    return flt.filter_blank(complaints(spark, sf)).select("complaint_id")


@register("filter_min_words", f"""WITH {o.complaints_cte()}
SELECT complaint_id, {o.wc_sql('narrative')} AS raw_words FROM complaints
WHERE {o.wc_sql('narrative')} >= {MIN_WORD_COUNT}""")
def q_filter_min_words(spark, sf):
    df = flt.filter_min_words(complaints(spark, sf))
    return df.select("complaint_id", word_count("narrative").alias("raw_words"))


@register("gate_min_words", f"""WITH {o.complaints_cte()}
SELECT complaint_id, coalesce({o.wc_sql('narrative')}, 0) >= 10 AS accepted FROM complaints""")
def q_gate(spark, sf):
    return flt.gate_min_words(complaints(spark, sf)).select("complaint_id", "accepted")


@register("drop_class", f"""WITH {o.filtered_ctes()}
SELECT complaint_id, product FROM prep WHERE product <> 'Credit reporting'""")
def q_drop_class(spark, sf):
    return flt.drop_class(_prep(spark, sf), "Credit reporting").select("complaint_id", "product")


@register("fill_text", f"""WITH {o.complaints_cte()}
SELECT complaint_id, coalesce(narrative, '') AS narrative FROM complaints""")
def q_fill_text(spark, sf):
    return flt.fill_text(complaints(spark, sf)).select("complaint_id", "narrative")


_NULL_COLS = ["complaint_id", "date_received", "product", "issue", "sub_issue", "narrative",
              "company_response", "timely"]


@register("null_profile", f"""WITH {o.complaints_cte()}
SELECT column_name, n_null FROM (
  SELECT {', '.join(f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in _NULL_COLS)}
  FROM complaints) UNPIVOT (n_null FOR column_name IN ({', '.join(_NULL_COLS)}))""")
def q_null_profile(spark, sf):
    return flt.null_profile(complaints(spark, sf).select(*_NULL_COLS))


@register("log_records", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
  AND json_extract_string(props, '$.eval_k') IS NULL""")
def q_log_records(spark, sf):
    return flt.log_records(read_table(spark, sf, "events")).select("event_id", "k")


# --------------------------------------------------------------------------
# lookups
# --------------------------------------------------------------------------

@register("product_normalize", f"""WITH {o.complaints_cte()}, {o.product_map_cte()}
SELECT c.complaint_id, pm.label AS product FROM complaints c JOIN pm ON c.product = pm.raw""")
def q_product_normalize(spark, sf):
    return product_normalize(complaints(spark, sf)).select("complaint_id", "product")


@register("issue_group", f"""WITH {o.complaints_cte()}, {o.issue_map_cte()}
SELECT c.complaint_id, coalesce(im.grp, '{OTHER_GROUP}') AS issue_group
FROM complaints c LEFT JOIN im ON c.issue = im.raw""")
def q_issue_group(spark, sf):
    return add_issue_groups(complaints(spark, sf)).select("complaint_id", "issue_group")


@register("dedup_narratives", f"""WITH {o.filtered_ctes()}
SELECT complaint_id, product FROM dedup""")
def q_dedup(spark, sf):
    return scan_filter(complaints(spark, sf)).select("complaint_id", "product")


# --------------------------------------------------------------------------
# text functions
# --------------------------------------------------------------------------

@register("clean_text", f"""WITH {o.complaints_cte()}
SELECT complaint_id, {o.clean_sql('narrative')} AS narrative_clean FROM complaints""")
def q_clean_text(spark, sf):
    return complaints(spark, sf).select("complaint_id", clean_text("narrative").alias("narrative_clean"))


@register("preprocess_texts", f"""WITH {o.filtered_ctes()}
SELECT complaint_id, narrative_clean, word_count FROM prep""")
def q_preprocess(spark, sf):
    return preprocess_texts(scan_filter(complaints(spark, sf))).select(
        "complaint_id", "narrative_clean", "word_count")


@register("tokenize", f"""WITH {o.complaints_cte()}
SELECT complaint_id, CAST(len({o.tokens_sql('narrative')}) AS INTEGER) AS n_tokens,
       array_to_string({o.tokens_sql('narrative')}, ' ') AS tokens
FROM complaints WHERE narrative IS NOT NULL""")
def q_tokenize(spark, sf):
    df = complaints(spark, sf).where(F.col("narrative").isNotNull())
    t = tokenize("narrative")
    return df.select("complaint_id", F.size(t).cast("int").alias("n_tokens"),
                     F.array_join(t, " ").alias("tokens"))


@register("score_priority", f"""WITH {o.complaints_cte()}
SELECT complaint_id, {o.hits_sql('narrative', PRIORITY_KEYWORDS['high'])} AS high_hits,
       {o.hits_sql('narrative', PRIORITY_KEYWORDS['medium'])} AS medium_hits,
       {o.priority_sql('narrative')} AS priority
FROM complaints WHERE narrative IS NOT NULL""")
def q_score_priority(spark, sf):
    df = complaints(spark, sf).where(F.col("narrative").isNotNull())
    return df.select("complaint_id",
                     keyword_hits("narrative", PRIORITY_KEYWORDS["high"]).alias("high_hits"),
                     keyword_hits("narrative", PRIORITY_KEYWORDS["medium"]).alias("medium_hits"),
                     score_priority("narrative").alias("priority"))


@register("issue_rules", f"""WITH {o.complaints_cte()}
SELECT complaint_id, {o.issue_rule_sql('narrative')} AS issue_group, CAST(0.6 AS DOUBLE) AS confidence
FROM complaints WHERE narrative IS NOT NULL""")
def q_issue_rules(spark, sf):
    df = complaints(spark, sf).where(F.col("narrative").isNotNull())
    return df.select("complaint_id", issue_rule_group("narrative").alias("issue_group"),
                     issue_rule_confidence().alias("confidence"))


@register("strip_accents", """SELECT doc_id, strip_accents(text) AS text_plain FROM documents""")
def q_strip_accents(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", strip_accents("text").alias("text_plain"))


@register("text_excerpt", f"""SELECT doc_id, {o.excerpt_sql('text')} AS excerpt,
  substr(text, 1, 300) || '…' AS fallback FROM documents""")
def q_text_excerpt(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", excerpt("text").alias("excerpt"),
                    prefix_fallback("text").alias("fallback"))


# --------------------------------------------------------------------------
# balancing, encoding, splitting
# --------------------------------------------------------------------------

_BAL = o.balanced_ctes(MAX_PER_CLASS, MIN_PER_CLASS, SEED)


@register("balance_classes", f"""WITH {o.filtered_ctes()},
{o.balanced_ctes(T_MAX, T_MIN, SEED)}
SELECT complaint_id, draw, product FROM bal""")
def q_balance(spark, sf):
    return balance_classes(_prep(spark, sf), "product", T_MAX, T_MIN, SEED) \
        .select("complaint_id", "draw", "product")


@register("encode_labels", f"""WITH {o.filtered_ctes()},
{_BAL},
{o.encoded_ctes()}
SELECT complaint_id, draw, product, product_encoded, issue_group, issue_group_encoded FROM enc""")
def q_encode(spark, sf):
    bal = balance_classes(_prep(spark, sf), "product", MAX_PER_CLASS, MIN_PER_CLASS, SEED)
    return encode_labels(bal).select("complaint_id", "draw", "product", "product_encoded",
                                     "issue_group", "issue_group_encoded")


_PIPE = f"""WITH {o.filtered_ctes()},
{_BAL},
{o.encoded_ctes()},
{o.split_ctes(SEED)}"""


@register("stratified_split", _PIPE + """
SELECT complaint_id, draw, product_encoded, split FROM spl""")
def q_split(spark, sf):
    return prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED) \
        .select("complaint_id", "draw", "product_encoded", "split")


@register("prepare_pipeline", _PIPE + """
SELECT complaint_id, draw, product, issue_group, priority, word_count,
       product_encoded, issue_group_encoded, split FROM spl""")
def q_prepare(spark, sf):
    return prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED).select(
        "complaint_id", "draw", "product", "issue_group", "priority", "word_count",
        "product_encoded", "issue_group_encoded", "split")


@register("split_leakage", _PIPE + """
SELECT t.complaint_id, t.draw FROM spl t
WHERE t.split = 'test' AND t.narrative IN (SELECT narrative FROM spl WHERE split = 'train')""")
def q_leakage(spark, sf):
    df = prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED)
    return split_leakage(df).select("complaint_id", "draw")


@register("sample_k", f"""WITH {o.filtered_ctes()}
SELECT complaint_id FROM prep ORDER BY {o.draw_sql('complaint_id', '42')}, complaint_id LIMIT 300""")
def q_sample_k(spark, sf):
    return sample_k(_prep(spark, sf), 300, SEED, "complaint_id").select("complaint_id")


@register("class_preview", f"""WITH {o.filtered_ctes()}
SELECT product, complaint_id, array_to_string({o.words_sql('narrative')}[1:60], ' ') AS preview
FROM prep QUALIFY row_number() OVER (PARTITION BY product ORDER BY complaint_id) = 1""")
def q_class_preview(spark, sf):
    return class_preview(_prep(spark, sf))
