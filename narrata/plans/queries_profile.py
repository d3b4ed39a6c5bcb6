"""Profile queries: counts, shares, lengths, trends, splits, words, stats."""

from __future__ import annotations


from pyspark.sql import functions as F

from narrata.fixed_values import (CHART_STOPWORDS, EDA_STOPWORDS, MAX_PER_CLASS, MIN_PER_CLASS,
                                  PRIORITY_ORDER)
from narrata.functions.text import word_count
from narrata.operators import profile as pf
from narrata.operators.labels import priority_reindex
from narrata.operators.sampling import balance_classes
from narrata.plans import oracle as o
from narrata.plans.catalog import register
from narrata.plans.prepare import filter_and_clean, prepare_pipeline
from narrata.plans.queries_core import _BAL, _PIPE, SEED
from narrata.session import cut_lineage, read_table, scratch_path
from narrata.sources.fixtures import complaints
from narrata.sources.stats import DIST_COLS, dataset_stats_long, dataset_stats_row

_F = f"WITH {o.filtered_ctes()}"
_RAW_WC = o.wc_sql("narrative")


def _prep(spark, sf):
    return filter_and_clean(complaints(spark, sf))


def _raw_wc():
    return word_count("narrative")


@register("value_counts", _F + "\nSELECT product, count(*) AS n FROM prep GROUP BY product")
def q_value_counts(spark, sf):
    return pf.value_counts(_prep(spark, sf), "product")


@register("class_share", _F + """
SELECT product, n, round(n * 100.0 / sum(n) OVER (), 2) AS pct
FROM (SELECT product, count(*) AS n FROM prep GROUP BY product)""")
def q_class_share(spark, sf):
    return pf.class_share(_prep(spark, sf), "product")


@register("dataset_summary", _F + """
SELECT count(*) AS n_rows, count(DISTINCT product) AS n_products,
       count(DISTINCT issue_group) AS n_issue_groups,
       min(date_received) AS min_date, max(date_received) AS max_date FROM prep""")
def q_dataset_summary(spark, sf):
    return pf.dataset_summary(_prep(spark, sf))


@register("length_describe", _F + f"""
SELECT CAST(count(*) AS BIGINT) AS count, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std,
       CAST(min(w) AS DOUBLE) AS min, round(quantile_cont(w, 0.25), 6) AS p25,
       round(quantile_cont(w, 0.5), 6) AS p50, round(quantile_cont(w, 0.75), 6) AS p75,
       CAST(max(w) AS DOUBLE) AS max
FROM (SELECT {_RAW_WC} AS w FROM prep)""")
def q_length_describe(spark, sf):
    return pf.length_describe(_prep(spark, sf), _raw_wc())


@register("length_percentiles", _F + f"""
SELECT unnest([50, 75, 90, 95, 99]) AS pct,
       unnest(list_transform(quantile_cont(w, [0.5, 0.75, 0.9, 0.95, 0.99]), lambda v: round(v, 6))) AS value
FROM (SELECT {_RAW_WC} AS w FROM prep)""")
def q_length_percentiles(spark, sf):
    return pf.length_percentiles(_prep(spark, sf), _raw_wc())


@register("length_histogram", _F + f"""
, v AS (SELECT least({_RAW_WC}, 500) AS v FROM prep),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
x AS (SELECT CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) / ((hi - lo) / 60.0)) END, 59)
                 AS INTEGER) AS bin, lo, (hi - lo) / 60.0 AS width FROM v, b)
SELECT bin, CAST(count(*) AS BIGINT) AS n, round(lo + bin * width, 6) AS left_edge
FROM x GROUP BY bin, lo, width""")
def q_length_histogram(spark, sf):
    return pf.length_histogram(_prep(spark, sf), _raw_wc())


@register("length_by_class", _F + f"""
, v AS (SELECT product, {_RAW_WC} AS v FROM prep WHERE {_RAW_WC} < 500),
q AS (SELECT product, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(v, 0.25), 6) AS q1,
             round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3
      FROM v GROUP BY product)
SELECT q.product, q.n, q.q1, q.median, q.q3,
  CAST(min(CASE WHEN v.v >= q1 - 1.5 * (q3 - q1) AND v.v <= q3 + 1.5 * (q3 - q1) THEN v.v END) AS DOUBLE) AS whisker_lo,
  CAST(max(CASE WHEN v.v >= q1 - 1.5 * (q3 - q1) AND v.v <= q3 + 1.5 * (q3 - q1) THEN v.v END) AS DOUBLE) AS whisker_hi
FROM v JOIN q USING (product) GROUP BY q.product, q.n, q.q1, q.median, q.q3""")
def q_length_by_class(spark, sf):
    return pf.length_by_class(_prep(spark, sf), "product", _raw_wc())


@register("cutoff_coverage", _F + f"""
SELECT c AS cutoff, round(avg(CASE WHEN w <= c THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct
FROM (SELECT {_RAW_WC} AS w FROM prep), (SELECT unnest([64, 128, 192, 256, 512]) AS c)
GROUP BY c""")
def q_cutoff_coverage(spark, sf):
    return pf.cutoff_coverage(_prep(spark, sf), _raw_wc())


@register("monthly_volume", _F + """
SELECT strftime(date_received, '%Y-%m') AS year_month, product, count(*) AS n
FROM prep GROUP BY 1, 2""")
def q_monthly_volume(spark, sf):
    return pf.monthly_volume(_prep(spark, sf), "date_received", "product")


@register("monthly_events", """SELECT strftime(ts, '%Y-%m') AS year_month, event_type, count(*) AS n
FROM events GROUP BY 1, 2""")
def q_monthly_events(spark, sf):
    return pf.monthly_volume(read_table(spark, sf, "events"), "ts", "event_type")


@register("mapping_coverage", _F + """
SELECT CAST(count(*) - sum(CASE WHEN issue_group = 'Other' THEN 1 ELSE 0 END) AS BIGINT) AS mapped,
       CAST(sum(CASE WHEN issue_group = 'Other' THEN 1 ELSE 0 END) AS BIGINT) AS unmapped,
       round((count(*) - sum(CASE WHEN issue_group = 'Other' THEN 1 ELSE 0 END)) * 100.0 / count(*), 6) AS mapped_pct,
       round(sum(CASE WHEN issue_group = 'Other' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS unmapped_pct
FROM prep""")
def q_mapping_coverage(spark, sf):
    return pf.mapping_coverage(_prep(spark, sf))


@register("priority_reindex", _F + f""",
{o.values_cte('ord_t', ['ord', 'priority'], list(enumerate(PRIORITY_ORDER)))},
c AS (SELECT priority, count(*) AS n FROM prep GROUP BY priority)
SELECT CAST(ord AS INTEGER) AS ord, ord_t.priority, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       round(coalesce(c.n, 0) * 100.0 / (SELECT sum(n) FROM c), 2) AS pct
FROM ord_t LEFT JOIN c USING (priority)""")
def q_priority_reindex(spark, sf):
    return priority_reindex(_prep(spark, sf))


@register("split_distribution", _PIPE + """
SELECT split, product, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share
FROM (SELECT split, product, count(*) AS n FROM spl GROUP BY split, product)""")
def q_split_distribution(spark, sf):
    return pf.split_distribution(prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED))


@register("split_totals", _PIPE + """
SELECT split, product, count(*) AS n FROM spl GROUP BY ROLLUP (split, product)""")
def q_split_totals(spark, sf):
    return pf.split_totals(prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED))


@register("balance_compare", _F + f""",
{_BAL},
b AS (SELECT product, count(*) AS n_before FROM prep GROUP BY product),
a AS (SELECT product, count(*) AS n_after FROM bal GROUP BY product)
SELECT coalesce(b.product, a.product) AS product, coalesce(n_before, 0) AS n_before,
       coalesce(n_after, 0) AS n_after
FROM b FULL JOIN a ON b.product = a.product""")
def q_balance_compare(spark, sf):
    prep = _prep(spark, sf)
    return pf.balance_compare(prep, balance_classes(prep, "product", MAX_PER_CLASS, MIN_PER_CLASS, SEED))


@register("class_weights", _PIPE + """,
c AS (SELECT product_encoded, count(*) AS n FROM spl WHERE split = 'train' GROUP BY 1),
s AS (SELECT sum(n) AS big_n, max(product_encoded) AS mx FROM c),
k AS (SELECT unnest(generate_series(0, mx)) AS product_encoded, big_n, mx FROM s)
SELECT CAST(k.product_encoded AS INTEGER) AS product_encoded, coalesce(c.n, 0) AS n,
       CASE WHEN c.n > 0 THEN big_n / ((mx + 1) * c.n) END AS weight
FROM k LEFT JOIN c USING (product_encoded)""")
def q_class_weights(spark, sf):
    df = prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED).where("split = 'train'")
    return pf.class_weights(df, "product_encoded")


@register("top_classes", _F + """
SELECT product, count(*) AS n FROM prep GROUP BY product ORDER BY n DESC, product LIMIT 6""")
def q_top_classes(spark, sf):
    return pf.top_k(_prep(spark, sf), "product", 6)


@register("top_unmapped", _F + """
SELECT issue, count(*) AS n FROM prep WHERE issue_group = 'Other' AND issue IS NOT NULL
GROUP BY issue ORDER BY n DESC, issue LIMIT 20""")
def q_top_unmapped(spark, sf):
    return pf.top_unmapped(_prep(spark, sf))


def _words_sql(stop, n, sample=None):
    stop_list = ", ".join(o.q(w) for w in stop)
    src = "prep"
    if sample:
        src = (f"(SELECT * FROM prep QUALIFY row_number() OVER (PARTITION BY product ORDER BY "
               f"{o.draw_sql('complaint_id', '42')}, complaint_id) <= {sample})")
    return _F + f"""
, t AS (SELECT product, unnest({o.tokens_sql('narrative')}) AS word FROM {src} s WHERE narrative IS NOT NULL),
c AS (SELECT product, word, count(*) AS n FROM t
      WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN ({stop_list}) GROUP BY 1, 2)
SELECT product, word, n, CAST(row_number() OVER (PARTITION BY product ORDER BY n DESC, word) AS INTEGER) AS rank
FROM c QUALIFY rank <= {n}"""


@register("top_words", _words_sql(EDA_STOPWORDS, 30))
def q_top_words(spark, sf):
    return pf.top_words(_prep(spark, sf), "product", "narrative", 30)


@register("top_words_chart", _words_sql(CHART_STOPWORDS, 150))
def q_top_words_chart(spark, sf):
    return pf.top_words(_prep(spark, sf), "product", "narrative", **pf.CHART_WORDS)


@register("dataset_stats", _PIPE + """
SELECT 'total_filtered' AS stat, CAST(NULL AS VARCHAR) AS key, count(*) AS value FROM spl
UNION ALL SELECT split || '_size', NULL, count(*) FROM spl GROUP BY split
UNION ALL SELECT 'num_product_classes', NULL, count(DISTINCT product) FROM spl
UNION ALL SELECT 'num_issue_groups', NULL, count(DISTINCT issue_group) FROM spl
UNION ALL SELECT 'product_distribution', product, count(*) FROM spl GROUP BY product
UNION ALL SELECT 'issue_group_distribution', issue_group, count(*) FROM spl GROUP BY issue_group
UNION ALL SELECT 'priority_distribution', priority, count(*) FROM spl GROUP BY priority""")
def q_dataset_stats(spark, sf):
    return dataset_stats_long(prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED))


@register("dataset_stats_doc", _PIPE + """
SELECT count(*) AS total_filtered, count(*) FILTER (split = 'train') AS train_size,
       count(*) FILTER (split = 'val') AS val_size, count(*) FILTER (split = 'test') AS test_size,
       count(DISTINCT product) AS num_product_classes, count(DISTINCT issue_group) AS num_issue_groups,
""" + ",\n".join(f"""(SELECT string_agg({col} || '=' || n, '|' ORDER BY {col})
   FROM (SELECT {col}, count(*) AS n FROM spl GROUP BY {col})) AS {stat}""" for stat, col in DIST_COLS) + """
FROM spl""")
def q_dataset_stats_doc(spark, sf):
    """The one-row document; its maps are printed in key order."""
    doc = dataset_stats_row(prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED))
    for stat, _ in DIST_COLS:
        doc = doc.withColumn(stat, F.array_join(F.transform(
            F.map_entries(stat), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|"))
    return doc


@register("period_profile", _F + f""", v AS (SELECT strftime(date_received, '%Y-%m') AS year_month, date_received AS d,
    {_RAW_WC} AS w, product, issue_group FROM prep)
SELECT year_month, count(*) AS n_rows, min(d) AS first_day, max(d) AS last_day, count(w) AS n_values,
       round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std, CAST(min(w) AS BIGINT) AS min,
       CAST(max(w) AS BIGINT) AS max, CAST(quantile_disc(w, 0.5) AS BIGINT) AS p50,
       CAST(quantile_disc(w, 0.9) AS BIGINT) AS p90, CAST(quantile_disc(w, 0.99) AS BIGINT) AS p99,
       count(DISTINCT product) AS n_product, count(DISTINCT issue_group) AS n_issue_group
FROM v GROUP BY year_month""")
def q_period_profile(spark, sf):
    """Day profiles of two batches, stored and merged by month. Quantiles and distinct counts
    are sketches: exact for months of up to about 4,096 rows and small sets, else within
    the errors that the store states."""
    from narrata.sources.profile_store import add_batch, day_profiles, merged_profile, period
    prep = cut_lineage(_prep(spark, sf).select("complaint_id", "date_received", "narrative", "product", "issue_group"))
    path = scratch_path(spark, "day-profiles")
    for batch in (0, 1):
        rows = prep.where(F.pmod("complaint_id", F.lit(2)) == batch)
        add_batch(day_profiles(rows, "date_received", _raw_wc(), ["product", "issue_group"]), path, batch)
    out = merged_profile(period(spark, path), [0.5, 0.9, 0.99],
                         [F.date_format("day", "yyyy-MM").alias("year_month")])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@register("length_histogram_wide", _F + f"""
, v AS (SELECT least({_RAW_WC}, 600) AS v FROM prep),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
x AS (SELECT CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) / ((hi - lo) / 70.0)) END, 69)
                 AS INTEGER) AS bin, lo, (hi - lo) / 70.0 AS width FROM v, b)
SELECT bin, CAST(count(*) AS BIGINT) AS n, round(lo + bin * width, 6) AS left_edge
FROM x GROUP BY bin, lo, width""")
def q_length_histogram_wide(spark, sf):
    """The report's form of the length chart: clipped at 600 words, 70 bins."""
    return pf.length_histogram(_prep(spark, sf), _raw_wc(), 600, 70)
