"""Source and sink queries: API pages, split files, batch unions, class refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.fixed_values import MAX_PER_CLASS, MIN_PER_CLASS, PRODUCT_LABEL_MAP
from narrata.operators.labels import lookup
from narrata.plans import oracle as o
from narrata.plans.catalog import register
from narrata.plans.prepare import class_refresh, clean_new_batch, filter_and_clean, prepare_pipeline
from narrata.plans.queries_core import _PIPE, SEED
from narrata.session import cut_lineage, scratch_path
from narrata.sources import complaints as src
from narrata.sources.class_table import ClassTable
from narrata.sources.fixtures import complaints
from narrata.sources.page_source import land_pages, register_api_pages

REFRESH = "Credit reporting"


def _api_rows(spark, sf):
    """Raw rows of one class rendered as API pages, then flattened."""
    raw = complaints(spark, sf)
    raw = raw.where(lookup("product", PRODUCT_LABEL_MAP) == REFRESH)
    return src.api_pages_flatten(src.to_api_pages(raw), product=REFRESH)


_API_SQL = f""" {o.complaints_cte()},
{o.product_map_cte()},
api AS (
  SELECT CAST(c.complaint_id AS VARCHAR) AS complaint_id,
         substr(coalesce(c.date_received || 'T12:00:00-05:00', ''), 1, 10) AS date_received,
         '{REFRESH}' AS product, coalesce(c.issue, '') AS issue, coalesce(c.sub_issue, '') AS sub_issue,
         coalesce(c.narrative, '') AS narrative, coalesce(c.company_response, '') AS company_response,
         coalesce(c.timely, '') AS timely
  FROM complaints c JOIN pm ON c.product = pm.raw
  WHERE pm.label = '{REFRESH}' AND regexp_matches(coalesce(c.narrative, ''), '\\S'))"""


@register("api_pages_flatten", "WITH" + _API_SQL + "\nSELECT * FROM api")
def q_api_pages(spark, sf):
    return _api_rows(spark, sf)


@register("api_pages_source", "WITH" + _API_SQL + "\nSELECT * FROM api")
def q_api_pages_source(spark, sf):
    """The pages land as files and arrive through the paged source as a stream, the
    second half after a restart; their hits are flattened into a Parquet sink."""
    register_api_pages(spark)
    raw = complaints(spark, sf)
    pages = cut_lineage(src.to_api_pages(raw.where(lookup("product", PRODUCT_LABEL_MAP) == REFRESH)), "pages")
    end = (pages.agg(F.max("page")).first()[0] or 0) + 1
    # numbers without rows of the class are pages without hits
    pages = spark.range(end).select(F.col("id").alias("page")).join(pages, "page", "left").fillna(
        '{"hits": {"hits": []}}', ["body"])
    folder, out, ckpt = (scratch_path(spark, x) for x in ("landed-pages", "page-rows", "page-ckpt"))
    half = end // 2
    schema = src.api_pages_flatten(pages, product=REFRESH).schema
    for part in (F.col("page") < half, F.col("page") >= half):
        land_pages(pages.where(part), folder)
        stream = spark.readStream.format("api_pages").option("path", folder).load()
        query = (src.api_pages_flatten(stream, product=REFRESH).writeStream.format("parquet")
                 .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out))
        query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


@register("union_batches", f"""WITH {o.complaints_cte()}
SELECT complaint_id, product, narrative, CAST(NULL AS VARCHAR) AS issue FROM complaints WHERE complaint_id % 2 = 0
UNION ALL
SELECT complaint_id, CAST(NULL AS VARCHAR) AS product, narrative, issue FROM complaints WHERE complaint_id % 2 = 1""")
def q_union_batches(spark, sf):
    c = complaints(spark, sf)
    a = c.where(F.col("complaint_id") % 2 == 0).select("complaint_id", "product", "narrative")
    b = c.where(F.col("complaint_id") % 2 == 1).select("complaint_id", "narrative", "issue")
    return a.unionByName(b, allowMissingColumns=True)


@register("read_split", _PIPE + """
SELECT complaint_id, draw, product, split FROM spl WHERE split = 'train'""")
def q_read_split(spark, sf):
    df = prepare_pipeline(complaints(spark, sf), MAX_PER_CLASS, MIN_PER_CLASS, SEED)
    path = scratch_path(spark, "splits")
    src.write_splits(df.select("complaint_id", "draw", "product", "narrative", "split"), path)
    return src.read_split(spark, path, "train").select("complaint_id", "draw", "product", "split")


def _refresh_sql():
    k = o.draw_sql("complaint_id", "42")
    return f"""WITH {o.filtered_ctes()},
{_API_SQL.replace(o.complaints_cte() + ",", "", 1).replace(o.product_map_cte() + ",", "", 1)},
n0 AS (SELECT TRY_CAST(complaint_id AS BIGINT) AS complaint_id, {o.date_sql('date_received')} AS date_received,
              product, issue, sub_issue, narrative, company_response, timely FROM api
       WHERE {o.wc_sql('narrative')} >= 20 AND {o.date_sql('date_received')} >= DATE '2023-08-01'),
n1 AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY narrative ORDER BY complaint_id) = 1),
n2 AS (SELECT n1.*, {o.clean_sql('n1.narrative')} AS narrative_clean,
              {o.wc_sql(o.clean_sql('n1.narrative'))} AS word_count,
              coalesce(im.grp, 'Other') AS issue_group, {o.priority_sql('n1.narrative')} AS priority
       FROM n1 LEFT JOIN im ON n1.issue = im.raw),
smp AS (SELECT * FROM n2 ORDER BY {k}, complaint_id LIMIT {MAX_PER_CLASS}),
comb AS (SELECT * FROM prep WHERE product <> '{REFRESH}' UNION ALL BY NAME SELECT * FROM smp),
{o.balanced_ctes(MAX_PER_CLASS, MIN_PER_CLASS, SEED, src='comb')},
{o.encoded_ctes()},
{o.split_ctes(SEED)}
SELECT complaint_id, draw, product, issue_group, priority, product_encoded, split FROM spl"""


@register("class_refresh", _refresh_sql())
def q_class_refresh(spark, sf):
    full = filter_and_clean(complaints(spark, sf))
    new = _api_rows(spark, sf).withColumn("complaint_id", F.expr("try_cast(complaint_id AS BIGINT)"))
    out = class_refresh(full, clean_new_batch(new), REFRESH, MAX_PER_CLASS, MIN_PER_CLASS, SEED)
    return out.select("complaint_id", "draw", "product", "issue_group", "priority",
                      "product_encoded", "split")


@register("class_refresh_table", _refresh_sql().replace("product_encoded, split FROM spl",
          "product_encoded, issue_group_encoded, split FROM spl"))
def q_class_refresh_table(spark, sf):
    """The refresh on a table kept by class: all classes are written once, then the
    new batch rewrites its own class and the table is read back."""
    table = ClassTable(spark, scratch_path(spark, "classes"), MAX_PER_CLASS, MIN_PER_CLASS, SEED)
    table.write(filter_and_clean(complaints(spark, sf)))
    new = _api_rows(spark, sf).withColumn("complaint_id", F.expr("try_cast(complaint_id AS BIGINT)"))
    table.replace(REFRESH, clean_new_batch(new))
    return table.read().select("complaint_id", "draw", "product", "issue_group", "priority",
                               "product_encoded", "issue_group_encoded", "split")


@register("triage_stream", f"""SELECT doc_id, {o.wc_sql('text')} AS raw_words,
  {o.wc_sql('text')} >= 10 AS accepted,
  CASE WHEN {o.wc_sql('text')} >= 10 THEN {o.clean_sql('text')} END AS narrative_clean,
  CASE WHEN {o.wc_sql('text')} >= 10 THEN {o.priority_sql('text')} END AS priority,
  CASE WHEN {o.wc_sql('text')} >= 10 THEN {o.issue_rule_sql('text')} END AS issue_group,
  CASE WHEN {o.wc_sql('text')} >= 10 THEN CAST(0.6 AS DOUBLE) END AS issue_confidence
FROM documents""")
def q_triage_stream(spark, sf):
    """The documents table replayed as a file stream (availableNow) into a
    Parquet sink; the sink is read back as the result."""
    from narrata.streaming.triage_stream import run_triage_stream
    out = scratch_path(spark, "stream-out")
    run_triage_stream(spark, sf, out, scratch_path(spark, "stream-ckpt"), glob="documents.parquet")
    return spark.read.parquet(out)


@register("csv_scan", f"""WITH {o.filtered_ctes()}
SELECT complaint_id, date_received, product, issue, narrative FROM dedup""")
def q_csv_scan(spark, sf):
    """Complaints landed as a raw-header CSV, read with the fixed all-string
    schema and run through the scan filters and dedup."""
    from narrata.plans.prepare import scan_filter
    path = scratch_path(spark, "landing-csv")
    src.write_complaints_csv(complaints(spark, sf), path)
    raw = src.read_complaints_csv(spark, path)
    return scan_filter(raw).select("complaint_id", "date_received", "product", "issue", "narrative")


@register("csv_ranges", f"""WITH {o.filtered_ctes()}
SELECT complaint_id, date_received, product, issue, narrative FROM dedup""")
def q_csv_ranges(spark, sf):
    """The same landing files read in byte ranges, columns by header name."""
    from narrata.plans.prepare import scan_filter
    path = scratch_path(spark, "landing-ranges")
    src.write_complaints_csv(complaints(spark, sf), path)
    raw = src.read_complaints_ranges(spark, path)
    return scan_filter(raw).select("complaint_id", "date_received", "product", "issue", "narrative")


@register("dedup_stream", f"""WITH {o.filtered_ctes()}
SELECT complaint_id, product FROM dedup""")
def q_dedup_stream(spark, sf):
    """The filtered complaints arrive as files in id order, one a batch; repeats
    across batches are dropped by keyed state."""
    from pyspark.sql import functions as F

    from narrata.plans.prepare import filter_rows
    from narrata.streaming.dedup_stream import run_dedup_stream
    rows = filter_rows(complaints(spark, sf)).select("complaint_id", "product", "narrative")
    landed, out = scratch_path(spark, "dedup-in"), scratch_path(spark, "dedup-out")
    top = rows.agg(F.max("complaint_id")).first()[0] or 0
    for k in range(4):  # arrival order: a quarter of the ids at a time
        ids = F.col("complaint_id")
        rows.where((ids > top * k // 4 - (k == 0)) & (ids <= top * (k + 1) // 4)).coalesce(1) \
            .write.mode("append").parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    run_dedup_stream(stream, out, scratch_path(spark, "dedup-ckpt"))
    return spark.read.schema(rows.schema).parquet(out).select("complaint_id", "product")


@register("stream_summaries")
def q_stream_summaries(spark, sf):
    """TextRank summaries of the accepted rows of a document stream."""
    from narrata.streaming.triage_stream import run_triage_stream
    out = scratch_path(spark, "stream-sum")
    run_triage_stream(spark, sf, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt"),
                      glob="documents.parquet", summaries_path=out)
    return spark.read.parquet(out).select("doc_id", "summary")
