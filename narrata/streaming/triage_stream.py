"""Structured Streaming: triage narratives as files arrive.

The stateless part of the triage (validity gate, cleaning, word count,
keyword priority, rule-based issue group) is a plain projection, so it runs
unchanged on a stream: ``readStream`` -> projection -> file sink, exactly
once through the checkpoint. Work that needs a whole batch (the TextRank
summaries of accepted rows) runs in ``foreachBatch`` on each micro-batch.
Fitted models score inside the row (``plans.score.score_rows``), on a stream as
on a table; arriving repeats are dropped by ``streaming.dedup_stream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.fixed_values import GATE_MIN_WORDS
from narrata.functions.priority import issue_rule_confidence, issue_rule_group, score_priority
from narrata.functions.text import clean_text, word_count

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def triage_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                min_words: int = GATE_MIN_WORDS) -> DataFrame:
    """Stateless triage columns; rows below the gate keep nulls."""
    wc = F.coalesce(word_count(text), F.lit(0))
    ok = wc >= min_words
    return df.select(
        F.col(id_col), wc.alias("raw_words"), ok.alias("accepted"),
        F.when(ok, clean_text(text)).alias("narrative_clean"),
        F.when(ok, score_priority(text)).alias("priority"),
        F.when(ok, issue_rule_group(text)).alias("issue_group"),
        F.when(ok, issue_rule_confidence()).alias("issue_confidence"))


#: input of one micro-batch: whole files up to about this size (one file at least)
BYTES_PER_TRIGGER = 1 << 30


def open_source(spark: SparkSession, source_dir: str, schema: T.StructType = DOCUMENT_SCHEMA,
                glob: str | None = None, bytes_per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    """A stream of the Parquet files under ``source_dir``, or of what ``glob``
    names in it: a file, or a table that is a folder of files. The braces make
    a name without wildcards a pattern too, which a single file needs."""
    path = f"{source_dir.rstrip('/')}/{{{glob}}}" if glob else source_dir
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)


def run_triage_stream(spark: SparkSession, source_dir: str, out_path: str, checkpoint: str,
                      glob: str | None = None, id_col: str = "doc_id", text: str = "text",
                      summaries_path: str | None = None) -> None:
    """Process everything available now, then stop (``availableNow``).

    With ``summaries_path`` each micro-batch also gets TextRank summaries
    written by ``foreachBatch`` (one folder a batch id, overwritten on replay)."""
    src = open_source(spark, source_dir, glob=glob)
    q = (triage_rows(src, id_col, text).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", f"{checkpoint}/triage")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if summaries_path:
        from narrata.operators.summarize import summarize

        def write_batch(batch: DataFrame, batch_id: int) -> None:
            accepted = batch.where(F.coalesce(word_count(text), F.lit(0)) >= GATE_MIN_WORDS)
            out = summarize(accepted.select(id_col, text), id_col, text)
            # a replayed batch overwrites its own folder
            out.write.mode("overwrite").parquet(f"{summaries_path}/batch_id={batch_id}")
        q2 = (open_source(spark, source_dir, glob=glob).writeStream
              .option("checkpointLocation", f"{checkpoint}/summaries")
              .foreachBatch(write_batch).trigger(availableNow=True).start())
        q2.awaitTermination()
