"""End-to-end preparation: raw complaints -> prepared, balanced, split rows.

One lazy plan. Exchanges: the dedup window (by text), the balance histogram
and ranking (by class, bucket), the encoders (distinct labels, tiny) and the
split ranking. Everything before the dedup exchange runs in the scan stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.fixed_values import (DATE_CUTOFF, MAX_PER_CLASS, MIN_PER_CLASS,
                                  MIN_WORD_COUNT, RANDOM_SEED)
from narrata.functions.priority import score_priority
from narrata.functions.text import clean_text, word_count
from narrata.operators.filters import filter_blank, filter_date_cutoff, filter_min_words
from narrata.operators.labels import add_issue_groups, encode_labels, product_normalize
from narrata.operators.sampling import balance_classes, dedup_first
from narrata.operators.split import stratified_split
from narrata.session import cut_lineage


def filter_rows(raw: DataFrame, date_cutoff: str = DATE_CUTOFF,
                min_words: int = MIN_WORD_COUNT) -> DataFrame:
    """Date, non-blank, word-count and product filters, row by row."""
    df = filter_date_cutoff(raw, date_cutoff)
    df = filter_blank(df)
    df = filter_min_words(df, min_words)
    return product_normalize(df)


def scan_filter(raw: DataFrame, date_cutoff: str = DATE_CUTOFF,
                min_words: int = MIN_WORD_COUNT) -> DataFrame:
    """The row filters, then first-wins dedup."""
    return dedup_first(filter_rows(raw, date_cutoff, min_words), "narrative", "complaint_id")


def preprocess_texts(df: DataFrame, col: str = "narrative") -> DataFrame:
    return (df.withColumn("narrative_clean", clean_text(col))
              .withColumn("word_count", word_count("narrative_clean")))


def filter_and_clean(df: DataFrame) -> DataFrame:
    """Everything up to balancing: filters, dedup, cleaning, groups, priority."""
    out = preprocess_texts(scan_filter(df))
    out = add_issue_groups(out)
    return out.withColumn("priority", score_priority("narrative"))


def prepare_pipeline(raw: DataFrame, max_per_class: int = MAX_PER_CLASS,
                     min_per_class: int = MIN_PER_CLASS, seed: int = RANDOM_SEED,
                     split_mode: str = "exact", materialize: bool = True) -> DataFrame:
    """Filters -> dedup -> cleaning -> groups -> priority -> balance ->
    encoders -> split.

    Balancing, encoding and the exact split each read their input more than
    once (a histogram pass and a ranking pass, encoder tables). With
    ``materialize`` the cleaned rows and the balanced, encoded rows are
    written once as Parquet in the shared checkpoint folder, so
    the expensive scan, regex and dedup stages run once and a lost executor
    does not replay the whole lineage."""
    df = filter_and_clean(raw)
    if materialize:
        df = cut_lineage(df)
    return prepare_cleaned(df, max_per_class, min_per_class, seed, split_mode, materialize)


def prepare_cleaned(df: DataFrame, max_per_class: int = MAX_PER_CLASS,
                    min_per_class: int = MIN_PER_CLASS, seed: int = RANDOM_SEED,
                    split_mode: str = "exact", materialize: bool = True) -> DataFrame:
    """The second half of :func:`prepare_pipeline`, on rows that
    :func:`filter_and_clean` made: balance -> encoders -> split."""
    df = balance_classes(df, "product", max_per_class, min_per_class, seed)
    df = encode_labels(df, ("product", "issue_group"))
    if materialize:
        df = cut_lineage(df)
    return stratified_split(df, "product_encoded", seed, mode=split_mode)


def triage_counts(raw: DataFrame) -> DataFrame:
    """The flagship slice: prepared rows counted by product and priority."""
    return filter_and_clean(raw).groupBy("product", "priority").agg(
        F.count(F.lit(1)).alias("n"))


def clean_new_batch(new_raw: DataFrame, date_cutoff: str = DATE_CUTOFF,
                    min_words: int = MIN_WORD_COUNT) -> DataFrame:
    """Filters and derivations for a newly fetched batch of one class:
    word count, date, first-wins dedup, cleaning, issue groups, priority."""
    df = filter_min_words(new_raw, min_words)
    df = filter_date_cutoff(df, date_cutoff)
    df = dedup_first(df, "narrative", "complaint_id")
    df = add_issue_groups(preprocess_texts(df))
    return df.withColumn("priority", score_priority("narrative"))


def class_refresh(full: DataFrame, new_rows: DataFrame, product: str = "Credit reporting",
                  max_per_class: int = MAX_PER_CLASS, min_per_class: int = MIN_PER_CLASS,
                  seed: int = RANDOM_SEED, split_mode: str = "exact") -> DataFrame:
    """Replace one class: drop its old rows, add a seeded sample of at most
    ``max_per_class`` new cleaned rows, then balance, encode and split."""
    from narrata.operators.filters import drop_class
    from narrata.operators.sampling import sample_k
    kept = drop_class(full, product, "product")
    sample = sample_k(cut_lineage(new_rows), max_per_class, seed, "complaint_id")
    combined = cut_lineage(kept.unionByName(sample.select(*kept.columns)))
    df = balance_classes(combined, "product", max_per_class, min_per_class, seed)
    df = cut_lineage(encode_labels(df, ("product", "issue_group")))
    return stratified_split(df, "product_encoded", seed, mode=split_mode)
