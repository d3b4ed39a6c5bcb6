"""Training-data pipeline over ``documents``: quality rules, SimHash
near-duplicates, personal data, source mixture, token ids.

Every stage takes (spark, docs, sf_dir), calls one operator of ``narrata.llm``
over all documents its predecessor kept, and returns a DataFrame; all but the
last return the columns of ``documents`` (and any extra ones that came in, of
whatever names). :func:`run` writes each stage's rows as Parquet in the shared
folder and reads them back as the next stage's input.

Defined results follow the operators' docstrings: null, empty and blank texts
fail the quality rules; of near-duplicates the smallest doc_id stays; an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import curriculum, line_crf, pii_bootstrap, prefix_bpe, simhash
from narrata.llm.common import documents, materialise, pack, unpack

SHINGLE, DISTANCE = 4, 4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: documents that the base rules or the line labels reject go."""
    model = line_crf.train(docs, documents(spark, sf_dir, "labels"))
    judged = line_crf.judge(pack(docs, "doc_id", "text"), model)
    return unpack(judged.filter("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: one document of each group stays."""
    return unpack(simhash.keep_one(pack(docs, "doc_id", "text"), SHINGLE, DISTANCE), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: every span becomes the name of its kind; n_chars follows."""
    clean = unpack(pii_bootstrap.mask(pii_bootstrap.extract(pack(docs, "doc_id", "text"))), docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: documents as often as the mixture takes them, in training order."""
    return unpack(curriculum.train_order(curriculum.mix(pack(docs, "doc_id", "text", "source"))), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9: exact ids of every text, and what they decode to. ``file_no`` and
    ``row_no`` are the place of the copy in the files of the mixture, which hold
    the copies in training order (null where ``docs`` isn't read from files)."""
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    order = ["file_no", "row_no"]
    try:
        part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
        placed = docs.select("doc_id", "source", "text", part.cast("int").alias("file_no"), F.col("_metadata.row_index").alias("row_no"))
    except AnalysisException:  # a table that has no files
        placed = docs.select("doc_id", "source", "text", F.lit(None).cast("int").alias("file_no"),
                             F.lit(None).cast("long").alias("row_no"))
    coded = prefix_bpe.encode_decode(placed, path, ["doc_id", "source", *order])
    return coded.select("doc_id", "source", *order, F.size("ids").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", near_duplicates),
    ("pii", personal_data),
    ("curriculum_mix", mixture),
    ("prefix_bpe", token_ids),
]

#: the line labels, the extraction and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
