"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame.

Each applies its operator to the whole table with production parameters and
derives the digest columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import (
    curriculum,
    gam,
    interpolated_lm,
    line_crf,
    link_trust,
    merkle,
    pii_bootstrap,
    prefix_bpe,
    rans,
    runs,
    simhash,
    stable_ann,
    wrapper_html,
)
from narrata.llm.common import documents, words

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(spark, sf_dir, tokenizer_path("byte_bpe_50k.json")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prefix_bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), ["doc_id"])
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op6_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)


@query
def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = line_crf.train(docs, documents(spark, sf_dir, "labels"))
    return line_crf.judge(docs.select("doc_id", "text"), model).drop("text")


@query
def op7_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = gam.train(docs, documents(spark, sf_dir, "labels"))
    return gam.score(docs.select("doc_id", "text"), model) \
        .select("doc_id", gam.held_out().alias("held_out"), "score", "predicted")


@query
def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    placed = mixed.select("doc_id", "size", "source_size", "target", "copies", "taken",
                          F.round("position", 9).alias("position"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


ORACLE["op8_curriculum_mix"] = curriculum.ORACLE


@query
def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(documents(spark, sf_dir))


@query
def op10_stable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    return stable_ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query
def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.extract(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    counts = [F.size(F.filter("base", pii_bootstrap.is_kind(k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(pii_bootstrap.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii_bootstrap.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii_bootstrap.spans_text(F.concat("base", "added")).alias("spans"))


@query
def op4_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages")
    return wrapper_html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*merkle.FIELDS)
    # the stand-in for tampered data: half of the rows lose their line feeds
    tampered = F.replace("text", F.lit("\n"), F.lit(""))
    handed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                    merkle.leaf_digest(*merkle.FIELDS[:-1], tampered)).otherwise(merkle.leaf_digest(*merkle.FIELDS))
    made = merkle.manifest(docs.withColumn("handed", handed)) \
        .withColumn("folded_root", merkle.fold(F.col("handed")))
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE["op13_merkle_manifest"] = merkle.oracle()


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The stand-in for repetitive texts: in every tenth document, by the hash of
    its id, the words from some place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.size("_words").cast("long")
    times = F.lit(3) + g % 8
    tail = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    again = F.slice(F.flatten(F.array_repeat(tail, times.cast("int"))), F.lit(1), (n - F.col("_a")).cast("int"))
    # words are cut for the chosen documents only
    cut = docs.withColumn("_words", F.when(h % 10 == 0, words()).otherwise(F.array().cast("array<string>"))) \
        .withColumn("_a", F.when(n > 0, g % n).otherwise(0)) \
        .withColumn("_p", 1 + F.floor((n - F.col("_a")) / times))
    text = F.when(n > 0, F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), again), " ")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_periodic_tails(documents(spark, sf_dir)), min_length=12, with_text=False)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"), F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"),
        F.floor(1000 * F.col("_longest.length") / -F.col("_longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


@query
def op11_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(documents(spark, sf_dir, "pages")).drop("url")


ORACLE["op11_link_trust"] = link_trust.oracle()
