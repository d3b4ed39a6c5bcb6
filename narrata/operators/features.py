"""Text features: vocabulary, fixed-length id sequences, TF-IDF.

All of it is long-table DataFrame work: explode tokens, aggregate partially
on (doc, term) and term, rank the bounded vocabulary, join it back. The
vocabulary and the TF-IDF term list are bounded by ``max_vocab`` /
``max_features``, which is the proven size that lets them be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.fixed_values import MAX_LEN, MAX_VOCAB, MIN_FREQ, PAD_IDX, UNK_IDX
from narrata.functions.text import strip_accents, tokenize
from narrata.operators.row_scoring import TermIndex, feature_column
from narrata.session import cut_lineage


def reaching_rank(counts: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose ``col`` is at least the ``n``-th largest: the first ``n`` and
    those that tie with the last of them. A histogram of the values (few rows:
    distinct counts) gives the bound, so that a top-n after it gathers about
    ``n`` rows in all, not ``n`` of every partition."""
    counts = cut_lineage(counts, "counts")  # read twice: one row per term
    hist = counts.groupBy(F.col(col).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    above = F.sum("_rows").over(Window.orderBy(F.desc("_value")).rowsBetween(Window.unboundedPreceding, 0))
    bound = hist.withColumn("_above", above).where(F.col("_above") >= n).agg(F.max("_value").alias("_bound"))  # one row
    return counts.crossJoin(F.broadcast(bound)) \
        .where(F.col("_bound").isNull() | (F.col(col) >= F.col("_bound"))).drop("_bound")


def vocab_build(df: DataFrame, text: str, max_vocab: int = MAX_VOCAB,
                min_freq: int = MIN_FREQ) -> DataFrame:
    """(token, id, freq): the ``max_vocab`` most frequent tokens with
    frequency >= ``min_freq``; ids from 2 (0 PAD, 1 UNK); ties by token."""
    toks = df.select(F.explode(tokenize(text)).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("freq")) \
                 .where(F.col("freq") >= min_freq)
    top = reaching_rank(counts, "freq", max_vocab).orderBy(F.desc("freq"), "token").limit(max_vocab)
    # at most max_vocab rows: the unpartitioned ranking is bounded
    w = Window.orderBy(F.desc("freq"), "token")
    return top.select("token", (F.row_number().over(w) + 1).cast("int").alias("id"), "freq")


def encode_sequences(df: DataFrame, id_col: str, text: str, vocab: DataFrame,
                     max_len: int = MAX_LEN) -> DataFrame:
    """(id, ids, mask): first ``max_len`` tokens mapped to ids (UNK = 1),
    right-padded with 0; mask = id != 0.

    Tokens are exploded with their position, looked up with a broadcast
    join against the bounded vocabulary, and re-collected per document
    (at most ``max_len`` entries each) in position order: one exchange. The
    outer explode keeps documents with no token, which get all padding."""
    toks = df.select(id_col, F.posexplode_outer(F.slice(tokenize(text), 1, max_len)).alias("pos", "token"))
    v = F.broadcast(vocab.select("token", F.col("id").alias("_tid")))
    entry = F.when(F.col("pos").isNotNull(),
                   F.struct("pos", F.coalesce("_tid", F.lit(UNK_IDX)).alias("_tid")))
    out = (toks.join(v, "token", "left").groupBy(id_col)
               .agg(F.array_sort(F.collect_list(entry)).alias("_s"))
               .withColumn("_ids", F.transform("_s", lambda x: x["_tid"])))
    padded = F.concat("_ids", F.array_repeat(F.lit(PAD_IDX), F.lit(max_len) - F.size("_ids")))
    return out.select(id_col, padded.alias("ids")).withColumn(
        "mask", F.transform("ids", lambda x: x != PAD_IDX))


def ngram_terms(tokens: Column, n_max: int = 2) -> Column:
    """Unigrams followed by space-joined n-grams up to ``n_max``."""
    out = tokens
    for n in range(2, n_max + 1):
        grams = F.when(
            F.size(tokens) >= n,
            F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
                        lambda i: F.concat_ws(" ", *[F.element_at(tokens, i + k) for k in range(n)]))
        ).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, grams)
    return out


def documents_by_id(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, _parts): the accent-free, lower-case tokens of each row's text, an
    array for each row of the id. Rows that share an id are one document. Texts
    are exchanged, not their words, which take several times the room."""
    docs = df.groupBy(id_col).agg(F.collect_list(text).alias("_texts"))
    return docs.select(id_col, F.transform("_texts", lambda t: tokenize(strip_accents(t))).alias("_parts"))


def term_statistics(docs: DataFrame, n_max: int = 2, copies: str | None = None) -> DataFrame:
    """(term, df, total) of documents with ``_parts``: the documents that hold a
    term and its count in all. Each document names its terms with their
    occurrences, then once each; nothing is grouped by (document, term), and
    tasks sum by term before the exchange."""
    m = F.col(copies) if copies else F.lit(1).cast("long")
    terms = docs.select(m.alias("_m"), F.flatten(F.transform("_parts", lambda p: ngram_terms(p, n_max))).alias("_terms"))
    marked = terms.select("_m", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("once"), F.col("_terms").alias("terms")),
        F.struct(F.lit(1).cast("long").alias("once"), F.array_distinct("_terms").alias("terms")))).alias("_e"))
    each = marked.select((F.col("_m") * F.col("_e.once")).alias("df"),
                         (F.col("_m") * (1 - F.col("_e.once"))).alias("total"), F.explode("_e.terms").alias("term"))
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def document_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_N"))


def tfidf_vocabulary(stats: DataFrame, n_docs: DataFrame, min_df: int = 5, max_df: float = 0.95,
                     max_features: int = 50000) -> DataFrame:
    """(term, df, idf, idx): terms kept by document frequency, the
    ``max_features`` of highest corpus count (ties by term), smoothed idf
    ln((1+N)/(1+df)) + 1, and a 0-based column index in term order.
    ``stats`` comes from :func:`term_statistics`, ``n_docs`` is a one-row frame
    with the document count ``_N``."""
    # one-row N joined on a constant key (broadcast of a single row)
    stats = stats.withColumn("_one", F.lit(1)).join(
        F.broadcast(n_docs.withColumn("_one", F.lit(1))), "_one").drop("_one")
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("_N")))
    top = reaching_rank(kept, "total", max_features).orderBy(F.desc("total"), "term").limit(max_features)
    idf = F.log((1 + F.col("_N")) / (1 + F.col("df"))) + 1
    w = Window.orderBy("term")  # bounded by max_features rows
    return top.select("term", "df", idf.alias("idf"),
                      (F.row_number().over(w) - 1).cast("int").alias("idx"))


def tfidf_terms(df: DataFrame, id_col: str, text: str, min_df: int = 5, max_df: float = 0.95,
                max_features: int = 50000, n_max: int = 2, vocab: DataFrame | None = None) -> DataFrame:
    """(id, term, idx, tf, weight): sublinear tf x smoothed idf, L2-normalised
    per document. ``vocab`` (from :func:`tfidf_vocabulary`) may be given to
    transform new documents with a fitted vocabulary."""
    if n_max != 2:
        raise ValueError("features are words and word pairs")
    docs = documents_by_id(df, id_col, text)
    if vocab is None:
        docs = cut_lineage(docs, "documents")
        vocab = cut_lineage(tfidf_vocabulary(term_statistics(docs, n_max), document_count(df),
                                             min_df, max_df, max_features), "vocab")
    index = TermIndex.of_vocab(vocab)
    enc = docs.withColumn("_f", feature_column(df.sparkSession, index, tokens=F.col("_parts")))
    each = enc.select(id_col, F.explode(F.arrays_zip("_f.idx", "_f.tf", "_f.weight")).alias("_e")) \
              .select(id_col, "_e.idx", F.col("_e.tf").cast("long").alias("tf"), "_e.weight")
    # at most max_features terms
    return each.join(F.broadcast(vocab.select("term", "idx")), "idx").select(id_col, "term", "idx", "tf", "weight")
