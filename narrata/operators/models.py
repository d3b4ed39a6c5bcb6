"""Spark ML models on the TF-IDF long table.

* TF-IDF + multinomial logistic regression with balanced class weights:
  scikit-learn's C maps to ``regParam = 1 / (C * sum(w))`` with no feature
  standardisation and an unpenalised intercept (the same objective).
* Word2Vec document vectors + logistic regression, and multinomial naive
  Bayes on term counts: distributed comparators standing in for the
  single-machine neural models (their scores are their own).

Training runs as Spark jobs (L-BFGS tree aggregation). The only Python per
row is building a ``SparseVector`` from a document's (index, value) arrays;
the vocabulary behind the indices is bounded by ``max_features``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.fixed_values import MAX_VOCAB, RANDOM_SEED
from narrata.functions.text import plain_accents, tokenize
from narrata.operators.features import term_statistics, tfidf_terms, tfidf_vocabulary, vocab_build
from narrata.operators.pooling import argmax
from narrata.operators.row_scoring import (LinearScorer, RowScorer, TermIndex, feature_column, in_slices, list_ends,
                                           list_sizes, tokens_of)
from narrata.session import bound_batches, broadcast_bounded, cut_lineage, ship_package


@F.udf(VectorUDT())
def _sparse(size, idx, val):
    return SparseVector(size, idx or [], val or [])


def to_vectors(long: DataFrame, id_col: str, value: str, size: int, out: str = "features") -> DataFrame:
    """Long (id, idx, value) rows -> (id, SparseVector) per document."""
    per_doc = long.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"),
                                             F.col(value).cast("double").alias("v")))).alias("_e"))
    return per_doc.select(id_col, _sparse(F.lit(size), F.transform("_e", lambda e: e["i"]),
                                          F.transform("_e", lambda e: e["v"])).alias(out))


def balanced_weights(df: DataFrame, label: str, copies: str | None = None) -> DataFrame:
    """Adds ``weight`` = N / (C n_c) from the label counts (small table), times
    the row's multiplicity where ``copies`` names it."""
    m = F.col(copies).cast("double") if copies else F.lit(1.0)
    counts = df.groupBy(label).agg(F.sum(m).alias("_nc"))
    w = Window.partitionBy()
    counts = counts.select(label, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc")))
                           .alias("_class_weight"))
    # one row per class: broadcast (a shuffle join on the class key would
    # send each class, however large, to one task)
    return df.join(broadcast_bounded(counts), label).withColumn("weight", F.col("_class_weight") * m).drop("_class_weight")


def distinct_rows(df: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """One row per ``key`` with the ``keep`` columns and ``copies``, its number of
    rows. Oversampled classes are few texts drawn many times: everything
    downstream works on the texts, weighted."""
    return df.groupBy(key).agg(*[F.any_value(c).alias(c) for c in keep], F.count(F.lit(1)).alias("copies"))


@dataclass
class TextClassifier:
    """A fitted TF-IDF vocabulary plus a Spark ML classifier."""
    vocab: DataFrame          # (term, df, idf, idx)
    n_features: int
    model: object             # LogisticRegressionModel or NaiveBayesModel
    id_col: str
    text: str

    def features(self, df: DataFrame) -> DataFrame:
        long = tfidf_terms(df, self.id_col, self.text, vocab=self.vocab)
        value = "tf" if isinstance(self.model, NaiveBayesModel) else "weight"
        return to_vectors(long, self.id_col, value, self.n_features)

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, y_pred, confidence, proba) for every input row (rows with no
        known term get an empty vector)."""
        keyed = df.groupBy(self.id_col).agg(
            # rows without an id are no documents: like rows without a known term
            F.collect_list(F.when(F.col(self.id_col).isNotNull(), F.col(self.text))).alias("_texts"),
            F.count(F.lit(1)).cast("int").alias("_n"))
        parts = F.transform("_texts", tokens_of)
        scorer = RowScorer(TermIndex.of_vocab(self.vocab), {"m": LinearScorer.of_model(self.model)})
        scored = keyed.withColumn("_s", scorer.columns(df.sparkSession, tokens=parts))
        rows = scored.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        return rows.select(self.id_col, *[F.col(f"_s.m.{c}").alias(c) for c in ("y_pred", "confidence", "proba")])

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str, text: str) -> "TextClassifier":
        vocab = spark.read.parquet(f"{path}/vocab")
        # the saved metadata names the class of the model
        meta = spark.read.text(f"{path}/model/metadata").first()[0]
        kind = NaiveBayesModel if "NaiveBayesModel" in meta else LogisticRegressionModel
        model = kind.load(f"{path}/model")
        return cls(vocab, model.numFeatures, model, id_col, text)


@dataclass
class TermMatrix:
    """Sparse features of a training table, built once for all classifiers:
    ``rows`` holds id, labels, copies, ``counts`` and ``features`` vectors (those asked for)."""
    vocab: DataFrame
    n_features: int
    rows: DataFrame
    id_col: str
    text: str


def term_matrix(train: DataFrame, labels: list[str], id_col: str = "complaint_id", text: str = "narrative_clean",
                max_features: int = 50000, min_df: int = 5, max_df: float = 0.95,
                copies: str | None = None, values: tuple[str, ...] = ("counts", "features")) -> TermMatrix:
    """Vocabulary and vectors of ``train``, written as Parquet in the shared
    folder: the optimisers' passes and any retry read vectors, not texts. A
    row with ``copies`` = m counts as m equal rows in every statistic. ``values``
    names the vectors that the fits read: naive Bayes ``counts``, regression ``features``."""
    m = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    # texts are tokenised once; tokens hold no space, so a line of them takes less room than their array
    line = F.array_join(tokens_of(text), " ").alias("_line")
    base = cut_lineage(train.select(id_col, *labels, m.alias("copies"), line), "train-tokens")

    def tokens(c):
        return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    if copies:  # one row per id
        docs = base.where(F.col(id_col).isNotNull() & F.col("_line").isNotNull()).select(
            "copies", F.array(tokens(F.col("_line"))).alias("_parts"))
    else:
        docs = base.groupBy(id_col).agg(F.collect_list("_line").alias("_lines")) \
                   .select(id_col, F.transform("_lines", tokens).alias("_parts"))
    stats = term_statistics(docs, copies="copies" if copies else None)
    n_docs = base.agg(F.sum("copies").alias("_N"))
    vocab = cut_lineage(tfidf_vocabulary(stats, n_docs, min_df, max_df, max_features), "vocab")
    index = TermIndex.of_vocab(vocab)
    n = len(index.terms)  # bounded by max_features; sizes the vectors
    encoded = base.withColumn("_f", feature_column(train.sparkSession, index, tokens=tokens(F.col("_line"))))
    of = {"counts": "_f.tf", "features": "_f.weight"}
    rows = encoded.select(id_col, *labels, "copies", *[_sparse(F.lit(n), "_f.idx", of[v]).alias(v) for v in values])
    return TermMatrix(vocab, n, cut_lineage(rows, "matrix"), id_col, text)


def _labelled(matrix: TermMatrix, label: str) -> DataFrame:
    return balanced_weights(matrix.rows.where(F.col(label).isNotNull())
                            .withColumn("label", F.col(label).cast("double")), "label", "copies")


#: rows of one optimiser task: every task sends a whole gradient each pass
ROWS_PER_TASK = 2000
#: stop of the optimiser: its last passes improve the loss by less than this share of its start
TOLERANCE = 1e-3


def _few_tasks(data: DataFrame, n_rows: int) -> DataFrame:
    """``data`` in about one task per ``ROWS_PER_TASK`` rows. A pass costs each
    task a gradient of classes x terms, so small tables take few tasks."""
    return data.coalesce(max(1, -(-n_rows // ROWS_PER_TASK)))


def fit_lr(matrix: TermMatrix, label: str, C: float = 1.0, max_iter: int = 100,
           tol: float = TOLERANCE) -> TextClassifier:
    data = _labelled(matrix, label)
    total_w, n_rows = data.agg(F.sum("weight"), F.count(F.lit(1))).first()
    data = _few_tasks(data, n_rows)
    lr = LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter,
                            tol=tol, regParam=1.0 / (C * total_w), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True)
    return TextClassifier(matrix.vocab, matrix.n_features, lr.fit(data.select("label", "weight", "features")),
                          matrix.id_col, matrix.text)


def fit_nb(matrix: TermMatrix, label: str, smoothing: float = 1.0) -> TextClassifier:
    """Multinomial naive Bayes on term counts over the fitted vocabulary."""
    data = _labelled(matrix, label).select("label", "weight", F.col("counts").alias("features"))
    model = NaiveBayes(modelType="multinomial", smoothing=smoothing, weightCol="weight").fit(data)
    return TextClassifier(matrix.vocab, matrix.n_features, model, matrix.id_col, matrix.text)


def train_tfidf_lr(train: DataFrame, label: str, id_col: str = "complaint_id",
                   text: str = "narrative_clean", C: float = 1.0, max_iter: int = 100,
                   max_features: int = 50000, min_df: int = 5, max_df: float = 0.95,
                   copies: str | None = None) -> TextClassifier:
    matrix = term_matrix(train, [label], id_col, text, max_features, min_df, max_df, copies, ("features",))
    return fit_lr(matrix, label, C, max_iter)


def train_tfidf_nb(train: DataFrame, label: str, id_col: str = "complaint_id",
                   text: str = "narrative_clean", smoothing: float = 1.0,
                   max_features: int = 50000, min_df: int = 5, max_df: float = 0.95,
                   copies: str | None = None) -> TextClassifier:
    matrix = term_matrix(train, [label], id_col, text, max_features, min_df, max_df, copies, ("counts",))
    return fit_nb(matrix, label, smoothing)


def fit_together(fits: dict) -> dict:
    """Run independent fits (name -> function without arguments) at the same
    time: their jobs share the cluster, and one fit's driver steps overlap with
    the others' tasks. Results by name, in order."""
    with ThreadPoolExecutor(max_workers=max(1, len(fits))) as pool:
        running = {name: pool.submit(inheritable_thread_target(fn)) for name, fn in fits.items()}
        return {name: f.result() for name, f in running.items()}


def save_labels(names: list[str], spark: SparkSession, path: str) -> None:
    """The label encoder of a model: one row per class."""
    spark.createDataFrame(list(enumerate(names)), "code int, label string").coalesce(1) \
         .write.mode("overwrite").parquet(f"{path}/labels")


def load_labels(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.schema("code int, label string").parquet(f"{path}/labels").orderBy("code").collect()
    return [r["label"] for r in rows]  # one row per class


@dataclass
class EmbeddingClassifier:
    """Fitted word vectors and a classifier on their means."""
    w2v: Word2VecModel
    model: LogisticRegressionModel
    id_col: str
    text: str

    def save(self, path: str) -> None:
        self.w2v.write().overwrite().save(f"{path}/w2v")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str, text: str) -> "EmbeddingClassifier":
        return cls(Word2VecModel.load(f"{path}/w2v"), LogisticRegressionModel.load(f"{path}/model"), id_col, text)

    def add_scores(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with a (y_pred, confidence, proba) struct column ``name``; every
        step works inside the row, so there is no exchange."""
        x = df.withColumn("tokens", tokenize(self.text))
        proba = vector_to_array("probability")
        return self.model.transform(self.w2v.transform(x)).select(*df.columns, F.struct(
            argmax(proba).cast("int").alias("y_pred"), F.array_max(proba).alias("confidence"), proba.alias("proba")).alias(name))

    def predict(self, df: DataFrame) -> DataFrame:
        x = df.select(self.id_col, tokenize(self.text).alias("tokens"))
        scored = self.model.transform(self.w2v.transform(x))
        proba = vector_to_array("probability")
        return scored.select(self.id_col, argmax(proba).alias("y_pred"),
                             F.array_max(proba).alias("confidence"), proba.alias("proba"))


def train_word2vec_lr(train: DataFrame, label: str, id_col: str = "complaint_id",
                      text: str = "narrative_clean", dims: int = 128, min_count: int = 3,
                      max_iter: int = 100, seed: int = RANDOM_SEED, epochs: int = 15,
                      max_vocab: int = MAX_VOCAB, copies: str | None = None) -> EmbeddingClassifier:
    """Word2Vec means and logistic regression. The driver holds the word table,
    so tokens are first limited to the ``max_vocab`` most frequent words. Word
    vectors are learned from each row once; ``copies`` weighs the regression."""
    m = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    x = train.select(id_col, tokenize(text).alias("tokens"), F.col(label).cast("double").alias("label"), m.alias("copies"))
    vocab = vocab_build(train, text, max_vocab, min_count)
    toks = x.select(id_col, "label", "copies", F.posexplode_outer("tokens").alias("pos", "token"))
    known = toks.join(F.broadcast(vocab.select("token", "id")), "token", "left")  # at most max_vocab rows
    entry = F.when(F.col("id").isNotNull(), F.struct("pos", "token"))
    x = cut_lineage(known.groupBy(F.col(id_col), "label", "copies")
                    .agg(F.array_sort(F.collect_list(entry)).alias("_t"))
                    .select(id_col, "label", "copies", F.transform("_t", lambda t: t["token"]).alias("tokens")))
    # numPartitions defaults to 1 (one training task): use the cluster
    tasks = train.sparkSession.sparkContext.defaultParallelism
    w2v = Word2Vec(vectorSize=dims, minCount=min_count, seed=seed, inputCol="tokens",
                   outputCol="features", maxIter=epochs,
                   numPartitions=tasks).fit(x)
    data = cut_lineage(balanced_weights(w2v.transform(x), "label", "copies").select("label", "weight", "features"))
    total_w, n_rows = data.agg(F.sum("weight"), F.count(F.lit(1))).first()
    lr = LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter, tol=TOLERANCE,
                            regParam=1.0 / total_w, standardization=False)
    return EmbeddingClassifier(w2v, lr.fit(_few_tasks(data, n_rows)), id_col, text)


def coefficient_table(clf: TextClassifier) -> DataFrame:
    """(cls, idx, coef) from the fitted coefficient matrix, for naive Bayes the
    log probabilities of the terms. The matrix is
    model state held by the driver (classes x max_features, bounded); it is
    handed to Spark once through Arrow."""
    import pandas as pd
    bayes = isinstance(clf.model, NaiveBayesModel)
    coef = (clf.model.theta if bayes else clf.model.coefficientMatrix).toArray()
    if coef.size > 5_000_000:  # callers broadcast it
        raise ValueError("a coefficient table of more than 5,000,000 rows")
    c, j = np.meshgrid(np.arange(coef.shape[0]), np.arange(coef.shape[1]), indexing="ij")
    pdf = pd.DataFrame({"cls": c.ravel().astype("int32"), "idx": j.ravel().astype("int32"),
                        "coef": coef.ravel().astype("float64")})
    return clf.vocab.sparkSession.createDataFrame(pdf, "cls int, idx int, coef double")


def top_features(clf: TextClassifier, names: list[str], top_n: int = 20,
                 digits: int | None = None) -> DataFrame:
    """(label, rank, term, coef): highest coefficients per class, ties by term.
    With ``digits`` coefficients are rounded first, so that equal
    counts tie whatever order their sums were taken in."""
    long = coefficient_table(clf)
    if digits is not None:
        long = long.withColumn("coef", F.round("coef", digits))
    j = long.join(F.broadcast(clf.vocab.select("idx", "term")), "idx")
    return rank_features(j, names, top_n)


def rank_features(coefs: DataFrame, names: list[str], top_n: int = 20) -> DataFrame:
    """Ranking step on a (cls, term, coef) table: top ``top_n`` per class."""
    w = Window.partitionBy("cls").orderBy(F.desc("coef"), "term")
    r = coefs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return r.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("cls") + 1).alias("label"),
                    "rank", "term", "coef")


def token_attribution(clf: TextClassifier, df: DataFrame, pred: DataFrame) -> DataFrame:
    """Per token position: coef[predicted class, term] x tf-idf weight of the
    term in the document, softmax-normalised within the document, all inside the
    document's row. Rows that share an id are one document, whose tokens are
    weighed for each of its predictions."""
    spark = df.sparkSession
    docs = df.where(F.col(clf.id_col).isNotNull()).groupBy(clf.id_col).agg(F.collect_list(clf.text).alias("_texts"))
    classes = pred.groupBy(clf.id_col).agg(F.collect_list("y_pred").alias("_classes"))
    j = docs.join(classes, clf.id_col).select(
        clf.id_col, F.transform("_texts", tokens_of).alias("_tok"), F.transform("_texts", tokenize).alias("_raw"), "_classes")
    model = LinearScorer.of_model(clf.model)
    coef = model.coef if isinstance(clf.model, NaiveBayesModel) else clf.model.coefficientMatrix.toArray()
    shared = spark.sparkContext.broadcast((TermIndex.of_vocab(clf.vocab), coef))

    def weigh(toks: pa.Array, raw: pa.Array, classes: pa.Array) -> pa.Array:
        index, coef = shared.value
        e, width = index.encode(toks), max(1, len(index.terms))
        # terms were counted on accent-stripped text; the token itself is shown raw
        per_row, rows = list_sizes(raw.flatten()), np.repeat(np.arange(len(raw)), list_sizes(raw))
        doc = np.repeat(rows, per_row)  # of each token
        words = raw.flatten().flatten().dictionary_encode()
        plain = pa.array([plain_accents(x) for x in words.dictionary.to_pylist()], pa.string())
        term = index.columns_of(plain)[np.asarray(words.indices)]
        keys, key = e.doc * width + e.idx, doc * width + term
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        known = (term >= 0) & (keys[at] == key) if len(keys) else np.zeros(len(key), dtype=bool)
        # a value for each token and each class of its document, in this order
        n_cls = list_sizes(classes)
        first, per_token = np.cumsum(n_cls) - n_cls, n_cls[doc]
        tok = np.repeat(np.arange(len(doc)), per_token)
        nth = np.arange(len(tok)) - np.repeat(np.cumsum(per_token) - per_token, per_token)
        cls = np.asarray(classes.flatten())[first[doc[tok]] + nth].astype(np.int64) if len(tok) else nth
        s = np.zeros(len(tok))
        has = known[tok] & (cls < len(coef))
        s[has] = coef[cls[has], term[tok[has]]] * e.weight[at[tok[has]]]
        top = np.full(len(raw), -np.inf)
        np.maximum.at(top, doc[tok], s)
        w = np.exp(s - top[doc[tok]])
        w /= np.bincount(doc[tok], w, len(raw))[doc[tok]]
        each = pa.ListArray.from_arrays(list_ends(per_token), pa.array(w, pa.float64()))
        return pa.ListArray.from_arrays(list_ends(np.bincount(doc, minlength=len(raw))), each)

    def run(toks: pa.Array, raw: pa.Array, classes: pa.Array) -> pa.Array:
        return in_slices(weigh, toks, raw, classes)

    ship_package(spark)
    bound_batches(spark)
    udf = F.arrow_udf(run, "array<array<double>>")
    flat = F.flatten(F.transform("_raw", lambda r: F.transform(r, lambda x, i: F.struct(i.alias("pos"), x.alias("token")))))
    t = j.select(clf.id_col, flat.alias("_t"), udf("_tok", "_raw", "_classes").alias("_w"))
    t = t.select(clf.id_col, F.explode(F.arrays_zip("_t", "_w")).alias("_e"))
    return t.select(clf.id_col, F.col("_e._t.pos").alias("pos"), F.col("_e._t.token").alias("token"),
                    F.explode("_e._w").alias("weight"))
