"""Scoring inside the row: no exchange, so it serves tables and streams.

A fitted vocabulary and classifier are small (at most ``max_features`` terms,
classes x terms coefficients): their arrays are broadcast once, and each task
counts the known terms of a document, weighs them and takes sparse dot
products. Tokens come from the built-in expressions that training uses; the
rest runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions.text import strip_accents, tokenize
from narrata.session import bound_batches, ship_package

FEATURES = "struct<idx: array<int>, tf: array<double>, weight: array<double>>"
#: documents that a task works on at once, beside their Arrow batch
SLICE = 256
SCORE = "struct<y_pred: int, confidence: double, proba: array<double>>"


@dataclass
class Encoded:
    """Known terms of some documents, by document and column: the document and
    column of each, its count and its L2-normalised sublinear tf-idf."""
    n_docs: int
    doc: np.ndarray
    idx: np.ndarray
    tf: np.ndarray
    weight: np.ndarray

    def ends(self) -> pa.Array:
        return list_ends(np.bincount(self.doc, minlength=self.n_docs))


def list_ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def list_sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)


@dataclass
class TermIndex:
    """Vocabulary lookup of a task: the terms by column, and the idf by column."""
    terms: pa.Array
    idf: np.ndarray

    @classmethod
    def of_vocab(cls, vocab: DataFrame, limit: int = 200_000) -> "TermIndex":
        rows = vocab.select("term", "idx", "idf").limit(limit + 1).toPandas()
        if len(rows) > limit:
            raise ValueError(f"a vocabulary of more than {limit} terms")
        rows = rows.sort_values("idx")
        return cls(pa.array(rows["term"].tolist(), pa.string()), rows["idf"].to_numpy())

    def columns_of(self, terms: pa.Array) -> np.ndarray:
        """Column of each term, -1 for unknown ones."""
        return np.asarray(pc.fill_null(pc.index_in(terms.cast(self.terms.type), value_set=self.terms), -1), dtype=np.int64)

    def encode(self, docs: pa.Array) -> Encoded:
        """Words and word pairs of documents, whose tokens are a list, or a list
        for each of their rows; pairs never run from one row into the next."""
        n, doc = len(docs), np.arange(len(docs))
        if pa.types.is_list(docs.type.value_type):
            doc, docs = np.repeat(doc, list_sizes(docs)), docs.flatten()
        part = np.repeat(np.arange(len(docs)), list_sizes(docs))
        words = docs.flatten()
        paired = np.flatnonzero(part[1:] == part[:-1])
        pairs = pc.binary_join_element_wise(words.take(pa.array(paired)), words.take(pa.array(paired + 1)), " ")
        at = self.columns_of(pa.concat_arrays([words, pairs]))
        of = doc[np.concatenate([part, part[paired]])]
        width = max(1, len(self.terms))
        keys, tf = np.unique(of[at >= 0] * width + at[at >= 0], return_counts=True)
        of, idx = keys // width, keys % width
        w = (1.0 + np.log(tf)) * self.idf[idx]
        norm = np.sqrt(np.bincount(of, w * w, n))
        return Encoded(n, of, idx, tf.astype(float), np.divide(w, norm[of], out=w, where=norm[of] > 0))


def tokens_of(text: str | Column) -> Column:
    return tokenize(strip_accents(text))


def in_slices(run: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``run`` on a few documents of an Arrow batch at a time: whatever a batch
    holds, a task's own arrays are those of ``SLICE`` documents."""
    starts = range(0, max(1, len(columns[0])), SLICE)
    return pa.concat_arrays([run(*[c.slice(lo, SLICE) for c in columns]) for lo in starts])


def feature_column(spark: SparkSession, index: TermIndex, text: str | Column | None = None,
                   tokens: Column | None = None) -> Column:
    """Sparse features of a text as a struct of arrays (idx ascending). In place
    of the text the ``tokens`` may be given, as an array for each of a document's rows."""
    ship_package(spark)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(index)

    def encode(docs: pa.Array) -> pa.Array:
        e = shared.value.encode(docs)
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(e.ends(), pa.array(x, kind))
             for x, kind in ((e.idx, pa.int32()), (e.tf, pa.float64()), (e.weight, pa.float64()))],
            names=["idx", "tf", "weight"])

    def run(docs: pa.Array) -> pa.Array:
        return in_slices(encode, docs)

    return F.arrow_udf(run, FEATURES)(tokens if tokens is not None else tokens_of(text))


@dataclass
class LinearScorer:
    """Margins ``coef @ x + intercept`` of a fitted linear classifier, on term
    counts or tf-idf weights, and their softmax."""
    coef: np.ndarray      # classes x terms
    intercept: np.ndarray
    on_counts: bool = False

    @classmethod
    def of_model(cls, model) -> "LinearScorer":
        if hasattr(model, "theta"):  # naive Bayes: log likelihoods and log priors
            return cls(model.theta.toArray(), model.pi.toArray(), True)
        coef, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        if len(coef) == 1:  # the two-class form: the margin of class 1 alone
            coef, intercept = np.vstack([0 * coef, coef]), np.array([0.0, intercept[0]])
        return cls(coef, intercept)

    def proba(self, e: Encoded) -> np.ndarray:
        """Class probabilities, a row for each document."""
        x = e.tf if self.on_counts else e.weight
        z = np.stack([np.bincount(e.doc, c[e.idx] * x, e.n_docs) for c in self.coef], axis=1) + self.intercept
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _scores(proba: np.ndarray) -> pa.StructArray:
    """(y_pred, confidence, proba) structs of the rows' class probabilities."""
    n, k = proba.shape
    return pa.StructArray.from_arrays(
        [pa.array(proba.argmax(axis=1), pa.int32()), pa.array(proba.max(axis=1), pa.float64()),
         pa.ListArray.from_arrays(list_ends(np.full(n, k)), pa.array(proba.ravel(), pa.float64()))],
        names=["y_pred", "confidence", "proba"])


@dataclass
class RowScorer:
    """Several classifiers that share a vocabulary, applied in one pass."""
    index: TermIndex
    models: dict[str, LinearScorer] = field(default_factory=dict)

    def columns(self, spark: SparkSession, text: str | Column | None = None, tokens: Column | None = None) -> Column:
        """A struct with one (y_pred, confidence, proba) struct per model."""
        ship_package(spark)
        bound_batches(spark)
        shared = spark.sparkContext.broadcast((self.index, self.models))
        names = list(self.models)

        def score(docs: pa.Array) -> pa.Array:
            index, models = shared.value
            e = index.encode(docs)
            return pa.StructArray.from_arrays([_scores(models[name].proba(e)) for name in names], names=names)

        def run(docs: pa.Array) -> pa.Array:
            return in_slices(score, docs)

        ddl = "struct<" + ", ".join(f"`{n}`: {SCORE}" for n in names) + ">"
        return F.arrow_udf(run, ddl)(tokens if tokens is not None else tokens_of(text))


def add_scores(df: DataFrame, classifiers: dict, text: str) -> DataFrame:
    """``df`` (a table or a stream) with one (y_pred, confidence, proba) struct
    column per text classifier. Classifiers fitted on one term matrix are
    scored in one pass. No exchange."""
    groups: dict[int, list[str]] = {}
    for name, clf in classifiers.items():
        groups.setdefault(id(clf.vocab), []).append(name)
    out = df
    for k, names in enumerate(groups.values()):
        scorer = RowScorer(TermIndex.of_vocab(classifiers[names[0]].vocab),
                           {n: LinearScorer.of_model(classifiers[n].model) for n in names})
        out = out.withColumn(f"_scores{k}", scorer.columns(df.sparkSession, text))
    return out.select(*df.columns, *[F.col(f"_scores{k}.`{n}`").alias(n)
                                     for k, names in enumerate(groups.values()) for n in names])
