"""A trained attention classifier: distributed mini-batch gradient descent.

Model: token embeddings, additive attention ``v . tanh(W e + b)`` over the
tokens of a text (padding masked), the weighted mean of the embeddings, and a
linear layer to the classes. There is no recurrent layer and no position, so a
chunk of texts computes each distinct token once, weighted by its count.

Training is synchronous. The encoded texts lie in the shared folder in
``n_batches`` buckets dealt by a hash, each cut into tasks. A step reads one
bucket: every task computes its texts' gradient on Arrow batches, gradients are
summed by parameter block in Spark (in two levels when there are many tasks),
and the driver, which holds the parameters (bounded: vocabulary x dimensions),
makes one Adam step and broadcasts again. Tasks hold no state, so a lost
executor's work is simply done again. After each epoch the validation texts are
scored in Spark; training stops ``patience`` epochs after the best macro F1 and
returns that epoch's parameters with the history of all epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.fixed_values import MAX_LEN, MAX_VOCAB, MIN_FREQ, RANDOM_SEED, UNK_IDX
from narrata.functions.text import tokenize
from narrata.operators.features import vocab_build
from narrata.session import bound_batches, cut_lineage, scratch_path, ship_package

#: embedding rows of one gradient block, and tasks beyond which sums take two levels
BLOCK_ROWS, FAN_IN = 512, 64
#: texts of one file of all buckets
ROWS_PER_TASK = 2000
#: texts of one matrix product in a task
CHUNK = 64
#: parameters the driver and each task may hold
MAX_PARAMETERS = 50_000_000
_DENSE = ("W", "b", "v", "U", "c")
HISTORY = "epoch int, train_loss double, val_loss double, val_f1_macro double, val_accuracy double"


def initial(n_tokens: int, n_classes: int, dims: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    if n_tokens * dims > MAX_PARAMETERS:
        raise ValueError("more embedding parameters than the driver may hold")
    e = r.normal(0, 0.1, (n_tokens, dims))
    e[0] = 0.0  # padding
    return {"E": e, "W": r.normal(0, dims ** -0.5, (dims, dims)), "b": np.zeros(dims),
            "v": r.normal(0, dims ** -0.5, dims), "U": r.normal(0, dims ** -0.5, (n_classes, dims)),
            "c": np.zeros(n_classes)}


def distinct_tokens(ids: np.ndarray, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of padded id rows in ascending order, padding left out, and how
    often each row holds each of them."""
    seen = np.zeros(n_tokens, dtype=bool)
    seen[ids] = True
    seen[0] = False
    tokens = np.flatnonzero(seen)
    column = np.zeros(n_tokens, dtype=np.int64)
    column[tokens] = np.arange(len(tokens))
    row, _ = np.nonzero(live := ids > 0)
    at = row * len(tokens) + column[ids[live]]
    return tokens, np.bincount(at, minlength=len(ids) * len(tokens)).reshape(len(ids), len(tokens))


def forward(p: dict[str, np.ndarray], ids: np.ndarray):
    """(tokens, their embeddings, hidden, attention weight of one occurrence by
    text and token, that of all its occurrences, context, class probabilities) of
    padded id rows. The hidden layer and the score depend on the token alone, not
    on its place, so they are computed once for each distinct token. A text
    without tokens has no weights and a zero context."""
    tokens, count = distinct_tokens(ids, len(p["E"]))
    x = p["E"][tokens]
    h = np.tanh(x @ p["W"] + p["b"])
    s = np.where(count > 0, h @ p["v"], -np.inf)
    top = s.max(axis=1, keepdims=True, initial=-np.inf)
    e = np.exp(s - np.where(np.isfinite(top), top, 0.0))
    z = (e * count).sum(axis=1, keepdims=True)
    a = np.divide(e, z, out=np.zeros_like(e), where=z > 0)
    share = a * count
    context = share @ x
    logits = context @ p["U"].T + p["c"]
    q = np.exp(logits - logits.max(axis=1, keepdims=True))
    return tokens, x, h, a, share, context, q / q.sum(axis=1, keepdims=True)


def token_weights(ids: np.ndarray, tokens: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Attention weight of every place of padded id rows, 0 for padding."""
    out = np.zeros(ids.shape)
    row, place = np.nonzero(ids)
    out[row, place] = a[row, np.searchsorted(tokens, ids[row, place])]
    return out


def gradient(p: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Summed weighted cross entropy, its gradient by parameter, and the token
    rows that E's part covers."""
    tokens, x, h, _, share, context, q = forward(p, ids)
    loss = float(-(w * np.log(np.maximum(q[np.arange(len(y)), y], 1e-12))).sum())
    dz = q
    dz[np.arange(len(y)), y] -= 1.0
    dz *= w[:, None]
    dcontext = dz @ p["U"]
    da = dcontext @ x.T
    # a token's score meets the same derivative at each of its places
    ds = (share * (da - (share * da).sum(axis=1, keepdims=True))).sum(axis=0)
    dpre = ds[:, None] * p["v"] * (1.0 - h * h)
    g = {"U": dz.T @ context, "c": dz.sum(axis=0), "v": ds @ h, "W": x.T @ dpre, "b": dpre.sum(axis=0),
         "E": share.T @ dcontext + dpre @ p["W"].T}
    return loss, g, tokens


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 1), dtype=np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for lo in range(0, b.num_rows, CHUNK):
            part = b.slice(lo, CHUNK)
            yield (_matrix(part.column("ids")), part.column("label").to_numpy(zero_copy_only=False).astype(np.int64),
                   part.column("weight").to_numpy(zero_copy_only=False))


_PART = "block int, tokens binary, sums binary"
_ARROW = pa.schema([("block", pa.int32()), ("tokens", pa.binary()), ("sums", pa.binary())])


def _encode(block: int, tokens: np.ndarray, sums: np.ndarray) -> dict:
    return {"block": block, "tokens": tokens.astype("<i4").tobytes(), "sums": sums.astype("<f8").tobytes()}


def _step_parts(shared, dims: int):
    def run(batches):
        p = shared.value
        total, dense, by_token = 0.0, None, {}
        weight = 0.0
        for ids, y, w in _chunks(batches):
            loss, g, tokens = gradient(p, ids, y, w)
            total, weight = total + loss, weight + float(w.sum())
            flat = np.concatenate([g[k].ravel() for k in _DENSE])
            dense = flat if dense is None else dense + flat
            blocks = np.unique(tokens // BLOCK_ROWS)
            ends = np.searchsorted(tokens, (blocks + 1) * BLOCK_ROWS).tolist()  # tokens ascend
            for k, lo, hi in zip(blocks.tolist(), [0, *ends], ends):
                if k not in by_token:
                    by_token[k] = np.zeros((BLOCK_ROWS, dims))
                by_token[k][tokens[lo:hi] % BLOCK_ROWS] += g["E"][lo:hi]
        if dense is None:
            return
        out = [_encode(-1, np.zeros(0), np.concatenate([[total, weight], dense]))]
        for k, held in by_token.items():
            touched = np.flatnonzero(held.any(axis=1))
            out.append(_encode(k, touched, held[touched]))
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
    return run


def _sum_parts(dims: int):
    def run(table: pa.Table) -> pa.Table:
        k = table["block"][0].as_py()
        if k < 0:
            got = _encode(k, np.zeros(0), np.sum([np.frombuffer(s, "<f8") for s in table["sums"].to_pylist()], axis=0))
        else:
            held = np.zeros((BLOCK_ROWS, dims))
            for t, s in zip(table["tokens"].to_pylist(), table["sums"].to_pylist(), strict=True):
                held[np.frombuffer(t, "<i4")] += np.frombuffer(s, "<f8").reshape(-1, dims)
            touched = np.flatnonzero(held.any(axis=1))
            got = _encode(k, touched, held[touched])
        return pa.Table.from_pylist([got], schema=_ARROW)
    return run


def step_gradient(batch: DataFrame, p: dict[str, np.ndarray]):
    """(loss sum, weight sum, gradient) of one bucket of texts. What reaches the
    driver is one row per parameter block, however many tasks there are."""
    spark = batch.sparkSession
    dims = p["E"].shape[1]
    shared = spark.sparkContext.broadcast(p)
    parts = batch.select("ids", "label", "weight").mapInArrow(_step_parts(shared, dims), _PART)
    if batch.rdd.getNumPartitions() > FAN_IN:
        salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
        parts = salted.groupBy("block", "salt").applyInArrow(_sum_parts(dims), _PART)
    rows = parts.groupBy("block").applyInArrow(_sum_parts(dims), _PART).collect()
    shared.unpersist()
    g = {"E": np.zeros_like(p["E"])} | {k: np.zeros_like(p[k]) for k in _DENSE}
    loss = weight = 0.0
    for r in rows:
        sums = np.frombuffer(r["sums"], "<f8")
        if r["block"] < 0:
            loss, weight, at = sums[0], sums[1], 2
            for k in _DENSE:
                g[k] = sums[at:at + p[k].size].reshape(p[k].shape)
                at += p[k].size
        else:
            g["E"][r["block"] * BLOCK_ROWS + np.frombuffer(r["tokens"], "<i4")] = sums.reshape(-1, dims)
    return loss, weight, g


class Adam:
    """Adam with decoupled weight decay and a bound on the gradient's norm."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, decay: float, clip: float = 1.0):
        self.rate, self.decay, self.clip, self.t = rate, decay, clip, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.s = {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.t += 1
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        scale = min(1.0, self.clip / norm) if norm else 1.0
        out = {}
        for k, x in p.items():
            d = g[k] * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.s[k] = 0.999 * self.s[k] + 0.001 * d * d
            move = (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.s[k] / (1 - 0.999 ** self.t)) + 1e-8)
            out[k] = x - self.rate * (move + self.decay * x)
        out["E"][0] = 0.0
        return out


@dataclass
class AttentionClassifier:
    """Fitted parameters, the vocabulary (token -> id) and the history."""
    parameters: dict[str, np.ndarray]
    tokens: dict[str, int]
    max_len: int
    text: str
    history: list[dict]

    def add_scores(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` (a table or a stream) with a struct column ``name``: y_pred,
        confidence, proba, and the attention weight of every kept token."""
        spark = df.sparkSession
        ship_package(spark)
        bound_batches(spark)
        shared = spark.sparkContext.broadcast((self.parameters, self.tokens, self.max_len))

        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            p, tokens, length = shared.value
            for b in batches:
                out = []
                for lo in range(0, len(b), CHUNK):
                    ids = np.zeros((len(b[lo:lo + CHUNK]), length), dtype=np.int64)
                    for i, t in enumerate(b[lo:lo + CHUNK]):
                        got = [tokens.get(x, UNK_IDX) for x in (t if t is not None else ())[:length]]
                        ids[i, :len(got)] = got
                    kinds, _, _, a, _, _, q = forward(p, ids)
                    a = token_weights(ids, kinds, a)
                    out += [{"y_pred": int(q[i].argmax()), "confidence": float(q[i].max()), "proba": q[i],
                             "weights": a[i, :int((ids[i] > 0).sum())]} for i in range(len(ids))]
                yield pd.DataFrame(out, columns=["y_pred", "confidence", "proba", "weights"])

        ddl = "struct<y_pred: int, confidence: double, proba: array<double>, weights: array<double>>"
        return df.withColumn(name, F.pandas_udf(score, ddl)(tokenize(self.text)))

    def history_frame(self, spark: SparkSession, run: str = "attention") -> DataFrame:
        return spark.createDataFrame([(h["epoch"], h["train_loss"], h["val_loss"], h["val_f1_macro"], h["val_accuracy"])
                                      for h in self.history], HISTORY).withColumn("run", F.lit(run))


def macro_f1(counts: dict[tuple[int, int], float], n_classes: int) -> tuple[float, float]:
    """(macro F1, accuracy) of (true, predicted) counts: at most classes squared."""
    m = np.zeros((n_classes, n_classes))
    for (t, q), n in counts.items():
        m[t, q] += n
    hit = np.diag(m)
    both = m.sum(axis=0) + m.sum(axis=1)
    f1 = np.divide(2 * hit, both, out=np.zeros(n_classes), where=both > 0)
    seen = both > 0
    return float(f1[seen].mean()) if seen.any() else 0.0, float(hit.sum() / m.sum()) if m.sum() else 0.0


def _encoded(df: DataFrame, text: str, label: str, tokens: dict[str, int], max_len: int, copies: str | None) -> DataFrame:
    """ids (padded), label, copies: encoded inside the row."""
    spark = df.sparkSession
    ship_package(spark)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(tokens)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for b in batches:
            out = []
            for t in b:
                got = [known.get(x, UNK_IDX) for x in (t if t is not None else ())]
                out.append(np.array(got + [0] * (max_len - len(got)), dtype=np.int32))
            yield pd.Series(out)

    ids = F.pandas_udf(encode, "array<int>")(F.slice(tokenize(text), 1, max_len))
    return df.where(F.col(label).isNotNull()).select(ids.alias("ids"), F.col(label).cast("int").alias("label"),
                                                     (F.col(copies) if copies else F.lit(1)).cast("double").alias("copies"))


def evaluate(val: DataFrame, p: dict[str, np.ndarray]) -> tuple[float, dict[tuple[int, int], float]]:
    """Mean loss and (true, predicted) counts of encoded texts, summed in Spark."""
    shared = val.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        for b in batches:
            y = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            n = b.column("copies").to_numpy(zero_copy_only=False)
            q = np.concatenate([forward(shared.value, _matrix(b.column("ids").slice(lo, CHUNK)))[-1]
                                for lo in range(0, len(y), CHUNK)] or [np.zeros((0, 1))])
            loss = -np.log(np.maximum(q[np.arange(len(y)), y], 1e-12)) * n
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(q.argmax(axis=1)), pa.array(n), pa.array(loss)],
                                             names=["y_true", "y_pred", "n", "loss"])

    rows = (val.mapInArrow(run, "y_true long, y_pred long, n double, loss double").groupBy("y_true", "y_pred")
            .agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).collect())  # at most classes squared
    shared.unpersist()
    seen = sum(r["n"] for r in rows)
    return (sum(r["loss"] for r in rows) / seen if seen else 0.0), {(r["y_true"], r["y_pred"]): r["n"] for r in rows}


def train_attention(train: DataFrame, val: DataFrame, label: str, text: str = "narrative_clean", copies: str | None = None,
                    max_len: int = MAX_LEN, dims: int = 64, n_batches: int = 4, rate: float = 1e-2, decay: float = 1e-4,
                    epochs: int = 15, patience: int = 3, max_vocab: int = MAX_VOCAB, min_freq: int = MIN_FREQ,
                    seed: int = RANDOM_SEED) -> AttentionClassifier:
    """Fit on ``train``, stop by ``val``. Classes weigh alike (balanced weights);
    ``copies`` names a row's multiplicity."""
    vocab = vocab_build(train, text, max_vocab, min_freq).limit(max_vocab + 1).toPandas()
    tokens = dict(zip(vocab["token"], vocab["id"].tolist(), strict=True))
    # equal texts share a bucket; the buckets are folders, so a step reads its own
    enc = _encoded(train, text, label, tokens, max_len, copies) \
        .withColumn("bucket", F.pmod(F.xxhash64("ids", F.lit(seed)), F.lit(n_batches)).cast("int"))
    folder = scratch_path(train.sparkSession, "attention-train")
    n_rows = train.count()  # small tables take few tasks a step: each receives the parameters
    enc.repartition(max(1, -(-n_rows // ROWS_PER_TASK))).write.partitionBy("bucket").parquet(folder)
    path = train.sparkSession.read.schema(enc.schema).parquet(folder)
    counts = {r["label"]: r["n"] for r in path.groupBy("label").agg(F.sum("copies").alias("n")).collect()}  # one row per class
    n_classes = max(counts) + 1
    total = sum(counts.values())
    weights = {k: total / (len(counts) * n) for k, n in counts.items()}
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("label")) * F.col("copies")
    data = path.withColumn("weight", w)
    held = cut_lineage(_encoded(val, text, label, tokens, max_len, copies)
                       .repartition(max(1, -(-val.count() // ROWS_PER_TASK))), "attention-val")
    p = initial(max(tokens.values(), default=UNK_IDX) + 1, n_classes, dims, seed)
    adam = Adam(p, rate, decay)
    best, best_at, history = p, 0, []
    for epoch in range(1, epochs + 1):
        loss_sum = weight_sum = 0.0
        for step in range(n_batches):
            loss, weight, g = step_gradient(data.where(F.col("bucket") == step), p)
            if weight:
                p = adam.step(p, {k: x / weight for k, x in g.items()})
            loss_sum, weight_sum = loss_sum + loss, weight_sum + weight
        val_loss, pairs = evaluate(held, p)
        f1, acc = macro_f1(pairs, n_classes)
        history.append({"epoch": epoch, "train_loss": float(loss_sum / weight_sum) if weight_sum else 0.0,
                        "val_loss": float(val_loss),
                        "val_f1_macro": f1, "val_accuracy": acc})
        if not best_at or f1 > history[best_at - 1]["val_f1_macro"]:
            best, best_at = p, epoch
        elif epoch - best_at >= patience:
            break
    return AttentionClassifier(best, tokens, max_len, text, history)
