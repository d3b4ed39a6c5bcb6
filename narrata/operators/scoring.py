"""Batched scoring with an outside (NumPy) model through Arrow batches.

``predict_batch_udf`` ships column batches to Python as NumPy arrays, calls
the model once per batch and caches the loaded model per Python worker; it
is the vectorised path for models Spark cannot express natively.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_IN, N_OUT = 64, 10
SCORE_TYPE = T.StructType([T.StructField("y_pred", T.IntegerType()),
                           T.StructField("confidence", T.DoubleType())])


def fixed_linear_weights(n_in: int = N_IN, n_out: int = N_OUT) -> np.ndarray:
    """Deterministic demo weights: W[i, j] = ((7 i + 3 j) mod 11 - 5) / 10."""
    i = np.arange(n_in)[:, None]
    j = np.arange(n_out)[None, :]
    return (((7 * i + 3 * j) % 11) - 5) / 10.0


def make_linear_predict_fn(weights: np.ndarray | None = None):
    def make():
        w = fixed_linear_weights() if weights is None else weights

        def predict(x: np.ndarray) -> dict:
            logits = x.astype(np.float64) @ w
            z = logits - logits.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            return {"y_pred": p.argmax(axis=1).astype(np.int32), "confidence": p.max(axis=1)}
        return predict
    return make


def linear_scores(vec: Column | str, batch_size: int = 64, weights: np.ndarray | None = None,
                  n_in: int = N_IN) -> Column:
    udf = predict_batch_udf(make_linear_predict_fn(weights), return_type=SCORE_TYPE,
                            batch_size=batch_size, input_tensor_shapes=[[n_in]])
    c = F.col(vec) if isinstance(vec, str) else vec
    return udf(c.cast("array<double>"))


def linear_weights_sql(n_in: int = N_IN, n_out: int = N_OUT) -> list[str]:
    w = fixed_linear_weights(n_in, n_out)
    return ["[" + ", ".join(repr(float(w[i, j])) for i in range(n_in)) + "]" for j in range(n_out)]
