"""Attention pooling against a plain NumPy computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.operators.pooling import attention_pool, attention_weights

RNG = np.random.default_rng(3)
X = RNG.normal(size=(40, 4))
GROUP = np.where(np.arange(40) < 25, 0, np.arange(40) % 3 + 1)
MASK = np.arange(40) % 4 != 0
MASK[GROUP == 2] = False  # one group without a live vector


def _numpy(v, W, b, mask):
    h = X @ W.T + b
    s = np.where(mask, np.tanh(h) @ v, -1e9)
    weights = np.zeros(40)
    for g in set(GROUP.tolist()):
        at = GROUP == g
        e = np.exp(s[at] - s[at].max())
        weights[at] = e / e.sum()
    return weights


@pytest.mark.parametrize("scale", [1.0, 200.0])  # constant shift, then the group maximum
@pytest.mark.parametrize("masked", [False, True])
def test_pooling_with_weights_bias_and_mask(spark, scale, masked):
    v, W, b = RNG.normal(size=4) * scale, RNG.normal(size=(4, 4)), RNG.normal(size=4)
    df = spark.createDataFrame([(i, int(GROUP[i]), X[i].tolist(), bool(MASK[i])) for i in range(40)],
                               "id long, g int, x array<double>, live boolean")
    mask = F.col("live") if masked else None
    want = _numpy(v, W, b, MASK if masked else np.ones(40, bool))
    got = attention_weights(df, "g", "x", v.tolist(), W.tolist(), b.tolist(), mask)
    weights = dict(got.select("id", "weight").collect())
    assert np.allclose([weights[i] for i in range(40)], want, atol=1e-9)
    pooled = {(r["g"], r["dim"]): r["value"] for r in
              attention_pool(df, "g", "x", v.tolist(), W.tolist(), b.tolist(), mask).collect()}
    for g in set(GROUP.tolist()):
        assert np.allclose([pooled[g, d] for d in range(4)], (want[GROUP == g, None] * X[GROUP == g]).sum(0), atol=1e-5)
