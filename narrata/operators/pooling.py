"""Score arrays: softmax, argmax, top-k probabilities, weight normalisation,
and additive-attention pooling over a long table of vectors.

Array work uses higher-order functions (``transform``/``aggregate``) that
run inside whole-stage codegen; pooling over groups is one partial
aggregation on a long table, so no group's vectors are ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK_FILL = -1e9


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    A value referenced inside a per-element lambda (``transform``) would
    otherwise be recomputed for every element: O(n^2) per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits, mask=None) -> Column:
    """Numerically stable softmax; ``mask`` (array<boolean>) sets masked
    positions to -1e9 first. Max and sum are computed once per array."""
    x = _c(logits)
    if mask is not None:
        x = F.zip_with(x, _c(mask), lambda v, m: F.when(m, v).otherwise(F.lit(MASK_FILL)))

    def with_x(xs):
        def with_ex(ex):
            return let(F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v),
                       lambda total: F.transform(ex, lambda v: v / total))
        return let(let(F.array_max(xs), lambda mx: F.transform(xs, lambda v: F.exp(v - mx))),
                   with_ex)
    return let(x, with_x)


def argmax(scores) -> Column:
    """0-based index of the first maximum."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def top_probabilities(df: DataFrame, id_col: str, proba: str, labels: list[str],
                      pred_col: str, k: int = 8) -> DataFrame:
    """Top-k (label, probability) pairs per row, highest first, with a flag
    on the predicted label. Labels are zipped with probabilities as a map."""
    m = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), _c(proba))
    entries = F.map_entries(m)
    ranked = F.array_sort(entries, lambda a, b: F.when(a["value"] > b["value"], -1)
                          .when(a["value"] < b["value"], 1)
                          .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1)
                          .otherwise(0))
    pred_name = F.element_at(F.array(*[F.lit(x) for x in labels]), _c(pred_col) + 1)
    out = df.select(id_col, pred_name.alias("_pred"),
                    F.posexplode(F.slice(ranked, 1, k)).alias("pos", "e"))
    return out.select(id_col, (F.col("pos") + 1).alias("rank"), F.col("e.key").alias("label"),
                      F.round("e.value", 6).alias("probability"),
                      (F.col("e.key") == F.col("_pred")).alias("is_pred"))


def normalize_weights(weights, k: int | None = None, first: int | None = None) -> Column:
    """w / (max(w) + 1e-9), optionally only the first ``k`` entries.

    The maximum is that of all weights; with ``first`` the weights are cut to that many
    before, and the maximum is that of those kept."""
    if first is not None:
        weights = F.slice(_c(weights), 1, first)
    out = let(_c(weights), lambda w: let(
        F.array_max(w), lambda mx: F.transform(w, lambda v: v / (mx + F.lit(1e-9)))))
    return F.slice(out, 1, k) if k else out


#: exp(-2 * bound) stays a normal double up to this bound
_MAX_SHIFT = 300.0


def attention_score(vec, v: list[float], W: list[list[float]] | None = None,
                    b: list[float] | None = None) -> Column:
    """v . tanh(W h + b) of one vector, inside the row (W = I, b = 0 if absent)."""
    h = F.transform(_c(vec), lambda x: x.cast("double"))

    def row(r, bias):
        return F.aggregate(F.zip_with(F.array(*[F.lit(float(w)) for w in r]), h, lambda w, x: w * x),
                           F.lit(float(bias)), lambda acc, x: acc + x)
    if W is not None:
        h = F.array(*[row(r, b[i] if b else 0.0) for i, r in enumerate(W)])
    elif b is not None:
        h = F.zip_with(h, F.array(*[F.lit(float(x)) for x in b]), lambda x, y: x + y)
    vs = F.array(*[F.lit(float(x)) for x in v])
    return F.aggregate(F.zip_with(vs, h, lambda c, x: c * F.tanh(x)), F.lit(0.0), lambda acc, x: acc + x)


def _scored(df: DataFrame, group: str, vec: str, v: list[float], W, b, mask) -> DataFrame:
    """Rows with ``_e`` = exp(score - shift), zero where ``mask`` is not true.

    Softmax does not depend on the shift. tanh bounds every score by
    sum(|v|), so that constant serves as the shift and no group maximum is
    needed; beyond ``_MAX_SHIFT`` the group's own maximum is joined instead."""
    s = attention_score(vec, v, W, b)
    live = F.lit(True) if mask is None else F.coalesce(_c(mask), F.lit(False))
    bound = sum(abs(float(x)) for x in v)
    if bound <= _MAX_SHIFT:
        return df.withColumn("_e", F.when(live, F.exp(s - F.lit(bound))).otherwise(F.lit(0.0)))
    scored = df.withColumn("_s", F.when(live, s))
    top = scored.groupBy(F.col(group).alias("_g")).agg(F.max("_s").alias("_m"))
    return (scored.join(top, scored[group].eqNullSafe(top["_g"]))
                  .withColumn("_e", F.coalesce(F.exp(F.col("_s") - F.col("_m")), F.lit(0.0)))
                  .drop("_s", "_m", "_g"))


def attention_pool(df: DataFrame, group: str, vec: str, v: list[float],
                   W: list[list[float]] | None = None, b: list[float] | None = None,
                   mask: str | Column | None = None) -> DataFrame:
    """Additive attention pooling per group: (group, dim, value).

    score(h) = v . tanh(W h + b); weights = softmax of the scores within the
    group; pooled_i = sum_h weight(h) * h_i. Scores are computed inside the
    row; numerator and denominator are two sums of one aggregation on
    (group, dim), partial in the scan stage, so one scan and one exchange of
    (groups x dims) partial rows do all, and a hot group is no hot task.
    Masked vectors weigh nothing; a group of only masked vectors is pooled with
    equal weights, as a softmax over equal fill values gives."""
    long = _scored(df, group, vec, v, W, b, mask).select(
        group, "_e", F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    z = F.sum("_e")
    value = F.when(z > 0, F.sum(F.col("_e") * F.col("x")) / z).otherwise(F.avg("x"))
    return long.groupBy(group, "dim").agg(F.round(value, 6).alias("value")) \
               .select(group, F.col("dim").cast("int").alias("dim"), "value")


def attention_weights(df: DataFrame, group: str, vec: str, v: list[float],
                      W: list[list[float]] | None = None, b: list[float] | None = None,
                      mask: str | Column | None = None) -> DataFrame:
    """``df`` with ``weight``, each vector's share in its group's pooling."""
    scored = _scored(df, group, vec, v, W, b, mask)
    total = scored.groupBy(F.col(group).alias("_g")).agg(F.sum("_e").alias("_z"), F.count(F.lit(1)).alias("_c"))
    weight = F.when(F.col("_z") > 0, F.col("_e") / F.col("_z")).otherwise(1.0 / F.col("_c"))
    return (scored.join(total, scored[group].eqNullSafe(total["_g"]))
                  .select(*df.columns, weight.alias("weight")))
