"""Op 10. Nearest neighbours by stable projections and a chi-square stop.

Largest inner product becomes nearest Euclidean neighbour by one more
coordinate (sqrt(M^2 - |x|^2), M the largest norm; 0 for queries). Vectors are
projected onto ``DIMS`` Gaussian directions: for a pair at distance d the
projected squared distance is d^2 times a chi-square variable of ``DIMS``
degrees. A kd-tree over the projections yields neighbours in the order of
their projected distance; each is verified on the original vector. The search
of a query stops when a neighbour nearer than its k-th best so far would, with
probability ``SURE``, already have come up: next projected distance^2 >
quantile * (k-th distance / ``APPROX``)^2. The factor asks only for neighbours
``APPROX`` times nearer than those found; without it (1) the test excludes
next to nothing in few dimensions.

Spark holds the tree: its upper cuts come from a bounded sample of the
projections (``SAMPLE`` rows, lowest hashes) and deal every vector into blocks
of about ``BLOCK`` rows; a task builds the lower tree of one block. Round one
sends a query to its ``PROBES`` nearest blocks, round two to exactly those
others that the stop test, with the k-th distance found, cannot exclude. All
rows are indexed and no block is capped; beyond ``BOX_ROWS`` blocks, whose boxes
every task holds, blocks grow instead. Copies of a vector are one index
entry that carries its smallest k + 1 ids, which is all a top-k can need, so a
very common vector costs one entry.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another length than the most
frequent one; rows equal in id and vector count once; null ids take no part;
ties go to the smaller id; fewer candidates than k give fewer rows; of several
vectors of one query id the smallest is asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import arrow_spec, map_arrow, materialise

DIMS = 8
SURE = 0.98
APPROX = 1.7
BLOCK = 8192
LEAF = 64
PROBES = 2
SAMPLE = 20_000
WAVE = 4
BOX_ROWS = 1_000_000
SEED = 11


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """Quantile for an even number of degrees, by bisection of the closed form."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def stop_quantile() -> float:
    """Projected distance^2, as a multiple of the k-th distance^2, that ends a search."""
    return chi_square_quantile(SURE) / APPROX ** 2


def directions(dim: int) -> np.ndarray:
    """(dim + 1, DIMS) Gaussian (2-stable) directions, fixed by the seed."""
    return np.random.default_rng(SEED).standard_normal((dim + 1, DIMS))


def project(x: np.ndarray, top: float, axes: np.ndarray, query: bool = False) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))
    return x @ axes[:-1] + extra[:, None] * axes[-1]


class UpperTree:
    """Median cuts of a sample, as a heap; deals points into 2**depth cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(max(1, 2 ** depth - 1), np.int64)
        self.value = np.zeros(max(1, 2 ** depth - 1))
        groups = [sample]
        at = 0
        for _ in range(depth):
            below = []
            for g in groups:
                k = int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0
                v = float(np.median(g[:, k])) if len(g) else 0.0
                self.axis[at], self.value[at] = k, v
                at += 1
                below += [g[g[:, k] < v], g[g[:, k] >= v]]
            groups = below

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[rows, self.axis[node]] >= self.value[node])
        return node - (2 ** self.depth - 1)


def box_distance(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(p), len(low)))
    for k in range(p.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, k] - p[:, None, k], p[:, None, k] - high[None, :, k]), 0.0)
        out += gap * gap
    return out


def leaves(p: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Rows of each kd-tree leaf: halve the widest side at its median."""
    out, stack = [], [np.arange(len(p))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        k = int(np.argmax(np.ptp(p[rows], axis=0)))
        order = rows[np.argsort(p[rows, k], kind="stable")]
        stack += [order[len(order) // 2:], order[:len(order) // 2]]
    return out


def search_block(x: np.ndarray, p: np.ndarray, q: np.ndarray, pq: np.ndarray, kth: np.ndarray,
                 k: int, top: float, quantile: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Best ``k`` rows of one block for each query: (rows, scores, verified).
    ``kth``: score each query has to beat (-inf: none). Row -1: none."""
    cells = leaves(p)
    low = np.array([p[r].min(0) for r in cells])
    high = np.array([p[r].max(0) for r in cells])
    far = box_distance(pq, low, high)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    best = np.full((len(q), k), -np.inf)
    row = np.full((len(q), k), -1, np.int64)
    norm = (q * q).sum(1)
    live = np.arange(len(q))
    verified = 0
    for begin in range(0, len(cells), WAVE):
        need = np.maximum(kth[live], best[live, -1])
        limit = np.where(np.isfinite(need), quantile * np.maximum(norm[live] + top - 2 * need, 0.0), np.inf)
        live = live[far[live, begin] <= limit]
        if not len(live):
            break
        here = order[live, begin:begin + WAVE]
        width = here.shape[1]
        score = np.full((len(live), width * LEAF), -np.inf)
        at = np.full((len(live), width * LEAF), -1, np.int64)
        flat = here.reshape(-1)
        by = np.argsort(flat, kind="stable")
        cut = np.flatnonzero(np.diff(flat[by], prepend=-1))
        for s, e in zip(cut, [*cut[1:], len(by)], strict=True):
            rows = cells[flat[by[s]]]
            own, slot = by[s:e] // width, by[s:e] % width
            got = q[live[own]] @ x[rows].T
            verified += got.size
            cols = slot[:, None] * LEAF + np.arange(len(rows))
            score[own[:, None], cols] = got
            at[own[:, None], cols] = rows
        score = np.concatenate([best[live], score], axis=1)
        at = np.concatenate([row[live], at], axis=1)
        keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best[live], row[live] = np.take_along_axis(score, keep, 1), np.take_along_axis(at, keep, 1)
    return row, best, verified


def _matrix(column) -> np.ndarray:
    """An arrow list column of equal lengths as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id is not null").filter(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("embedding") == (common["n"] if common else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query
    row (vec_id, embedding), its own id excepted."""
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = usable(vectors)
    # copies: one entry per vector with its smallest k + 1 ids; the partial
    # limit runs before the shuffle, so a common vector is cheap
    first = Window.partitionBy("embedding").orderBy("vec_id")
    entries = materialise(
        rows.withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "ann-entries")
    head = entries.select(F.size("embedding").alias("d"), F.aggregate(
        "embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("norm")) \
        .agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max("norm").alias("top")).first()
    if not head["n"]:
        return spark.createDataFrame([], out)
    top, axes, quantile = head["top"] * (1 + 1e-9), directions(head["d"]), stop_quantile()
    depth = max(0, math.ceil(math.log2(head["n"] / BLOCK)))
    depth = min(depth, int(math.log2(BOX_ROWS)))
    sample = entries.orderBy(F.xxhash64("embedding")).limit(SAMPLE).toArrow()
    tree = UpperTree(project(_matrix(sample.column("embedding")), top, axes), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if b.num_rows:
                p = project(_matrix(b.column("embedding")), top, axes)
                yield {"block": tree.cell(p).astype("int32"), "embedding": b.column("embedding"), "ids": b.column("ids"),
                       "p": list(p)}

    kind = entries.schema["embedding"].dataType.simpleString()
    index = materialise(map_arrow(entries, f"block int, embedding {kind}, ids array<long>, p array<double>", deal), "ann-index")
    # one box a block: at most BOX_ROWS rows
    sides = index.groupBy("block").agg(*[f(F.col("p")[j]).alias(f"{n}{j}") for n, f in (("lo", F.min), ("hi", F.max))
                                         for j in range(DIMS)]).orderBy("block").toPandas()
    blocks = sides["block"].to_numpy()
    low, high = (sides[[f"{n}{j}" for j in range(DIMS)]].to_numpy(np.float64) for n in ("lo", "hi"))
    asked = materialise(usable(queries).filter(F.size("embedding") == head["d"]).groupBy("vec_id")
                        .agg(F.min("embedding").alias("embedding")).withColumnRenamed("vec_id", "query_id"), "ann-queries")
    spec = f"block int, query_id long, embedding {kind}, kth double"

    def route(second: bool):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                q = _matrix(b.column("embedding"))
                far = box_distance(project(q, top, axes, True), low, high)
                near = np.argsort(far, axis=1, kind="stable")[:, :PROBES]
                go = np.zeros(far.shape, bool)
                np.put_along_axis(go, near, True, 1)
                kth = np.full(len(q), -np.inf)
                if second:
                    kth = b.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.where(np.isfinite(kth), quantile * np.maximum((q * q).sum(1) + top - 2 * kth, 0.0), np.inf)
                    go = ~go & (far <= reach[:, None])
                i, j = np.nonzero(go)
                for s in range(0, len(i), 4096):
                    ii, jj = i[s:s + 4096], j[s:s + 4096]
                    yield {"block": blocks[jj].astype("int32"), "query_id": b.column("query_id").take(pa.array(ii)),
                           "embedding": b.column("embedding").take(pa.array(ii)), "kth": pa.array(kth[ii])}
        return run

    found_spec = "query_id long, ids array<long>, score double"
    found_schema = arrow_spec(found_spec)

    def visit(block: pa.Table, ask: pa.Table) -> pa.Table:
        if not block.num_rows or not ask.num_rows:
            return found_schema.empty_table()
        x, p, q = (_matrix(t.column(c)) for t, c in ((block, "embedding"), (block, "p"), (ask, "embedding")))
        kth = ask.column("kth").to_numpy().astype(np.float64)
        parts = []
        for s in range(0, len(q), 256):
            row, _, _ = search_block(x, p, q[s:s + 256], project(q[s:s + 256], top, axes, True), kth[s:s + 256],
                                     k + 1, top, quantile)
            i, j = np.nonzero(row >= 0)
            at = row[i, j]
            # the score proper: a plain sum of products, alike for equal vectors
            exact = (q[s + i] * x[at]).sum(1)
            ok = exact >= kth[s + i]
            parts.append(pa.table({"query_id": ask.column("query_id").take(pa.array(s + i[ok])),
                                   "ids": block.column("ids").take(pa.array(at[ok])), "score": exact[ok]}, schema=found_schema))
        return pa.concat_tables(parts)

    def round_(asks: DataFrame) -> DataFrame:
        return materialise(index.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(visit, found_spec), "ann-found")

    one = round_(map_arrow(asked, spec, route(False)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    kth = one.withColumn("n", place).filter(F.col("n") == k + 1).select("query_id", F.col("score").alias("kth"))
    bounded = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    two = round_(map_arrow(bounded.select("query_id", "embedding", "kth"), spec, route(True)))
    named = one.unionByName(two).select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
