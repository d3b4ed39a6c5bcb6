"""Op 7. Quality classifier: generalised additive model with interactions.

Training (driver, bounded): the lowest ``MAX_ROWS`` hashes of labelled training
rows give features; each is cut into at most ``BINS`` quantile bins. Boosting
cycles over the features: a shallow tree on the bins of one feature, fitted to
the logistic gradient, is added to that feature's lookup table. Pairs are then
ranked by how much a two-way table reduces the remaining loss, and the best
``PAIRS`` are boosted the same way as four-leaf trees over two features.
Scoring: bin every feature and add table entries, vectorised, one pass.

Defined results: null and empty texts have the features of no words and get
the score of that cell; training labels other than 0 and 1 are skipped, of
repeated doc_ids the lowest label counts; without both classes every score is
the smoothed label mean. Repeated rows get equal scores; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import map_arrow, text_bytes

MAX_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 6
ROUNDS = 120
RATE = 0.1
THRESHOLD = 0.7
NAMES = ("log_words", "word_bytes", "symbols", "pipes", "doubled", "upper", "stutter", "distinct",
         "dup_lines", "digits", "stops", "commas", "line_words", "code", "non_ascii", "top_word")
_UPPER, _ALPHA = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))
_HIGH = bytes(range(0x80, 0x100))


def features(text: bytes) -> list[float]:
    """Rates of one whole text; all finite, also for an empty text."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))

    def count(chars: bytes) -> int:
        return len(text) - len(text.translate(None, chars))

    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    doubled = sum(map(text.count, (b"!!", b"??", b"##", b"$$", b"&&", b"%%", b"**")))
    return [float(np.log1p(len(words))), len(b"".join(words)) / n, count(b"#*$%&<>") / n, count(b"|") / n,
            doubled / n, count(_UPPER) / max(1, count(_ALPHA)), sum(map(eq, words, words[1:])) / n,
            len(counts) / n ** 0.8, 1 - len(set(lines)) / len(lines) if lines else 0.0, count(b"0123456789") / size,
            count(b".?!") / n, count(b",") / n, len(words) / max(1, len(lines)), count(b"{}=;_/\\[]") / n,
            count(_HIGH) / size, max(counts.values(), default=0) / n]


@dataclass
class Gam:
    """Intercept, one table per feature, one per chosen pair."""
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cut, x[:, k], side="right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"),
                        np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Step function over bins: greedy best splits of gradient and hessian sums."""
    segments = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def gain(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)

    while len(segments) < leaves:
        best = (1e-9, None, None)
        for a, b in segments:
            if b - a > 1:
                c = np.arange(a + 1, b)
                got = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(np.argmax(got))
                if got[k] > best[0]:
                    best = (got[k], (a, b), int(c[k]))
        if best[1] is None:
            break
        a, b = best[1]
        segments.remove((a, b))
        segments += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in segments:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Best four-leaf tree over two features: one cut on each axis."""
    cg = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    ch = cg.copy()
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a_g, a_h = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    top_g, top_h = cg[1:-1, -1:], ch[1:-1, -1:]
    left_g, left_h = cg[-1:, 1:-1], ch[-1:, 1:-1]
    parts = [(a_g, a_h), (top_g - a_g, top_h - a_h), (left_g - a_g, left_h - a_h),
             (tg - top_g - left_g + a_g, th - top_h - left_h + a_h)]
    gains = sum(p * p / (q + ridge) for p, q in parts) - tg * tg / (th + ridge)
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    value = [p[i if p.shape[0] > 1 else 0, j if p.shape[1] > 1 else 0]
             / (q[i if q.shape[0] > 1 else 0, j if q.shape[1] > 1 else 0] + ridge) for p, q in parts]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:] = value[0], value[1]
    out[i + 1:, :j + 1], out[i + 1:, j + 1:] = value[2], value[3]
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of feature tables, then of the best pairs' tables."""
    def cuts_of(k, bins):
        return np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)

    width = x.shape[1]
    cuts, coarse = [cuts_of(k, BINS) for k in range(width)], [cuts_of(k, PAIR_BINS) for k in range(width)]
    p0 = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(p0 / (1 - p0))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [], [])
    if len(set(y.tolist())) < 2:
        return model
    fine = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]
    margin = np.full(len(y), model.intercept)

    def sums(cells, size):
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(cells, y - p, size), np.bincount(cells, p * (1 - p), size)

    for _ in range(ROUNDS):
        for k in range(width):
            step = RATE * _tree(*sums(fine[k], len(cuts[k]) + 1))
            model.tables[k] += step
            margin += step[fine[k]]
    shapes = [len(c) + 1 for c in coarse]

    def cells(i, j):
        return rough[i] * shapes[j] + rough[j]

    ranked = sorted(((_quadrants(*(s.reshape(shapes[i], shapes[j]) for s in sums(cells(i, j), shapes[i] * shapes[j])))[0], i, j)
                     for i, j in combinations(range(width), 2)), key=lambda t: (-t[0], t[1], t[2]))
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.grids = [np.zeros((shapes[i], shapes[j])) for i, j in model.pairs]
    for _ in range(ROUNDS // 2):
        for grid, (i, j) in zip(model.grids, model.pairs, strict=True):
            at = cells(i, j)
            _, tree = _quadrants(*(s.reshape(shapes[i], shapes[j]) for s in sums(at, shapes[i] * shapes[j])))
            grid += RATE * tree
            margin += RATE * tree.reshape(-1)[at]
    return model


def held_out() -> F.Column:
    """crc32 of the doc_id's decimal text, remainder 2 by 4 (null: not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """Fit on the ``max_rows`` lowest hashes of labelled rows not held out."""
    marked = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out()) \
        .groupBy("doc_id").agg(F.min("quality").alias("q")) \
        .orderBy(F.xxhash64("doc_id", F.lit("gam")), "doc_id").limit(max_rows)

    def run(batches):
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "q": b.column("q"),
                   "x": [features(t) for t in b.column("text").to_pylist()]}

    chosen = docs.select(F.col("doc_id").cast("long"), text_bytes()).join(F.broadcast(marked), "doc_id")
    rows = map_arrow(chosen.dropDuplicates(["doc_id"]), "doc_id long, q int, x array<double>", run).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r["q"] for r in rows], np.float64))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted``."""
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            x = np.array([features((t or "").encode()) for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            p = model.score(x)
            yield {**{f.name: b.column(f.name) for f in keep}, "score": pa.array(p),
                   "predicted": pa.array((p >= THRESHOLD).astype("int32"))}

    return map_arrow(docs.select(*[f.name for f in keep]), ddl, run)
