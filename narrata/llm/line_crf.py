"""Op 5. Quality rules by line labelling with a linear-chain CRF.

Every line of a document is marked content or boilerplate by Viterbi decoding;
the share of words on content lines decides whether the document stays. Base
rules (minimum words, repeated three-word windows) reject before that.

Training: a bounded, documented sample (``MAX_DOCS`` labelled documents of each
quality, chosen by a hash, all lines of each) gives document labels, not line
labels. Those are learned by hard expectation-maximisation: the lines of a
document are decoded, first by the prior weights, under the constraint that its
label puts on its content share (at least ``MIN_CONTENT`` of the words of a good
document, less of a bad one); the weights then maximise the penalised conditional
likelihood of the decoded sequences (forward-backward, full-batch ascent), for
``ROUNDS`` rounds. A good document may thus hold boilerplate lines and a bad one
content. Without labels of both classes the prior weights stand.

Scoring is one pass without a shuffle. Defined results: a null or empty text
has no words and fails the base rules; blank lines carry no words and are not
part of the sequence; texts are read whole; repeated rows are judged alike;
other columns are kept, result columns of the same name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import map_arrow, text_bytes

MAX_DOCS = 1000
MIN_CONTENT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
ROUNDS = 5
FEATURES = ("bias", "symbols", "doubled", "upper", "stutter", "repeats", "short", "digits",
            "seen", "code", "long_words", "open_end")
_SYMBOLS, _DIGITS, _CODE = b"#*$%&|<>", b"0123456789", b"{}=;/\\_[]"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
_CONT = bytes(range(0x80, 0xC0))
#: prior evidence for boilerplate, used when labels are missing and as the
#: centre of the penalty
PRIOR = np.array([-2.0, 4.0, 4.0, 3.0, 5.0, 1.5, 0.5, 1.0, 2.0, 2.0, 0.0, 0.2])


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[float]:
    n = len(words)
    size = max(1, len(line))

    def share(chars: bytes) -> float:
        return (len(line) - len(line.translate(None, chars))) / size

    upper, lower = share(_UPPER), share(_LOWER)
    doubled = (line.count(b"!!") + line.count(b"??") + line.count(b"##") + line.count(b"$$")
               + line.count(b"&&") + line.count(b"%%") + line.count(b"**")) / n
    return [1.0, min(1.0, share(_SYMBOLS) * size / n), min(1.0, doubled),
            upper / (upper + lower) if upper else 0.0,
            sum(map(eq, words, words[1:])) / n, 1.0 - len(set(words)) / n,
            1.0 / n, share(_DIGITS), float(seen), min(1.0, 10 * share(_CODE)),
            min(1.0, size / n / 40), float(line.rstrip()[-1:] not in b".!?:\"'")]


@dataclass
class Scan:
    """What one text gives: base counts, line features, words per line."""
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray
    words: np.ndarray


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v < 1 << 21:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:  # exact at any vocabulary
        _, pair = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)
        key = pair * v + a[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k:n - 2 + k] |= twice
    return int(mark.sum())


def scan(text: bytes) -> Scan:
    rows, sizes, seen = [], [], set()
    words: list[bytes] = []
    dup = 0
    for line in text.split(b"\n"):
        ws = line.split()
        if not ws:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        rows.append(line_features(line, ws, again))
        sizes.append(len(ws))
        words += ws
    joined = b"".join(words)
    return Scan(len(words), len(joined.translate(None, _CONT)),
                len(text) - len(text.translate(None, _SYMBOLS)), dup, repeat_words(words),
                np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64))


# ------------------------------------------------------------------ the CRF

@dataclass
class Crf:
    """Binary chain: ``weights`` for boilerplate, ``start`` and ``trans``."""
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray

    @classmethod
    def prior(cls) -> Crf:
        return cls(PRIOR.copy(), np.zeros(2), np.array([[0.5, -0.5], [-0.5, 0.5]]))

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """Most probable labels (True: boilerplate) of one line sequence."""
        n = len(x)
        if n == 0:
            return np.zeros(0, bool)
        emit = (x @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.trans.tolist()
        s0, s1 = float(self.start[0]), float(self.start[1]) + emit[0]
        back = []
        for e in emit[1:]:
            from1_0, from1_1 = s1 + t10 > s0 + t00, s1 + t11 > s0 + t01
            s0, s1 = (s1 + t10 if from1_0 else s0 + t00), (s1 + t11 if from1_1 else s0 + t01) + e
            back.append((from1_0, from1_1))
        at = s1 > s0
        out = [at]
        for b in reversed(back):
            at = b[at]
            out.append(at)
        return np.array(out[::-1], bool)

    def gradient(self, x: np.ndarray, y: np.ndarray, on: np.ndarray):
        """Gradient of the mean log-likelihood of padded sequences
        (x: docs x lines x features, y: labels, on: line exists)."""
        docs, lines = y.shape
        edge = np.exp(self.trans)
        emit = np.ones((docs, lines, 2))
        raw = x @ self.weights  # scaled so that the larger of both is one
        emit[:, :, 0], emit[:, :, 1] = np.exp(np.minimum(0, -raw)), np.exp(np.minimum(0, raw))
        alpha = np.zeros((docs, lines, 2))
        alpha[:, 0] = np.exp(self.start) * emit[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, lines):
            step = (alpha[:, t - 1] @ edge) * emit[:, t]
            step /= step.sum(1, keepdims=True)
            alpha[:, t] = np.where(on[:, t, None], step, alpha[:, t - 1])
        beta = np.full((docs, 2), 0.5)
        g_w, g_t = np.zeros_like(self.weights), np.zeros((2, 2))
        expected = np.zeros((docs, lines))
        for t in range(lines - 1, -1, -1):
            post = alpha[:, t] * beta
            expected[:, t] = post[:, 1] / post.sum(1) * on[:, t]
            if t:
                inner = emit[:, t] * beta
                pair = alpha[:, t - 1, :, None] * edge * inner[:, None, :]
                g_t -= (pair / pair.sum((1, 2), keepdims=True))[on[:, t]].sum(0)
                before = inner @ edge.T
                before /= before.sum(1, keepdims=True)
                beta = np.where(on[:, t, None], before, beta)
        g_w += np.einsum("dl,dlf->f", y * on - expected, x)
        live = on[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                g_t[a, b] += (live & (y[:, :-1] == a) & (y[:, 1:] == b)).sum()
        first = expected[:, 0]
        g_s = np.array([(first - y[:, 0]).sum(), (y[:, 0] - first).sum()])
        return g_w / docs, g_s / docs, g_t / docs


def _buckets(xs: list[np.ndarray], marks: list[np.ndarray]) -> list[tuple]:
    """Padded (x, y, on) of sequences whose lengths lie within a factor of two."""
    by: dict[int, list[int]] = {}
    for k, f in enumerate(xs):
        by.setdefault(len(f).bit_length(), []).append(k)
    out = []
    for _, ks in sorted(by.items()):
        lines = max(len(xs[k]) for k in ks)
        x = np.zeros((len(ks), lines, len(FEATURES)))
        y, on = np.zeros((len(ks), lines), np.int64), np.zeros((len(ks), lines), bool)
        for d, k in enumerate(ks):
            x[d, :len(xs[k])], y[d, :len(xs[k])], on[d, :len(xs[k])] = xs[k], marks[k], True
            y[d, len(xs[k]):] = marks[k][-1]
        out.append((x, y, on))
    return out


def _gradient(model: Crf, buckets: list[tuple]) -> list[np.ndarray]:
    """Gradient of the mean log-likelihood over the documents of all buckets."""
    total = sum(len(y) for _, y, _ in buckets)
    parts = [[g * (len(y) / total) for g in model.gradient(x, y, on)] for x, y, on in buckets]
    return [sum(p) for p in zip(*parts, strict=True)]


def _fit(model: Crf, buckets: list[tuple], rounds: int = 80, rate: float = 0.1, penalty: float = 0.002) -> Crf:
    """Adam ascent; the penalty pulls towards the prior."""
    prior = Crf.prior()
    params = [model.weights.copy(), model.start.copy(), model.trans.copy()]
    centre = [prior.weights, prior.start, prior.trans]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        for i, g in enumerate(_gradient(Crf(*params), buckets)):
            g = g - penalty * (params[i] - centre[i])
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9 ** k)) / (np.sqrt(v[i] / (1 - 0.99 ** k)) + 1e-8)
    return Crf(*params)


def constrained(model: Crf, x: np.ndarray, good: bool, min_content: float = MIN_CONTENT) -> np.ndarray:
    """Labels of a document's lines under its own label: the decoding, with the
    evidence for boilerplate shifted no further than the constraint asks."""
    size = np.rint(1.0 / x[:, FEATURES.index("short")])
    marks = model.viterbi(x)
    met = lambda m: (size[~m].sum() >= min_content * size.sum()) == good
    if met(marks):
        return marks
    sign = -1.0 if good else 1.0

    def at(shift: float) -> np.ndarray:
        w = model.weights.copy()
        w[0] += sign * shift
        return Crf(w, model.start, model.trans).viterbi(x)

    low, high = 0.0, 1.0
    while not met(at(high)) and high < 1e6:
        low, high = high, 2 * high
    for _ in range(12):
        mid = (low + high) / 2
        low, high = (low, mid) if met(at(mid)) else (mid, high)
    return at(high)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Crf:
    """Fit on at most ``max_docs`` labelled documents per class; the sample is
    the lowest hashes of doc_id, so reruns agree."""
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    order = F.xxhash64("doc_id", F.lit("crf"))
    picked = None
    for q in (0, 1):
        part = marked.filter(F.col("q") == q).orderBy(order, "doc_id").limit(max_docs)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.select(F.col("doc_id").cast("long"), text_bytes()) \
        .join(F.broadcast(picked), "doc_id")  # at most 2 * max_docs rows

    def features(batches):
        for b in batches:
            got = [scan(t).features for t in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "q": b.column("q"),
                   "x": [f.astype("<f8").tobytes() for f in got]}

    # repeated doc_ids could exceed the bound: one text of each is enough
    rows = map_arrow(chosen.dropDuplicates(["doc_id"]), "doc_id long, q int, x binary", features).collect()
    rows.sort(key=lambda r: r["doc_id"])
    xs = [np.frombuffer(r["x"], "<f8").reshape(-1, len(FEATURES)) for r in rows]
    use = [k for k, f in enumerate(xs) if len(f)]
    q = np.array([rows[k]["q"] for k in use])
    if not len(use) or len(set(q.tolist())) < 2:
        return Crf.prior()
    xs = [xs[k] for k in use]
    return learn(xs, q == 1)


def learn(xs: list[np.ndarray], good: np.ndarray, rounds: int = ROUNDS) -> Crf:
    """Expectation-maximisation from document labels over line features."""
    model = Crf.prior()
    for _ in range(rounds):
        marks = [constrained(model, f, g).astype(np.int64) for f, g in zip(xs, good.tolist(), strict=True)]
        model = _fit(model, _buckets(xs, marks), rounds=40)
    return model


def judge(docs: DataFrame, model: Crf, min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``content_share``,
    ``line_labels`` (one character per line with words: c or b) and ``kept``."""
    result = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "base_failed", "content_share", "line_labels", "kept")
    keep = [f for f in docs.schema.fields if f.name not in result]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{c} long" for c in result[:5]),
                     "base_failed boolean, content_share double, line_labels string, kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = {c: [] for c in result}
            for t in b.column("text").to_pylist():
                s = scan((t or "").encode())
                marks = model.viterbi(s.features)
                share = float(s.words[~marks].sum()) / s.n_words if s.n_words else 0.0
                failed = s.n_words < MIN_WORDS or 100 * s.n_repeat_words > MAX_REPEAT_PCT * s.n_words
                for c in result[:5]:
                    out[c].append(getattr(s, c))
                out["base_failed"].append(failed)
                out["content_share"].append(share)
                out["line_labels"].append("".join("b" if m else "c" for m in marks))
                out["kept"].append(not failed and share >= min_content)
            yield {**{f.name: b.column(f.name) for f in keep}, **out}

    return map_arrow(docs.select(*[f.name for f in keep]), ddl, run)
