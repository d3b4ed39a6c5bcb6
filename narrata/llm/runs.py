"""Op 12. Periodic runs of words: longest common extensions over suffix trees.

A run is a maximal stretch of words with smallest period q and at least
``max(min_length, 2q)`` words. Every run is found from one of its Lyndon roots:
for each position and each of two opposite orders of words, the longest Lyndon
word that begins there ends before the next smaller suffix; taken as a root of
period p, it is extended to the right and left by longest common extensions.
Both are answered in constant time: Ukkonen's suffix tree of the words and of
their reversal, an Euler tour of its leaves with the depths at its turning
points, and range minima over it (lowest common ancestors), in linear memory.

Only repeated stretches get a tree. In a run of L >= 2q words, each word lies
in a window of ``min_length / 2`` words that recurs q words on or back, since
L - q >= L / 2. So words that no recurring window covers are in no run, and a run
lies within one stretch of covered words. Equal windows have equal hashes; a
collision only keeps more words. Trees thus cost memory for the repetitive part
of one text at a time (about 1 kB a word).

Spark partitions the documents; nothing is shuffled and whole texts are read.

Defined results: a null, empty or blank text has no words and no runs; words are
compared by their bytes; repeated rows are treated alike; result columns of the
caller (``runs``, ``collapsed``, ``n_words``) are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from narrata.llm.common import map_arrow, text_bytes

MIN_LENGTH = 12
#: size of a range-minimum block
BLOCK = 32
_OWN = ("n_words", "runs", "collapsed")


# ---- suffix tree ---------------------------------------------------------------

def ukkonen(s: list[int]) -> tuple[list[int], list[int], dict[int, int], list[int]]:
    """Suffix tree of ``s``, whose last symbol occurs once. Node 0 is the root.
    Returns where each node's edge label starts and ends, the child by
    ``node * width + symbol`` (width: largest symbol + 1) and each node's parent."""
    n = len(s)
    width = max(s) + 1
    start, end, link, parent = [0], [0], [0], [0]
    child: dict[int, int] = {}
    get = child.get
    node = edge = length = pending = 0  # the active point and the suffixes still to add
    for i in range(n):
        pending += 1
        made = 0  # the inner node whose suffix link is open
        c = s[i]
        while pending:
            if not length:
                edge = i
            key = node * width + s[edge]
            below = get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                parent.append(node)
                if made:
                    link[made] = node
                    made = 0
            else:
                at = start[below]
                size = (end[below] if end[below] <= i else i + 1) - at
                if length >= size:  # walk down
                    edge += size
                    length -= size
                    node = below
                    continue
                if s[at + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                split = len(start)  # an inner node takes the upper part of the edge
                child[key] = split
                start.append(at)
                end.append(at + length)
                link.append(0)
                parent.append(node)
                start[below] = at + length
                parent[below] = split
                child[split * width + s[at + length]] = below
                child[split * width + c] = split + 1
                start.append(i)
                end.append(n)
                link.append(0)
                parent.append(split)
                if made:
                    link[made] = split
                made = split
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return start, end, child, parent


class Extensions:
    """Longest common extensions of suffixes of ``s`` (last symbol unique)."""

    def __init__(self, s: list[int]):
        n = len(s)
        start, end, _, parent = ukkonen(s)
        first = np.asarray(s, dtype=np.int64)[np.asarray(start, dtype=np.int64)]
        up = np.asarray(parent, dtype=np.int64)
        # children of every node in symbol order (the root is nobody's child)
        order = np.lexsort((first[1:], up[1:])) + 1
        begins = np.searchsorted(up[order], np.arange(len(start) + 1)).tolist()
        kids = order.tolist()
        # Euler tour: leaves in order, and the depth of the shallowest node
        # passed between one leaf and the next (their lowest common ancestor)
        leaves: list[int] = []
        turns: list[int] = []
        stack = [(0, 0, 0)]
        while stack:
            node, depth, turn = stack.pop()
            lo, hi = begins[node], begins[node + 1]
            if lo == hi:
                leaves.append(n - depth)
                turns.append(turn)
                continue
            for k in range(hi - 1, lo, -1):
                kid = kids[k]
                stack.append((kid, depth + end[kid] - start[kid], depth))
            kid = kids[lo]
            stack.append((kid, depth + end[kid] - start[kid], turn))
        at = np.asarray(leaves, dtype=np.int64)
        self.n = n
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[at] = np.arange(n)
        low = np.asarray(turns, dtype=np.int32)
        # range minima: inside blocks from both ends, sparse table over blocks
        blocks = -(-n // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[:n] = low
        square = padded.reshape(blocks, BLOCK)
        self.low = padded
        self.ahead = np.minimum.accumulate(square, axis=1).ravel()
        self.behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        table = [square.min(axis=1)]
        while 2 ** len(table) <= blocks:
            half = 2 ** (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j (i != j)."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)  # inclusive range of turns
        x, y = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.behind[lo], self.ahead[hi])
        inner = y - x - 1
        wide = np.flatnonzero(inner > 0)
        if len(wide):
            level = np.frexp(inner[wide].astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                w = wide[level == k]
                row = self.table[k]
                out[w] = np.minimum(out[w], np.minimum(row[x[w] + 1], row[y[w] - 2 ** k]))
        same = np.flatnonzero(x == y)
        if len(same):
            p, q = lo[same], hi[same]
            least = self.low[p]
            for d in range(1, BLOCK):
                nxt = p + d
                inside = nxt <= q
                if not inside.any():
                    break
                least = np.where(inside, np.minimum(least, self.low[np.minimum(nxt, q)]), least)
            out[same] = least
        return out.astype(np.int64)


def _next_beyond(rank: list[int], smaller: bool) -> list[int]:
    """Next position of smaller (or greater) rank, else the length."""
    n = len(rank)
    out = [n] * n
    stack: list[int] = []
    values = rank if smaller else [-r for r in rank]
    for i, r in enumerate(values):
        while stack and values[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(ids: list[int], min_length: int = MIN_LENGTH) -> np.ndarray:
    """All runs (start, length, period) of a sequence of positive integers, by
    start, then period."""
    n = len(ids)
    if n < 2:
        return np.empty((0, 3), dtype=np.int64)
    ahead = Extensions([*ids, 0])
    back = Extensions([*ids[::-1], 0])
    rank = ahead.rank.tolist()
    begin = np.arange(n, dtype=np.int64)
    found = []
    for smaller in (True, False):  # the two opposite orders, end mark included
        nxt = np.asarray(_next_beyond(rank, smaller)[:n], dtype=np.int64)
        ok = nxt <= n  # a root lies within the words
        i, p = begin[ok], nxt[ok] - begin[ok]
        right = ahead.lce(i, i + p)
        left = np.zeros_like(right)
        inner = np.flatnonzero(i > 0)
        # words i - 1 and i + p - 1, read backwards
        left[inner] = back.lce(n - i[inner], n - i[inner] - p[inner])
        length = left + p + right
        keep = length >= np.maximum(min_length, 2 * p)
        found.append(np.stack([i[keep] - left[keep], length[keep], p[keep]], axis=1))
    both = np.unique(np.concatenate(found), axis=0)
    return both[np.lexsort((both[:, 2], both[:, 0]))]


# ---- texts -------------------------------------------------------------------

_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2 ** 64 | 1 for k in range(64)], dtype=np.uint64)


def covered(hashes: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Which words a window of ``window`` words covers that recurs in its text.
    ``hashes``: one 64-bit hash a word, ``owner``: its text's number; texts
    follow each other."""
    n = len(hashes)
    out = np.zeros(n, dtype=bool)
    m = n - window + 1
    if m < 2:
        return out
    key = owner[:m].astype(np.uint64) * _MIX[-1]
    for k in range(window):
        key = key + (hashes[k:k + m] ^ (hashes[k:k + m] >> np.uint64(29))) * _MIX[k]
    whole = np.flatnonzero(owner[:m] == owner[window - 1:])  # windows within one text
    order = whole[np.argsort(key[whole], kind="stable")]
    equal = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n + 1, dtype=np.int32)
    hits = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
    np.add.at(again, hits, 1)
    np.add.at(again, hits + window, -1)
    return np.cumsum(again[:n]) > 0


def text_runs(words: list[bytes], repeated: np.ndarray, min_length: int) -> np.ndarray:
    """Runs of a text, from the stretches of its ``repeated`` words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    parts = []
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if hi - lo >= min_length:
            names: dict[bytes, int] = {}
            ids = [names.setdefault(w, len(names) + 1) for w in words[lo:hi]]
            got = runs_of(ids, min_length)
            got[:, 0] += lo
            parts.append(got)
    return np.concatenate(parts) if parts else np.empty((0, 3), dtype=np.int64)


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats, joined by one space: of each run only its
    first period stays."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find(docs: DataFrame, min_length: int = MIN_LENGTH, with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period in
    words, by start, then period) and ``collapsed`` (the text without the
    repeats of its runs, in place of ``text`` unless ``with_text``)."""
    if min_length < 2 or min_length // 2 >= len(_MIX):
        raise ValueError("min_length must be from 2 to 127")
    kept = docs.select(*[c for c in docs.columns if c not in _OWN])
    out = [f for f in kept.schema.fields if with_text or f.name != "text"]
    fields = [f.name for f in out]
    raw = "_bytes"
    while raw in kept.columns:
        raw += "_"
    sent = kept.withColumn(raw, text_bytes()).select(*fields, raw)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), "n_words long",
                     "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])
    window = max(1, min_length // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = [(t or b"").split() for t in b.column(raw).to_pylist()]
            sizes = np.array([len(w) for w in texts], dtype=np.int64)
            hashes = np.concatenate([np.fromiter(map(hash, w), np.int64, len(w)) for w in texts] or [[]]).astype(np.int64)
            repeated = covered(hashes.view(np.uint64), np.repeat(np.arange(len(texts)), sizes), window)
            ends = np.cumsum(sizes)
            found = [text_runs(w, repeated[e - n:e], min_length)
                     for w, n, e in zip(texts, sizes.tolist(), ends.tolist(), strict=True)]
            flat = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            yield {**{c: b.column(c) for c in fields}, "n_words": sizes,
                   "runs": pa.ListArray.from_arrays(pa.array(bounds), structs),
                   "collapsed": pa.array([collapse(w, f) for w, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())}

    return map_arrow(sent, ddl, run)
