"""Op 6. SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: one bit per XXH64 bit that is set in over half of the shingles'
hashes, repeats counted. Copies share a fingerprint, so all further work is on
distinct fingerprints.

Links (at most ``distance`` differing bits): two linked fingerprints agree on
at least one of ``distance + 1`` bit fields, so every fingerprint is dealt to
one group per field value, which loses no link. A task builds the index over
one group: fingerprints sorted by their rank in Gray order, in which
neighbours differ in few bits; leaves of ``LEAF`` consecutive fingerprints; and
upper nodes of ``LEAF`` children each. A node keeps the bits that all its
fingerprints share (mask and pattern). The self-join descends pairs of nodes
and drops a pair, and so whole groups, once its accumulated differences on the
shared bits exceed the distance, or once both sides are already one component.
Only a spanning forest of each group leaves the task, never its pairs.

A group of over ``SPLIT`` fingerprints is first dealt again by the fields of
its other bits (the same argument loses no link), so a popular field value
does not meet in one task. Components: minimum labels by large-star and
small-star steps on the forest's edges, materialised each round.

Defined results: null, empty and blank texts have fingerprint zero, linked like
any other; texts with fewer words than a shingle hash their whole word
sequence; null doc_ids take part in links but never name a component unless
all ids of it are null; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import join_keyed, map_arrow, materialise

LEAF = 32
SPLIT = 50_000
SEED = 42


# ------------------------------------------------------------ fingerprints

def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the shingle hashes of one text (UTF-8)."""
    ws = text.lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in
                           zip(starts[:len(ws) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)],
                          dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k:k + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, carry: bool = False) -> DataFrame:
    """(row_id, doc_id, fp): fingerprints as signed 64-bit integers; with
    ``carry`` also the text and an ``others`` column of ``docs``."""
    kept = [f for f in docs.schema.fields if carry and f.name in ("text", "others")]
    ddl = ", ".join(["row_id long, doc_id long, fp long", *(f"{f.name} {f.dataType.simpleString()}" for f in kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            fps = [fingerprint((t or "").encode(), shingle) for t in b.column("text").to_pylist()]
            yield {"row_id": pa.array(range(row, row + len(fps)), type=pa.int64()), "doc_id": b.column("doc_id"),
                   "fp": pa.array(np.array(fps, "<u8").view("<i8")), **{f.name: b.column(f.name) for f in kept}}
            row += len(fps)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", *[f.name for f in kept if f.name != "text"]), ddl, run)


# -------------------------------------------------------- Gray-order index

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence (prefix xor)."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Sorted fingerprints and, level by level, the (pattern, mask) of nodes."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.leaf = leaf
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (pattern, mask of shared bits)
        both, either = self.fps, self.fps
        while True:
            cut = np.arange(0, len(both), leaf)
            both, either = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut)
            self.levels.append((both, ~(both ^ either)))
            if len(both) == 1:
                break

    def leaf_pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that may hold a link: descend pairs of nodes, drop a
        pair once it differs in over ``distance`` of the bits both sides share.
        Depth first in bounded pieces, so memory stays small on any group."""
        leaves = np.arange(len(self.levels[0][0]))
        yield leaves, leaves
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(self.leaf)
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                if (keep := a < b).any():
                    yield a[keep], b[keep]
                continue
            pattern, mask = self.levels[level - 1]
            xs = np.repeat(a[:, None] * self.leaf + step, self.leaf, axis=1).reshape(-1)
            ys = np.tile(b[:, None] * self.leaf + step, (1, self.leaf)).reshape(-1)
            ok = (xs <= ys) & (ys < len(pattern))
            xs, ys = xs[ok], ys[ok]
            far = np.bitwise_count((pattern[xs] ^ pattern[ys]) & mask[xs] & mask[ys]) > distance
            xs, ys = xs[~far], ys[~far]
            order = np.argsort(ys - xs, kind="stable")  # near leaves first
            xs, ys = xs[order], ys[order]
            stack += [(level - 1, xs[k:k + 1024], ys[k:k + 1024]) for k in range(0, len(xs), 1024)][::-1]

    def forest(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges (index pairs into ``fps``) of a spanning forest of all links.
        Leaf pairs that already are one component are not compared."""
        n, leaf = len(self.fps), self.leaf
        root = np.arange(n)
        cut = np.arange(0, n, leaf)
        padded = np.concatenate([self.fps, np.zeros(-n % leaf, np.uint64)]).reshape(-1, leaf)
        left: list[int] = []
        right: list[int] = []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = int(root[i])
            return i

        for xs, ys in self.leaf_pairs(distance):
            for k in range(0, len(xs), 256):
                x, y = xs[k:k + 256], ys[k:k + 256]
                while not np.array_equal(up := root[root], root):
                    root[:] = up
                low, high = np.minimum.reduceat(root, cut), np.maximum.reduceat(root, cut)
                open_ = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
                x, y = x[open_], y[open_]
                near = np.bitwise_count(padded[x][:, :, None] ^ padded[y][:, None, :]) <= distance
                p, i, j = np.nonzero(near)
                gx, gy = x[p] * leaf + i, y[p] * leaf + j
                ok = (gx < gy) & (gy < n)
                gx, gy = gx[ok], gy[ok]
                ok = root[gx] != root[gy]
                for s, t in zip(gx[ok].tolist(), gy[ok].tolist(), strict=True):
                    a, b = find(s), find(t)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        left.append(s)
                        right.append(t)
        return np.array(left, np.int64), np.array(right, np.int64)


def fields(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of ``distance + 1`` fields that cover ``bits`` bits."""
    if distance < 1:
        raise ValueError("distance 0 links equal fingerprints only: group by fp instead")
    cuts = [round(bits * k / (distance + 1)) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _field(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): edges among distinct fingerprints whose components equal those
    of all links at ``distance`` bits. ``distinct`` has one row per ``fp``."""
    cut = fields(distance)
    dealt = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), _field(F.col("fp"), s, w).alias("v")) for k, (s, w) in enumerate(cut)])).alias("g")) \
        .select("fp", "g.k", "g.v")
    # the sizes of groups: (distance + 1) * 2**13 rows at most, partially summed
    big = materialise(dealt.groupBy("k", "v").count().filter(F.col("count") > SPLIT).select("k", "v"), "simhash-hot")
    if big.isEmpty():
        keyed = dealt.withColumn("w", F.lit(-1).cast("long"))
    else:
        hot = F.broadcast(big)  # at most (distance + 1) * 2**13 rows
        rest = dealt.join(hot, ["k", "v"], "left_anti").withColumn("w", F.lit(-1).cast("long"))
        # the bits outside field k, cut into distance + 1 fields again
        rest_of = F.lit(None)
        for k, (s, w) in enumerate(cut):
            fp = F.col("fp")
            turned = F.shiftrightunsigned(fp, s + w).bitwiseOR(F.shiftleft(fp, 64 - s - w)) if s + w < 64 else fp
            rest_of = F.when(F.col("k") == k, F.array(*[
                _field(turned, a, b) * 64 + j for j, (a, b) in enumerate(fields(distance, 64 - w))])).otherwise(rest_of)
        again = dealt.join(hot, ["k", "v"], "left_semi").select("k", "v", "fp", F.explode(rest_of).alias("w"))
        keyed = rest.select("k", "v", "fp", "w").unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Groups arrive in order; each is indexed when its last row is seen."""
        held: list[np.ndarray] = []
        key = None

        def joined() -> dict | None:
            fps = np.concatenate(held)
            if len(fps) < 2:
                return None
            index = GrayIndex(fps.view(np.uint64))
            i, j = index.forest(distance)
            own = index.fps.view(np.int64)
            return {"a": pa.array(own[i]), "b": pa.array(own[j])} if len(i) else None

        for batch in batches:
            ks, fps = batch.column("g").to_numpy(), batch.column("fp").to_numpy()
            cut = [0, *(np.flatnonzero(ks[1:] != ks[:-1]) + 1).tolist(), len(ks)]
            for s, t in zip(cut[:-1], cut[1:], strict=True):
                if s == t:
                    continue
                if held and ks[s] != key:
                    if (out := joined()) is not None:
                        yield out
                    held = []
                key = ks[s]
                held.append(fps[s:t])
        if held and (out := joined()) is not None:
            yield out

    # one long per group; should two groups collide they are indexed together,
    # which compares more and loses nothing
    group = F.xxhash64("k", "v", "w").alias("g")
    return map_arrow(keyed.select(group, "fp").repartition("g").sortWithinPartitions("g"),
                     "a long, b long", run)


# ------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest reachable node, by alternating large-star and
    small-star steps until the edge set no longer changes. Each round is
    written to the shared folder; a node's edges are reduced to its minimum
    before any shuffle join, so a hub does not gather in one row."""
    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "cc")
    seen = None
    while True:
        # large star: every larger neighbour of a node goes to its minimum
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to their minimum
        e1 = large.filter("a <> b").distinct()
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        small = e1.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(low.select("a", F.col("m").alias("b")))
        e = materialise(small.filter("a <> b").distinct(), "cc")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        seen = now


def classes(fps: DataFrame, distance: int) -> DataFrame:
    """(node, comp, component_id) of every distinct fingerprint: the class label
    (a fingerprint) and the smallest doc_id of the class."""
    named = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    edges = materialise(links(named.select("fp"), distance), "simhash-links")
    comps = components(edges)
    member = named.join(comps, named["fp"] == comps["node"], "left") \
        .select("fp", "low", F.coalesce("comp", "fp").alias("comp"))
    least = member.groupBy("comp").agg(F.min("low").alias("component_id"))
    return member.join(least, "comp").select(F.col("fp").alias("node"), "comp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document. Copies share a
    fingerprint, so the class of a fingerprint reaches its documents by a salted join."""
    fps = materialise(fingerprints(docs, shingle), "simhash")
    table = materialise(classes(fps, distance).select(F.col("node").alias("fp"), "component_id"), "simhash-classes")
    out = join_keyed(fps, table, ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, text, others): one document of each class, that of the smallest
    doc_id (of rows that share it, the first)."""
    found = materialise(fingerprints(docs, shingle, carry=True), "simhash-rows")
    table = classes(found.select("fp", "doc_id"), distance)
    first = found.select("row_id", "doc_id", "fp").join(table, F.col("fp") == F.col("node")) \
        .groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id"))).alias("w")) \
        .select(F.col("w.row_id").alias("row_id"))
    return found.join(first, "row_id", "left_semi").drop("row_id", "fp")
