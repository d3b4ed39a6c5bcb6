"""Op 1. Deleted-interpolation bigram language model.

p(w | h) = l2 * c(h,w)/c(h) + l1 * c(w)/N + l0 / (V + 1), where the weights
(l2, l1, l0) depend on a bucket of the context's frequency c(h) (powers of
two), as maximum-likelihood estimates of frequent contexts deserve more trust.
The weights come from expectation-maximisation on held-out counts: one training
fold in ten is deleted from the counts and predicted from the other nine.

Data flow. Whole documents are packed into blocks of about ``BLOCK_TOKENS``
tokens (the deleted fold into its own), written once to the shared folder with
block-local word numbers. Every block asks for its distinct words and bigrams
once: sorted 64-bit keys with the block's own training and deleted counts, cut
into key ranges. One shuffle brings a key range of all blocks together; its
task adds the counts up and answers each block with the totals alone, in the
order of the question. Counts are complete: nothing is pruned. A frequent word
or bigram costs one entry a block, so no key is hot. A second shuffle brings
answers and blocks together, and each block scores its documents by array
look-ups; the weights need the deleted fold's blocks only.

The deleted fold's statistics reach the driver as a table of bounded size:
(context bucket, log-ratio cells of the three estimates) with counts and mean
ratios, at most ``BUCKETS * CELLS**2`` rows at any corpus size.

Keys are 64-bit hashes of words and of word pairs; two of n distinct keys
collide with probability n^2 / 2^65, negligible for the counts of a model.

Defined results: a null or empty text is its end token alone; null doc_ids
train and are not held out; repeated rows each count and each get a score; an
empty table gives no rows; texts are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import arrow_spec, map_arrow, materialise, text_bytes

BLOCK_TOKENS = 2_000_000
BUCKETS = 32
CELLS = 48
FOLDS = 10
EM_ROUNDS = 60
RANGE_TOKENS = 1_500_000  # tokens of input for each key range
_BLOCK = "block long, deleted boolean, docs binary, lens binary, ids binary, words binary, folds binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(s)) for s in (b" </s>", b" <s>"))  # no word holds a blank


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit key for (context, word), not symmetric."""
    with np.errstate(over="ignore"):
        x = h * _MIX + (w ^ (w >> np.uint64(29)))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


# ------------------------------------------------------------------ blocks

class _Packer:
    """Collects whole documents until a block is full."""

    def __init__(self, deleted: bool):
        self.deleted = deleted
        self.clear()

    def clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.doc: list[int | None] = []
        self.lens: list[int] = []
        self.folds: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, fold: int, words: list[bytes]) -> None:
        table = self.table
        got = [table.setdefault(w, len(table) + 1) for w in words]
        got.append(0)
        self.ids.append(np.array(got, np.uint32))
        self.doc.append(doc_id)
        self.lens.append(len(got))
        self.folds.append(fold)
        self.size += len(got)

    def block(self, number: int) -> dict:
        out = {"block": [number], "deleted": [self.deleted],
               "docs": [np.array([d or 0 for d in self.doc], "<i8").tobytes() + bytes(d is None for d in self.doc)],
               "lens": [np.array(self.lens, "<i8").tobytes()],
               "ids": [np.concatenate(self.ids).astype("<u4").tobytes()],
               "words": [np.concatenate([[END], hash_words(list(self.table))]).astype("<u8").tobytes()],
               "folds": [bytes(self.folds)]}
        self.clear()
        return out


def blocks(docs: DataFrame, deleted: int) -> DataFrame:
    """Rows of packed documents: doc ids and null flags, token counts, word
    numbers (0 is the end token), word hashes, folds (crc32 mod 10)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        packers = [_Packer(False), _Packer(True)]
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                fold = 1 if d is None else zlib.crc32(str(d).encode()) % FOLDS
                p = packers[fold == deleted]
                p.add(d, fold, t.as_py().lower().split())
                if p.size >= BLOCK_TOKENS:
                    yield p.block(number)
                    number += 1
        for p in packers:
            if p.doc:
                yield p.block(number)
                number += 1

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_bytes()), _BLOCK, run)


class Packed:
    """A block read back, with its distinct keys and where each token's are."""

    def __init__(self, row: dict, deleted: int):
        n = len(row["folds"])
        self.doc_ids = np.frombuffer(row["docs"], "<i8", n)
        self.null = np.frombuffer(row["docs"], "u1", n, 8 * n).astype(bool)
        self.lens = np.frombuffer(row["lens"], "<i8")
        ids = np.frombuffer(row["ids"], "<u4").astype(np.int64)
        words = np.frombuffer(row["words"], "<u8")
        self.folds = np.frombuffer(row["folds"], "u1")
        self.ends = np.cumsum(self.lens)
        first = np.zeros(len(ids), bool)
        first[(self.ends - self.lens)] = True
        before = np.concatenate([[0], ids[:-1]])
        before[first] = len(words)  # the context that begins a document
        self.fold = deleted
        fold = np.repeat(self.folds, self.lens)
        self.train, self.deleted = fold != 0, fold == deleted
        v = len(words) + 1
        pair, self.pair_at = np.unique(before * v + ids, return_inverse=True)
        hashes = np.concatenate([words, [BEGIN]])
        self.keys2, self.order2, self.at2 = _sorted(pair_keys(hashes[pair // v], hashes[pair % v]), self.pair_at)
        self.keys1, self.order1, place = _sorted(hashes, np.concatenate([ids, before]))
        self.at1, self.ctx1 = place[:len(ids)], place[len(ids):]

    def counts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, training counts, of those deleted) of bigrams, words and
        contexts; a word's context count differs only for begin and end."""
        out = []
        for keys, at in ((self.keys2, self.at2), (self.keys1, self.at1)):
            out.append((keys, np.bincount(at, self.train, len(keys)).astype(np.int64),
                        np.bincount(at, self.deleted, len(keys)).astype(np.int64)))
        # the begin mark occurs once a document, as a context only
        k = int(np.searchsorted(self.keys1, BEGIN))
        out[1][1][k], out[1][2][k] = int((self.folds != 0).sum()), int((self.folds == self.fold).sum())
        return out


def _sorted(keys: np.ndarray, at: np.ndarray):
    """Sorted distinct keys, and ``at`` renumbered to them."""
    uniq, inverse = np.unique(keys, return_inverse=True)
    return uniq, inverse, inverse[at]


# ------------------------------------------------- requests and answers

def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal key ranges begins in sorted keys."""
    edges = (np.arange(1, n, dtype=np.float64) * (2.0 ** 64 / n)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences: high planes are nearly
    constant, and the shuffle's compression removes them."""
    if not len(keys):
        return b""
    gap = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(gap.astype("<u8").view("u1").reshape(-1, 8).T).tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _pack_counts(c: np.ndarray) -> bytes:
    """Counts as bytes, with 255 marking an entry of the 64-bit overflow list."""
    return np.minimum(c, 255).astype("u1").tobytes() + c[c >= 255].astype("<i8").tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(raw, "u1", n).astype(np.int64)
    c[c == 255] = np.frombuffer(raw, "<i8", -1, n) if len(raw) > n else 0
    return c


_ASK = "part int, kind int, block long, deleted boolean, keys binary, train binary, gone binary"
_ANSWER = "block long, deleted boolean, kind int, part int, train binary, gone binary, types long, kept_types long"


def exchange_counts(packed: DataFrame, parts: int, deleted: int) -> DataFrame:
    """Answers (block, kind, part, train, gone): corpus counts of the keys of
    every question, in its order, and once a range its number of types."""

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                for kind, (keys, train, gone) in enumerate(Packed(row, deleted).counts()):
                    cut = _ranges(keys, parts)
                    for p, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                        if e > s:
                            yield {"part": [p], "kind": [kind], "block": [row["block"]], "deleted": [row["deleted"]],
                                   "keys": [_pack_keys(keys[s:e])], "train": [_pack_counts(train[s:e])],
                                   "gone": [_pack_counts(gone[s:e])]}

    asked = map_arrow(packed, _ASK, ask)
    answer_schema = arrow_spec(_ANSWER)

    def answer(table: pa.Table) -> pa.Table:
        """Adds up one key range of one kind and answers every block in it."""
        rows = table.select(["block", "deleted"]).to_pylist()
        keys = [_unpack_keys(r.as_py()) for r in table.column("keys")]
        lens = [len(k) for k in keys]

        def joined(name):
            return np.concatenate([_unpack_counts(r.as_py(), n) for r, n in zip(table.column(name), lens, strict=True)])

        uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
        train = np.bincount(at, joined("train"), len(uniq)).astype(np.int64)
        gone = np.bincount(at, joined("gone"), len(uniq)).astype(np.int64)
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        cut = np.cumsum([0, *lens])
        out = [{**r, "kind": kind, "part": part, "train": _pack_counts(train[at[s:e]]),
                "gone": _pack_counts(gone[at[s:e]]), "types": 0, "kept_types": 0}
               for r, s, e in zip(rows, cut[:-1], cut[1:], strict=True)]
        if kind == 1:
            word = uniq != BEGIN
            out[0] |= {"types": int((word & (train > 0)).sum()), "kept_types": int((word & (train > gone)).sum())}
        return pa.Table.from_pylist(out, schema=answer_schema)

    return asked.groupBy("part", "kind").applyInArrow(answer, _ANSWER)


def _known(block: Packed, answers: list[dict], parts: int):
    """[bigram train, bigram deleted, word train, word deleted] counts of the
    whole corpus for the block's keys."""
    out = []
    for kind, keys in enumerate((block.keys2, block.keys1)):
        cut = _ranges(keys, parts)
        train, gone = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for a in answers:
            if a["kind"] == kind:
                at = slice(int(cut[a["part"]]), int(cut[a["part"] + 1]))
                train[at] = _unpack_counts(a["train"], at.stop - at.start)
                gone[at] = _unpack_counts(a["gone"], at.stop - at.start)
        out += [train, gone]
    return out


# --------------------------------------------------------------- weights

def bucket_of(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 count), bounded."""
    return np.where(c > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(c, 1)).astype(np.int64)), 0)


def estimates(c2, ch, c1, total: int, types: int):
    """The three component probabilities of every token."""
    return np.where(ch > 0, c2 / np.maximum(ch, 1), 0.0), c1 / max(1, total), np.full(len(c1), 1.0 / (types + 1))


def cells(bucket, p2, p1, p0):
    """Cell numbers and the log ratios p2/p0 and p1/p0 that EM depends on."""
    r2, r1 = np.log2(1 + p2 / p0), np.log2(1 + p1 / p0)
    cell = (np.minimum(CELLS - 1, r2 * 1.5).astype(np.int64) * CELLS + np.minimum(CELLS - 1, r1 * 1.5).astype(np.int64))
    return bucket * CELLS * CELLS + cell, r2, r1


def learn_weights(rows: list, rounds: int = EM_ROUNDS) -> np.ndarray:
    """(BUCKETS, 3) weights (l2, l1, l0) by EM on (cell, n, sum r2, sum r1)."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    if not rows:
        return weights
    cell = np.array([r["cell"] for r in rows], np.int64)
    n = np.array([r["n"] for r in rows], np.float64)
    ratio = np.stack([2 ** (np.array([r["r2"] for r in rows]) / n) - 1,
                      2 ** (np.array([r["r1"] for r in rows]) / n) - 1, np.ones(len(n))], axis=1)
    bucket = cell // (CELLS * CELLS)
    for _ in range(rounds):
        post = weights[bucket] * ratio
        post *= (n / post.sum(1))[:, None]
        # half a count each way keeps rare buckets and the uniform part alive
        mass = np.stack([np.bincount(bucket, post[:, k], BUCKETS) for k in range(3)], axis=1) + 0.5
        mass[0, 0] = 0.0
        weights = mass / mass.sum(1, keepdims=True)
    return weights


# ----------------------------------------------------------------- scoring

def score(docs: DataFrame, deleted: int = FOLDS - 1) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Learns from folds 1 to 9, fold 0 is held out."""
    packed = materialise(blocks(docs, deleted), "lm-blocks")

    def totals(batches):
        for b in batches:
            for row in b.to_pylist():
                lens, folds = np.frombuffer(row["lens"], "<i8"), np.frombuffer(row["folds"], "u1")
                yield {"n": [int(lens.sum())], "train": [int(lens[folds != 0].sum())],
                       "gone": [int(lens[folds == deleted].sum())]}

    size = map_arrow(packed.select("lens", "folds"), "n long, train long, gone long", totals) \
        .agg(F.sum("n").alias("n"), F.sum("train").alias("train"), F.sum("gone").alias("gone")).first()
    if not size["n"]:
        return docs.sparkSession.createDataFrame([], _SCORED)
    total, gone_total = size["train"], size["gone"]
    parts = max(1, -(-size["n"] // RANGE_TOKENS))
    answers = materialise(exchange_counts(packed, parts, deleted), "lm-counts")
    types = answers.agg(F.sum("types").alias("all"), F.sum("kept_types").alias("kept")).first()
    n_types, n_kept_types = types["all"], types["kept"]
    payload, reply = ("docs", "lens", "ids", "words", "folds"), ("kind", "part", "train", "gone")
    meet = packed.select("block", "deleted", *payload, *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in reply]) \
        .unionByName(answers.select("block", "deleted", *[F.lit(None).cast("binary").alias(c) for c in payload], *reply))

    def rows_of(table: pa.Table):
        rows = table.to_pylist()
        own = next(r for r in rows if r["docs"] is not None)
        block = Packed(own, deleted)
        return block, _known(block, [r for r in rows if r["docs"] is None], parts)

    stat_schema = arrow_spec("cell long, n double, r2 double, r1 double")

    def stats(table: pa.Table) -> pa.Table:
        """Sums of the deleted fold's tokens by cell, under the kept counts."""
        block, (c2, g2, c1, g1) = rows_of(table)
        on = block.deleted
        c2, ch, c1 = (c2 - g2)[block.at2][on], (c1 - g1)[block.ctx1][on], (c1 - g1)[block.at1][on]
        p2, p1, p0 = estimates(c2, ch, c1, total - gone_total, n_kept_types)
        cell, r2, r1 = cells(bucket_of(ch), p2, p1, p0)
        uniq, at = np.unique(cell, return_inverse=True)
        k = len(uniq)
        return pa.table({"cell": uniq, "n": np.bincount(at, minlength=k).astype(np.float64),
                         "r2": np.bincount(at, r2, k), "r1": np.bincount(at, r1, k)}, schema=stat_schema)

    held = meet.filter("deleted").groupBy("block").applyInArrow(stats, "cell long, n double, r2 double, r1 double") \
        .groupBy("cell").agg(F.sum("n").alias("n"), F.sum("r2").alias("r2"), F.sum("r1").alias("r1"))
    weights = learn_weights(sorted(held.collect(), key=lambda r: r["cell"]))  # <= BUCKETS * CELLS**2 rows
    score_schema = arrow_spec(_SCORED)

    def scored(table: pa.Table) -> pa.Table:
        block, (c2, _, c1, _) = rows_of(table)
        word = c1[block.at1]
        ch = c1[block.ctx1]
        p2, p1, p0 = estimates(c2[block.at2], ch, word, total, n_types)
        mix = weights[bucket_of(ch)]
        p = mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] * p0
        base = np.log10((word + 0.1) / (total + 0.1 * (n_types + 1)))
        start = block.ends - block.lens
        ids = pa.array(block.doc_ids, type=pa.int64(), mask=block.null)
        return pa.table({"doc_id": ids, "held_out": block.folds == 0, "n_tokens": block.lens,
                         "n_known": np.add.reduceat((word > 0).astype(np.int64), start),
                         "train_tokens": np.full(len(start), total, np.int64),
                         "base_score": np.add.reduceat(base, start),
                         "score": np.add.reduceat(np.log10(p), start)}, schema=score_schema)

    return meet.groupBy("block").applyInArrow(scored, _SCORED)


_SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")
