"""Op 2. Token ids as files of static range-asymmetric-numeral-system blocks.

All blocks share one frequency table, counted over the whole corpus and
quantised to ``2**SCALE_BITS`` slots (every id of the vocabulary keeps at least
one). A block holds whole documents and is coded by ``LANES`` interleaved 64-bit
coder states that renormalise through one stream of 32-bit words. Every
``STEPS`` steps the encoder records the lane states, the stream position and a
checksum of the ids up to the next record, so each stretch between two such
checkpoints decodes on its own and in any order; blocks are independent too.

File format: a folder with a Parquet table ``blocks`` (file_no, block_no,
n_ids, payload) whose payload is the self-contained byte layout below, and a
Parquet table ``table`` (id, slots), the shared frequencies. Parquet is the
container because Spark commits it atomically on any store, so a retried task
leaves no half block.

Payload, little-endian: magic ``RNS1``; u32 documents, lanes, steps per
checkpoint, checkpoints, words, table checksum; u64 ids; per document i64
doc_id, u8 null flag, u64 ids; per checkpoint u64 word position, u32 crc32 of
its ids, u64 state per lane; then the u32 words.

Order: ascending doc_id (null first; equal doc_ids by a hash of their ids).
Defined results: a null or empty text contributes the end id only; an empty
table gives empty files; a document longer than a block gets a larger block.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from narrata.llm.common import BATCH_ROWS, documents, is_small, join_keyed, map_arrow, materialise
from narrata.session import scratch_path

SCALE_BITS = 18
LANES = 1024
STEPS = 256
BLOCK_IDS = 1 << 20
FILE_IDS = 8 << 20
#: chunks of each of the cache's two generations
CACHE_CHUNKS = 400_000
#: bytes of the texts that are encoded at once
TEXT_BYTES = 4_000_000
#: longest first chunk of a text whose ids are kept
FIRST_CHARS = 64
#: stands before a chunk that no space precedes
GLUE = "\x01"
_INK = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: places inside a chunk where a pre-token always begins: a mark or line break after a Latin letter or digit, and
#: a line's beginning after a single line break
BREAKS = ("([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,;:!?\n])", rf"({_INK}\n)({_INK})")
#: stands for the ids of a chunk that cannot be encoded apart from its text; ids take a multiple of four bytes
WHOLE = b"whole"
_LOW = np.uint64(1 << 31)
_MAGIC = b"RNS1"
_HEAD = struct.Struct("<4s6IQ")


# ---------------------------------------------------------------- coding

class Table:
    """Quantised frequencies: ``slots[id]`` of ``2**SCALE_BITS`` per id."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots.astype("<u4")
        self.f = slots.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(slots)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(slots), dtype=np.uint32), slots)
        self.crc = zlib.crc32(self.slots.tobytes())
        if len(self.symbol) != 1 << SCALE_BITS:
            raise ValueError("frequency table does not fill its slots")

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """One slot for every id, the rest in proportion, ties to lower ids."""
        room = (1 << SCALE_BITS) - len(counts)
        if room < 0:
            raise ValueError("vocabulary exceeds the slots")
        share = counts.astype(np.float64) * room / max(1, counts.sum())
        slots = np.floor(share).astype(np.int64)
        left = room - int(slots.sum())
        if not counts.sum():
            slots[0] += left
        else:
            order = np.argsort(slots - share, kind="stable")
            slots[order[:left]] += 1
        return cls(slots + 1)


def encode_ids(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS):
    """(checkpoints, words): ids are laid out row by row over the lanes."""
    n = len(ids)
    rows = -(-n // lanes)
    padded = np.full(rows * lanes, int(np.argmax(table.slots)), dtype=np.int64)
    padded[:n] = ids
    f = table.f[padded].reshape(rows, lanes)
    c = table.c[padded].reshape(rows, lanes)
    top = f << np.uint64(63 - SCALE_BITS)
    x = np.full(lanes, _LOW, dtype=np.uint64)
    bits, half = np.uint64(SCALE_BITS), np.uint64(32)
    out: list[np.ndarray] = []
    size, marks = 0, []
    for r in range(rows - 1, -1, -1):
        fr = f[r]
        over = x >= top[r]
        low = x[over]
        out.append(low.astype(np.uint32))
        size += len(low)
        x[over] = low >> half
        q = x // fr
        x = (q << bits) + (x - q * fr) + c[r]
        if r % steps == 0:
            marks.append((size, zlib.crc32(ids[r * lanes:(r + steps) * lanes].astype("<u4").tobytes()), x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return [(size - s, crc, state) for s, crc, state in reversed(marks)], words


def decode_stretch(mark, n: int, words: np.ndarray, table: Table) -> np.ndarray:
    """The ``n`` ids that follow one checkpoint, verified by its checksum."""
    at, crc, state = mark
    lanes = len(state)
    x = state.copy()
    rows = -(-n // lanes)
    out = np.empty((rows, lanes), dtype=np.uint32)
    bits, half, mask = np.uint64(SCALE_BITS), np.uint64(32), np.uint64((1 << SCALE_BITS) - 1)
    f, c, symbol = table.f, table.c, table.symbol
    for r in range(rows):
        slot = x & mask
        s = symbol[slot]
        out[r] = s
        x = f[s] * (x >> bits) + slot - c[s]
        need = x < _LOW
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << half) | words[at:at + k]
            at += k
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("block checksum does not match")
    return ids


def pack_block(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, table: Table) -> bytes:
    marks, words = encode_ids(ids, table)
    parts = [_HEAD.pack(_MAGIC, len(doc_ids), LANES, STEPS, len(marks), len(words), table.crc, len(ids)),
             np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
             np.array([d is None for d in doc_ids], "u1").tobytes(),
             np.array(sizes, "<u8").tobytes()]
    for at, crc, state in marks:
        parts += [struct.pack("<QI", at, crc), state.astype("<u8").tobytes()]
    return b"".join([*parts, words.astype("<u4").tobytes()])


class Block:
    """A parsed payload; ``stretch(k)`` decodes from checkpoint k to k + 1."""

    def __init__(self, payload: bytes, table: Table):
        magic, n, lanes, self.steps, marks, words, crc, self.n_ids = _HEAD.unpack_from(payload)
        if magic != _MAGIC or crc != table.crc:
            raise ValueError("not a block of this frequency table")
        at = _HEAD.size

        def take(dtype, count):
            nonlocal at
            got = np.frombuffer(payload, dtype, count, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.sizes = take("<u8", n).astype(np.int64)
        self.marks = []
        for _ in range(marks):
            pos, check = struct.unpack_from("<QI", payload, at)
            at += 12
            self.marks.append((pos, check, take("<u8", lanes).astype(np.uint64)))
        self.words = take("<u4", words).astype(np.uint64)
        self.lanes, self.table = lanes, table

    def stretch(self, k: int) -> np.ndarray:
        size = self.steps * self.lanes
        return decode_stretch(self.marks[k], min(size, self.n_ids - k * size), self.words, self.table)

    def ids(self) -> np.ndarray:
        got = [self.stretch(k) for k in range(len(self.marks))]
        return np.concatenate(got) if got else np.zeros(0, np.uint32)


# ------------------------------------------------------------- tokenizing

class Chunked:
    """The library's encoder with a cache of text chunks.

    A single space before a non-space always begins a pre-token, so a text
    without other spaces falls into chunks that are encoded independently; so do
    a word, the marks behind it and a new line's first word, so that a word is encoded
    once whatever marks follow it. The chunks a batch lacks are joined, one space (a line
    break, if none precedes them) before each, and encoded by the library as one text; its
    ids are cut again where a token begins with that character, which only a chunk's
    first token does. Texts with other spaces or with a special token's string are encoded
    by the library as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        # ids whose tokens begin with a space or a line break (their byte symbols)
        self.spaced, self.broken = (np.isin(np.arange(max(vocab.values()) + 1), [i for t, i in vocab.items() if t.startswith(x)])
                                    for x in ("\u0120", "\u010a"))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(" " in t for t in self.special):
            raise ValueError("a special token holds a space")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, chunks: list[str], mark: str, begins: np.ndarray, skip: int) -> list[bytes]:
        """Ids of each chunk, without its first ``skip`` ids, from one text with a ``mark`` before each."""
        ids = np.array(self.library.encode_batch_fast([mark + mark.join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(begins[ids])
        if len(cut) != len(chunks):
            raise ValueError("a chunk does not begin with one mark")
        raw = ids.tobytes()
        ends = [*(4 * cut[1:]).tolist(), len(raw)]
        return list(map(raw.__getitem__, map(slice, (4 * (cut + skip)).tolist(), ends)))

    def _fill(self, new: list[str]) -> None:
        chunks, glued = [], []
        for c in new:
            if (got := self.older.get(c)) is not None:
                self.cache[c] = got
            elif c.isalpha():
                chunks.append(c)
            elif not c or c[0].isspace():
                self.cache[c] = WHOLE  # a text with such a chunk is not cut
            elif c[0] != GLUE:
                chunks.append(c)
            elif c[1:].split() == [c[1:]]:
                glued.append(c)
            else:
                self.cache[c] = self._whole(c[1:])
        if chunks:
            self.cache.update(zip(chunks, self._joined(chunks, " ", self.spaced, 0), strict=True))
        if glued:
            self.cache.update(zip(glued, self._joined([c[1:] for c in glued], "\n", self.broken, 1), strict=True))

    def _first(self, chunk: str) -> bytes:
        """Ids of a text's first chunk, which no space precedes."""
        got = self.first.get(chunk)
        if got is None:
            got = self._whole(chunk)
            if len(chunk) <= FIRST_CHARS:
                self.first[chunk] = got
        return got

    def encode(self, texts: pa.Array, end: bytes = b"", dtype: str = "<u4") -> tuple[np.ndarray, pa.Array]:
        """Numbers of ids and ids, as little-endian integers, of whole texts, ``end``
        after each. Chunks are told apart by Arrow: Python sees each distinct chunk of
        a batch once, and the texts' ids are gathered from the distinct chunks' ids."""
        if not len(texts):
            return np.zeros(0, np.int64), pa.array([], pa.binary())
        if len(self.cache) > CACHE_CHUNKS:  # what is met again moves back
            self.cache, self.older = {}, self.cache
        if len(self.first) > CACHE_CHUNKS:
            self.first.clear()
        apart = pc.match_substring(texts, GLUE)
        for t in self.special:
            apart = pc.or_(apart, pc.match_substring(texts, t))
        cut = pc.if_else(apart, "", texts)
        for place in BREAKS:
            cut = pc.replace_substring_regex(cut, place, rf"\1 {GLUE}\2")
        parts = pc.split_pattern(cut, " ")  # at least one part a text
        n = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        begin = np.cumsum(n) - n
        coded = parts.flatten().dictionary_encode()
        piece = np.asarray(coded.indices).astype(np.int64)
        chunks = coded.dictionary.to_pylist()
        ids = list(map(self.cache.get, chunks))
        if missing := [k for k, x in enumerate(ids) if x is None]:
            self._fill([chunks[k] for k in missing])
            for k in missing:
                ids[k] = self.cache[chunks[k]]
        # pieces: the distinct chunks, each text's beginning, the end, nothing
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        uncut = size == len(WHOLE)
        for k in np.flatnonzero(uncut).tolist():
            ids[k] = b""
        later = np.ones(len(piece), bool)
        later[begin] = False
        text = np.repeat(np.arange(len(n)), n)
        whole = np.asarray(apart) | (np.bincount(text[later & uncut[piece]], minlength=len(n)) > 0)
        extra = [self._whole(texts[i].as_py()) if w else self._first(chunks[k])
                 for i, (k, w) in enumerate(zip(piece[begin].tolist(), whole.tolist(), strict=True))] + [end, b""]
        size = np.concatenate([np.where(uncut, 0, size), np.fromiter(map(len, extra), np.int64, len(extra))]) // 4
        piece[later & whole[text]] = len(size) - 1
        piece[begin] = len(chunks) + np.arange(len(n))
        piece = np.insert(piece, begin + n, len(size) - 2)
        flat = np.frombuffer(b"".join([*ids, *extra]), "<u4").astype(dtype)
        length = size[piece]
        shift = (np.cumsum(size) - size)[piece] - (np.cumsum(length) - length)
        out = flat[np.repeat(shift, length) + np.arange(length.sum())]
        per_text = np.add.reduceat(length, begin + np.arange(len(n)))
        ends = np.concatenate([[0], np.cumsum(per_text)]) * out.itemsize
        return per_text, pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())


_LOADED: dict[str, Chunked] = {}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``TEXT_BYTES`` bytes: the more texts, the fewer distinct chunks a word."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TEXT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenize(docs: DataFrame, path: str, end_id: int = 2, dtype: str = "<u4") -> DataFrame:
    """(doc_id, n, ids binary): number and ids of the whole text, with ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = _LOADED.setdefault(path, None) or Chunked(path)
        _LOADED[path] = enc
        for docs in _joined(batches):
            n, ids = enc.encode(docs.column("text").fill_null(""), end, dtype)
            for lo in range(0, len(n), BATCH_ROWS):
                part = slice(lo, lo + BATCH_ROWS)
                yield {"doc_id": docs.column("doc_id")[part], "n": pa.array(n[part]), "ids": ids[part]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n long, ids binary", run)


# ----------------------------------------------------------------- files

def count_table(ids: DataFrame, vocab: int) -> Table:
    """Shared table from the counts of all ids (at most ``vocab`` rows reach
    the driver, whatever the corpus)."""

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for b in batches:
            raw = b"".join(b.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(raw, "<u2"), minlength=vocab)
        seen = np.flatnonzero(total)
        yield {"id": pa.array(seen.astype("int32")), "n": pa.array(total[seen])}

    rows = map_arrow(ids.select("ids"), "id int, n long", run).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table.of_counts(counts)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, vocab: int = 50_257,
              file_ids: int = FILE_IDS) -> str:
    """Tokenise, count, sort by doc_id over range partitions (one file each)
    and encode blocks. Returns ``path``."""
    if vocab > 1 << 16:
        raise ValueError("ids are staged as 16-bit integers")
    spark = docs.sparkSession

    staged = materialise(tokenize(docs, tokenizer, end_id, "<u2"), "rans-ids")
    table = count_table(staged, vocab)
    spark.createDataFrame([(i, int(s)) for i, s in enumerate(table.slots.tolist())],
                          "id int, slots int").coalesce(1).write.parquet(f"{path}/table")
    total = staged.agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-total // file_ids))
    slots = spark.sparkContext.broadcast(table.slots)

    def encode(batches):
        shared = Table(slots.value)
        file_no, block_no = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            payload = pack_block([d for d, _, _ in held], [n for _, n, _ in held],
                                 np.frombuffer(b"".join(r for _, _, r in held), "<u2"), shared)
            return {"file_no": [file_no], "block_no": [block_no], "n_ids": [size], "payload": [payload]}

        for b in batches:
            for row in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(),
                           b.column("ids").to_pylist(), strict=True):
                if held and size + row[1] > BLOCK_IDS:
                    yield flush()
                    held, size, block_no = [], 0, block_no + 1
                held.append(row)
                size += row[1]
        if held:
            yield flush()

    tie = F.xxhash64("ids").alias("tie")
    ranged = (staged.select("doc_id", "n", "ids", tie)
              .repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie")
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
              .select("doc_id", "n", "ids"))
    map_arrow(ranged, "file_no int, block_no int, n_ids long, payload binary", encode) \
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary u32) of every document, from the
    files alone; ``start`` counts the ids of all documents before it."""
    table = spark.read.schema("id int, slots int").parquet(f"{path}/table")
    if not is_small(table, 1 << 16):
        raise ValueError("frequency table too long")
    got = np.zeros(table.count(), np.int64)
    for r in table.collect():
        got[r["id"]] = r["slots"]
    slots = spark.sparkContext.broadcast(got)
    blocks = spark.read.schema("file_no int, block_no int, n_ids long, payload binary").parquet(f"{path}/blocks")
    # starts: prefix sums inside files, and over the per-file totals
    sizes = blocks.select("file_no", "block_no", "n_ids")
    in_file = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file_no", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    starts = (sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(in_file), F.lit(0)))
              .join(bases, "file_no")
              .select("file_no", "block_no", (F.col("base") + F.col("inside")).alias("first")))
    placed = join_keyed(blocks, starts, ["file_no", "block_no"])

    def run(batches):
        shared = Table(slots.value)
        for b in batches:
            for first, payload in zip(b.column("first").to_pylist(), b.column("payload"), strict=True):
                block = Block(payload.as_py(), shared)
                ids = block.ids()
                ends = np.cumsum(block.sizes)
                begin = ends - block.sizes
                raw = ids.astype("<u4").tobytes()
                for k in range(0, len(begin), 512):
                    part = slice(k, k + 512)
                    yield {"doc_id": block.doc_ids[part], "start": pa.array(begin[part] + first),
                           "n_tokens": pa.array(block.sizes[part]),
                           "ids": [raw[4 * s:4 * e] for s, e in zip(begin[part].tolist(), ends[part].tolist(), strict=True)]}

    return map_arrow(placed.select("first", "payload"),
                     "doc_id long, start long, n_tokens long, ids binary", run)


def round_trip(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    """Write ``documents`` in the file format and read the files back."""
    path = scratch_path(spark, "rans")
    return read_ids(spark, write_ids(documents(spark, sf_dir), path, tokenizer))
