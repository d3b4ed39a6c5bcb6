"""Op 9. BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one last token: the vocabulary
token that ends there, and that the token before it tolerates. Two adjacent
tokens tolerate each other when byte-pair encoding of their concatenation
would keep the seam, which depends on the two tokens only, so the answer is
stored per pair. The tokens ending at each position come from an automaton
over the vocabulary that reports every token that is a suffix of what was
read. Back-pointers (token lengths) from the end of the word give the ids;
no merge is ever simulated on the word.

Spark partitions the documents; a task encodes the distinct white-space
chunks of its texts once and keeps them in a cache of bounded size (a full
cache is emptied, nothing is dropped from the result). No shuffle.

Defined results: a null or empty text has no ids and decodes to the empty
string; texts are encoded whole whatever their length; repeated rows are
encoded alike; other columns are kept as they are, an old ``ids`` or
``decoded`` column is replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from narrata.llm.common import map_arrow

#: entries of the chunk cache and of the word cache of a task
CACHE_WORDS = 600_000
_CONTROL = "\x1c\x1d\x1e\x1f"  # str.split() cuts there, the tokenizer does not
_SPACE = re.compile(r"(?:(?![\x1c-\x1f])\s)+")
_END = "\x00"  # never produced by the byte alphabet


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others take the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class PrefixBPE:
    """Exact encoder and decoder of one byte-level BPE file with word ends.

    ``path`` names a tokenizer JSON whose normalizer is NFC, white-space
    folding and lower case, and whose pre-tokenizer keeps the matches of one
    pattern. Truncation and padding of the file are not used."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                       if p["type"] == "Split")
        # ASCII chunks are cut by the file's own pattern with its classes spelt
        # out; for others the library's normalizer and pre-tokenizer cut, so
        # that its Unicode tables hold
        self.pieces = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.plain = re.compile("[a-z]+").fullmatch
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.table = byte_alphabet()
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.names: list[str] = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = s
        never = len(model["merges"])
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            joined = vocab[a + b]
            self.pair_rank[vocab[a], vocab[b]] = r
            if self.parts[joined] is None:
                self.parts[joined] = (vocab[a], vocab[b])
                self.rank[joined] = r
        self.never = never
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if s in self.special:
                continue
            body = s.removesuffix(self.suffix) + _END if self.suffix and s.endswith(self.suffix) else s
            self.automaton.add_word(body, (i, len(body)))
        self.automaton.make_automaton()
        self.size = size
        self.seams: dict[int, bool] = {}  # by a * size + b
        self.right: dict[int, list[int]] = {}
        self.left: dict[int, list[int]] = {}
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _spine(self, token: int, side: int, memo: dict[int, list[int]]) -> list[int]:
        """The pieces of ``token`` that touch its edge, smallest first."""
        got = memo.get(token)
        if got is None:
            got = [token]
            while (p := self.parts[got[-1]]) is not None:
                got.append(p[side])
            got.reverse()
            memo[token] = got
        return got

    def tolerates(self, a: int, b: int) -> bool:
        """Whether byte-pair encoding keeps the seam between ``a`` and ``b``:
        replay, in merge order, how the pieces at the seam grow; the seam is
        lost if the pieces facing each other merge before either grows. Of two
        equal merges the left one comes first."""
        key = a * self.size + b
        known = self.seams.get(key)
        if known is not None:
            return known
        grow_a, grow_b = self._spine(a, 1, self.right), self._spine(b, 0, self.left)
        i = j = 0
        while True:
            next_a = self.rank[grow_a[i + 1]] if i + 1 < len(grow_a) else self.never
            next_b = self.rank[grow_b[j + 1]] if j + 1 < len(grow_b) else self.never
            across = self.pair_rank.get((grow_a[i], grow_b[j]), self.never)
            if across < next_a and across <= next_b and across < self.never:
                result = False
                break
            if next_a == next_b == self.never:
                result = True
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self.seams) > 2 * CACHE_WORDS:
            self.seams.clear()
        self.seams[key] = result
        return result

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-token: the unique last token of every prefix, then
        the back-pointers from the end."""
        s = piece + _END if self.suffix else piece
        last = [-1] * (len(s) + 1)
        step = [0] * (len(s) + 1)
        known, tolerates, width = self.seams.get, self.tolerates, self.size
        for at, (token, size) in self.automaton.iter(s):
            end = at + 1
            if last[end] >= 0:
                continue
            before = end - size
            if before:
                prev = last[before]
                if prev < 0:
                    continue
                ok = known(prev * width + token)
                if ok is None:
                    ok = tolerates(prev, token)
                if not ok:
                    continue
            last[end], step[end] = token, size
        ids, at = [], len(s)
        while at:
            ids.append(last[at])
            at -= step[at]
        ids.reverse()
        return ids

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without white space, in the byte alphabet."""
        if not chunk.isascii():
            return [p for p, _ in self.cut(self.normalize(chunk))]
        low = chunk.lower()
        if self.plain(low):
            return [low]
        return [p.translate(self.table) for p in self.pieces.findall(low)]

    def _chunk(self, chunk: str) -> bytes:
        out = b""
        words = self.words
        for p in self._pieces(chunk):
            ids = words.get(p)
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    words.clear()
                ids = words[p] = array("i", self.word(p)).tobytes()
            out += ids
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers. Special
        strings are found in the raw text, the rest is cut at white space
        (no pre-token and no composed character spans it)."""
        if "<" in text and self.special_at.search(text):
            return b"".join(np.array([self.special[s]], dtype="<i4").tobytes() if s in self.special
                            else self._plain(s) for s in self.special_at.split(text) if s)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        odd = any(c in text for c in _CONTROL)
        chunks = _SPACE.split(text) if odd else text.split()
        out = list(map(self.cache.get, chunks))
        if None in out:
            get, miss = self.cache.get, self._chunk
            for k, b in enumerate(out):
                if b is None:  # a chunk may recur in the text
                    b = get(chunks[k])
                    out[k] = miss(chunks[k]) if b is None else b
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: token strings joined by one space."""
        names = self.names
        return " ".join([names[i] for i in ids])


_LOADED: dict[str, PrefixBPE] = {}


def load(path: str) -> PrefixBPE:
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` (string), the exact
    ids of ``text`` and what they decode to. ``keep``: columns to carry
    (default: all). ``path`` must exist on every executor."""
    keep = [c for c in (keep or docs.columns) if c not in ("ids", "decoded")]
    kept = docs.select(*{*keep, "text"})
    kept = kept.select(*[c for c in docs.columns if c in kept.columns])
    fields = [f for f in kept.schema.fields if f.name in keep]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                     "ids array<int>", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = load(path)
        for b in batches:
            raw = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            flat = np.frombuffer(b"".join(raw), dtype="<i4")
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            names = bpe.names
            strings = [names[i] for i in flat.tolist()]
            decoded = [" ".join(strings[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield {**{f.name: b.column(f.name) for f in fields}, "ids": ids, "decoded": decoded}

    return map_arrow(kept, ddl, run)
