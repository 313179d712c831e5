"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: keys are thrown into
buckets, and each bucket stores the displacement that sends its keys to free
slots, so a table of exactly as many slots as keys answers with one probe and
one comparison.  A pre-token that is itself in the vocabulary is thereby
resolved whole.  Tier two merges the others: the bytes form a doubly linked
list, and a heap gives the pair of lowest rank, leftmost first; pairs that
have changed since they were pushed are skipped.

Units (a stretch of letters, digits or signs and the blank before it, or a run of
white space: ``common.units``) never share a pre-token.  A few megabytes of texts at a time are cut into
units and dictionary-encoded in Arrow; each different unit is encoded once per
Python worker and remembered (a memo with a fixed number of entries), and the
texts' ids are put together from there.  Texts with white space outside ASCII
are encoded without units.

Defined cases: a null text is the empty text (no ids); ids can be null or
repeated, rows are treated one by one; texts are encoded whole whatever their
length; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from meterwise.llm.common import FURTHER_SPACES, flat, gathered, portions, text_of, units

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
MEMO_ENTRIES = 1 << 18
BATCH_BYTES = 1 << 22
KEYS_A_BUCKET = 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash from byte strings to ranks (hash and displace)."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = self.n = len(keys)
        self.n_buckets = max(1, n // KEYS_A_BUCKET)
        self.shift = np.zeros(self.n_buckets, np.int64).tolist()
        self.slots: list[tuple[bytes, int] | None] = [None] * n
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            buckets.setdefault((h >> 96) % self.n_buckets, []).append(i)
        used = bytearray(n)
        free = iter(range(n))
        for b in sorted(buckets, key=lambda b: -len(buckets[b])):
            d = 0
            if len(buckets[b]) == 1:  # an offset alone reaches any slot that is left
                d = n * ((next(s for s in free if not used[s]) - self._slot(hashes[buckets[b][0]], 0)) % n)
            while True:
                at = [self._slot(hashes[i], d) for i in buckets[b]]
                if len(set(at)) == len(at) and not any(used[s] for s in at):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(buckets[b], at):
                used[s] = 1
                self.slots[s] = (keys[i], ranks[keys[i]])

    def _slot(self, h: int, d: int) -> int:
        """The second hash moves with the displacement's low part, its high part adds an offset."""
        return ((h & 0xFFFFFFFF) + (d % self.n) * (((h >> 32) & 0xFFFFFFFF) | 1) + d // self.n) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_128_intdigest(key)
        found = self.slots[self._slot(h, self.shift[(h >> 96) % self.n_buckets])]
        return found[1] if found[0] == key else None


_AFTER, _BEFORE = list(range(1, 65)), list(range(-1, 63))


class Merges:
    """Merges the bytes of a piece: the neighbouring pair of lowest rank first, the leftmost of equal ones."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of_byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        # Where the bytes' own ranks are the first 256, a piece is turned into them at once.
        self.turned = bytes(self.of_byte) if all(0 <= r < 256 for r in self.of_byte) else None
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def merge(self, piece: bytes) -> list[int]:
        """The symbols form a doubly linked list; a heap gives the next pair, pairs that have changed since are skipped."""
        n, rank = len(piece), self.pairs.get
        ids = list(piece.translate(self.turned)) if self.turned else [self.of_byte[b] for b in piece]
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a << 32 | b)) is not None]
        after, before = (_AFTER[:n], _BEFORE[:n]) if n <= len(_AFTER) else (list(range(1, n + 1)), list(range(-1, n - 1)))
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank(r << 32 | ids[k])) is not None:
                    heappush(heap, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := rank(ids[h] << 32 | r)) is not None:
                heappush(heap, q << 32 | h)
        return [i for i in ids if i >= 0]


class ByteBPE:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash | None = None, pattern: str = public_tokenizers.PATTERN):
        self.table = table or PerfectHash(ranks)
        self.merges = Merges(ranks)
        self.pattern = regex.compile(pattern)
        self.vocab = {i: b for b, i in ranks.items()}
        self.listed = {i: b",%d" % i for i in self.vocab}
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of any text; every match of the pattern by itself."""
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            raw = piece.encode("utf-8")
            whole = self.table.get(raw)
            if whole is not None:
                ids.append(whole)
            else:
                ids += self.merges.merge(raw)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def units_of(self, texts: pa.Array) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """(ids of the different units, the unit at each place of the texts, each text's number of units).  Each different unit is
        encoded once; a text with white space outside ASCII is a unit by itself."""
        odd = np.asarray(pc.match_substring_regex(texts, FURTHER_SPACES).cast(pa.uint8())).astype(bool)
        cut, n = units(pc.if_else(pa.array(odd), "", texts))
        words = cut.dictionary_encode()
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        memo, known = self.memo, []
        for u in words.dictionary.to_pylist():
            got = memo.get(u)
            if got is None:
                got = memo[u] = tuple(self.encode(u))
            known.append(got)
        at = np.asarray(words.indices, np.int64)
        if odd.any():
            where = np.flatnonzero(odd)
            at = np.insert(at, (np.cumsum(n) - n)[where], len(known) + np.arange(len(where)))
            n[where] = 1
            known += [tuple(self.encode(t)) for t in texts.take(pa.array(where)).to_pylist()]
        return known, at, n


_CODERS: dict[str, ByteBPE] = {}


def coder(path: str | None = None, table: PerfectHash | None = None) -> ByteBPE:
    path = path or public_tokenizers.path(BYTE_BPE)
    if path not in _CODERS:
        _CODERS[path] = ByteBPE(read_ranks(path), table)
    return _CODERS[path]


@cache
def perfect_hash(path: str) -> PerfectHash:
    """Built once a process: the driver sends it to the workers."""
    return PerfectHash(read_ranks(path))


def _joined(parts: list[bytes], at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts' parts put together, as binary."""
    each = pa.array(parts, pa.large_binary()).take(pa.array(at))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), each), pa.scalar(b"", pa.large_binary()))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                     returns: str = "digest") -> DataFrame:
    """Encode, then decode the ids.  ``returns='ids'`` gives (id, ids, decoded binary);
    ``'digest'`` gives (id, n_tokens, ids_sha256, decoded_sha256)."""

    path = path or public_tokenizers.path(BYTE_BPE)
    table = docs.sparkSession.sparkContext.broadcast(perfect_hash(path))  # as many slots as the vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, table.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            for lo, hi in portions(np.asarray(pc.binary_length(b.column(1)), np.int64), BATCH_BYTES):
                known, at, n = bpe.units_of(b.column(1).slice(lo, hi - lo))
                ends = np.concatenate([[0], np.cumsum(n)])
                size = np.fromiter(map(len, known), np.int64, len(known))
                upto = np.concatenate([[0], np.cumsum(size[at])])[ends]
                back = _joined([bpe.decode(k) for k in known], at, ends)
                if returns == "ids":
                    begin = np.cumsum(size) - size
                    store = np.fromiter(flat(known), np.int32, int(size.sum()))
                    first = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(store[gathered(begin[at], (begin + size)[at])]))
                    second = back.cast(pa.binary())
                else:
                    first = pa.array([sha(memoryview(x.as_buffer())[1:]) for x in _joined([b"".join(map(bpe.listed.__getitem__, k)) for k in known], at, ends)])
                    second = pa.array([sha(x.as_buffer()) for x in back])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(upto)), first, second], names=["id", "n_tokens", "first", "second"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    kind = docs.schema[id_col].dataType.simpleString()
    a, b = ("array<int>", "binary") if returns == "ids" else ("string", "string")
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = src.mapInArrow(run, f"id {kind}, n_tokens long, first {a}, second {b}")
    names = ("ids", "decoded") if returns == "ids" else ("ids_sha256", "decoded_sha256")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("first").alias(names[0]), F.col("second").alias(names[1]))
