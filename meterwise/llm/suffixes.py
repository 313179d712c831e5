"""Suffix-array deduplication by column-wise multi-document construction.

Every byte covered by a ``length``-byte string that starts at another place
too (in any document, or in the same) is removed.

The full sorted order of all suffixes of all documents would be scanned again
for every column of the longest document.  Strings of ``length`` bytes only
have to be ordered among those that can be equal, so the collection is first
cut into *segments* by anchors: in each window of ``length`` bytes the
``ANCHOR``-byte string of smallest hash (the leftmost on ties) is its anchor,
and neighbouring windows with the same anchor place form one segment, aligned
at the anchor.  Equal windows have equal anchors at equal offsets, so they lie
in the same column of the same anchor's segments, and every window lies in
exactly one segment.  Anchors are counted first; those that occur once are
done.  Equal segments are taken once, with the number of their places.

Copies of a text are told by two hashes of it and counted, not carried one by one.

Construction, per task over batches of whole anchors: segments are written
column by column to a sequential file.  The columns are then taken from the last
to the first; each round inserts one symbol of every segment.  What it needs of
the round before it reads from sequential files: the order of the suffixes that
start in the next column, their column of the collection's Burrows-Wheeler
transform (the symbols before them, in that order) and the common prefixes of
neighbours.  The new order is the stable sort of the old one by anchor and
transform; the common prefix of two neighbours is one more than the smallest
common prefix between them one round before if their symbols agree, else 0.
Order, prefixes and the next column of the transform are written to the files of
the next round.  Neighbours with a common prefix of at least ``length`` are equal
windows; a run of them that stands for two places or more marks its windows.
A round holds one entry a segment of the batch (at most ``BATCH_ROWS`` and one more
anchor's segments, at most ``group_rows``).

An anchor with more than ``group_rows`` different segments (the rim of a
passage that very many documents share) is split first: windows whose
``CELL``-aligned inner part occurs once are done, the others are keyed by their
own hash and counted, so that no group has to fit one task.

Defined cases: null and empty texts, and texts shorter than ``length``, lose
nothing; repeated rows are places of their own; null ids are allowed; an empty
table gives no rows; a text that repeats itself (one character a million times)
gives one row for each different segment; only the named columns are read
(``returns='rows'``: all are returned, whatever their names).
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meterwise.llm.common import batches_of, spare_name, staged

LENGTH = 400
ANCHOR = 64
CELL = 16
GROUP_ROWS = 1 << 16
BLOCK = 1 << 19
BATCH_ROWS = 1 << 12

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def string_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width``-byte string (width a power of two)."""
    h, n = b.astype(np.uint64) + np.uint64(1), 1
    while n < width:
        h = _mix(h[:-n] * _BASE + h[n:])
        n *= 2
    return h


class Hasher:
    """Hashes of any substrings of one text from prefix sums modulo 2^64."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, b: np.ndarray):
        n = len(b) + 1
        if len(Hasher.powers) < n:
            size = max(n, 1 << 16)
            Hasher.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
            back = np.uint64(pow(int(_BASE), -1, 1 << 64))
            Hasher.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, back)]), dtype=np.uint64)
        symbols = _mix(b.astype(np.uint64) + np.uint64(77))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(symbols * Hasher.powers[:len(b)], dtype=np.uint64)])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * Hasher.inverse[lo] + (hi - lo).astype(np.uint64))


def anchors(b: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: (anchor place, first window, last window), in order."""
    n = len(b) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    span = length - width + 1  # places of anchors within a window
    place = np.empty(n, np.int64)
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        h = string_hashes(b[lo:hi + length - 1], width)
        # The place rides in the low bits, so that the smallest key is the leftmost of the smallest hashes.
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        m, w = key, 1
        while 2 * w <= span:
            m, w = np.minimum(m[:-w], m[w:]), 2 * w
        if w < span:
            m = np.minimum(m[:len(m) - (span - w)], m[span - w:])
        place[lo:hi] = (m & np.uint64((1 << 20) - 1)).astype(np.int64) + lo
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[new], new, np.append(new[1:], n) - 1


def text_keys(text: str) -> list[Column]:
    """Two hashes with different seeds: equal texts have equal ones, two different texts practically never."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), F.col(text)).alias("k2")]


def segments(docs: DataFrame, length: int, width: int) -> DataFrame:
    """(id, k1, k2, anchor, sig, starts, left, size): the different segments of each text with their places.  ``left``: bytes
    before the anchor; ``sig``: hash of the bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cols, ends, starts, done = [], [[] for _ in range(4)], [np.zeros(1, np.int64)], [], 0
            for i, t in enumerate(batches_of(b, "text")):
                raw = np.frombuffer((t or "").encode("utf-8"), np.uint8)
                place, first, last = anchors(raw, length, width)
                if not len(place):
                    continue
                hasher, end = Hasher(raw), last + length
                got = [hasher.of(place, place + width).view(np.int64), hasher.of(first, end).view(np.int64), place - first, end - first]
                new = np.arange(len(first))
                if len(np.unique(got[1])) < len(first):  # a segment occurs again in its own text
                    by = np.lexsort((first, got[2], got[1], got[0]))
                    got, first = [x[by] for x in got], first[by]
                    new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in got[:3]], axis=0)]))
                row.append(np.full(len(new), i))
                for c, x in zip(cols, got):
                    c.append(x[new])
                ends.append(np.append(new[1:], len(first)) + done)
                starts.append(first)
                done += len(first)
            if not row:
                continue
            at = pa.array(np.concatenate(row))
            anchor, sig, left, size = (pa.array(np.concatenate(c), pa.int64()) for c in cols)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(starts), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(3)), anchor, sig, places, left, size],
                                             names=["id", "k1", "k2", "anchor", "sig", "starts", "left", "size"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, k1 long, k2 long, anchor long, sig long, starts array<long>, left long, size long")


class Columns:
    """Column-wise order of the segments of several anchors, each aligned at its anchor, over sequential files."""

    #: Two files each, read in one round and written in the other: they are written over in place.
    KINDS = {"order": np.int32, "prefix": np.int32, "transform": np.uint16}

    def __init__(self, folder: str):
        new = lambda name: open(os.path.join(folder, name), "w+b", buffering=0)
        self.symbols = new("symbols")
        self.files = {name: (new(f"{name}-0"), new(f"{name}-1")) for name in self.KINDS}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for f in (self.symbols, *(f for pair in self.files.values() for f in pair)):
            f.close()

    def _read(self, name: str, turn: int, n: int) -> np.ndarray:
        f, kind = self.files[name][turn % 2], np.dtype(self.KINDS[name])
        f.seek(0)
        return np.frombuffer(_whole(f, n * kind.itemsize), kind)

    def _write(self, name: str, turn: int, values: np.ndarray) -> None:
        f = self.files[name][turn % 2]
        f.seek(0)
        f.write(values.astype(self.KINDS[name], copy=False).tobytes())

    def windows(self, anchor: np.ndarray, segs: list[bytes], left: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """A row for each segment: True at the offsets of its windows that stand at two places or more.
        Segments of one anchor are neighbours; only they are compared."""
        n, size = len(segs), np.array([len(s) for s in segs])
        lead, width = int(left.max()), int((size - left).max())
        begin, end = lead - left, lead - left + size
        self._write_symbols(segs, begin, lead + width)
        marks = np.zeros((n, int(size.max()) - length + 1), bool)
        owner = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]])).astype(np.int32) << 9
        last = lead + width - 1

        def column(col: int) -> np.ndarray:
            """The symbols of a column, 0 outside the segments."""
            if col < 0:
                return np.zeros(n, np.uint16)
            self.symbols.seek(col * n)
            got = np.frombuffer(_whole(self.symbols, n), np.uint8).astype(np.uint16) + 1
            return np.where((col >= begin) & (col < end), got, 0)

        self._write("order", last, np.arange(n))
        self._write("prefix", last, np.zeros(n))  # with the one before in the order; an anchor's first has 0
        self._write("transform", last, column(last))
        for col in range(last, -1, -1):
            order, old = self._read("order", col, n), self._read("prefix", col, n)
            key = owner[order] + self._read("transform", col, n)
            step = np.argsort(key, kind="stable")
            key, order = key[step], order[step]
            # Under equal symbols the old order stays, so the old prefixes between two neighbours count.
            prefix = np.zeros(n, np.int32)
            same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 511 > 0)) + 1
            if len(same):
                edges = np.stack([step[same - 1] + 1, step[same] + 1], 1).ravel()
                prefix[same] = 1 + np.minimum.reduceat(np.append(old, 0), edges)[::2]
            self._write("order", col - 1, order)
            self._write("prefix", col - 1, prefix)
            self._write("transform", col - 1, column(col - 1)[order])
            stands = (key & 511 > 0) & (col + length <= end[order])
            if stands.any():
                run = np.cumsum(prefix < length) - 1  # a run of equal windows
                twice = order[(np.bincount(run, places[order] * stands, n)[run] >= 2) & stands]
                marks[twice, col - begin[twice]] = True
        return marks

    def _write_symbols(self, segs: list[bytes], begin: np.ndarray, width: int) -> None:
        table = np.zeros((len(segs), width), np.uint8)
        for row, at, s in zip(table, begin.tolist(), segs):
            row[at:at + len(s)] = np.frombuffer(s, np.uint8)
        self.symbols.seek(0)
        self.symbols.write(np.ascontiguousarray(table.T).tobytes())


def _whole(f, size: int) -> bytes:
    """The next ``size`` bytes of an unbuffered file."""
    parts = []
    while size:
        got = f.read(size)
        if not got:
            raise EOFError(f.name)
        parts.append(got)
        size -= len(got)
    return parts[0] if len(parts) == 1 else b"".join(parts)


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _ordered(length: int, batch_rows: int):
    """Rows (anchor, sig, left, places, bytes), sorted by anchor, to the repeated windows (anchor, sig, lo, hi), hi excluded.
    Whole anchors are gathered up to ``batch_rows`` segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder, Columns(folder) as columns:
            held = []

            def close():
                anchor, sig, left, places, raw = zip(*held)
                anchor, sig = np.array(anchor, np.int64), np.array(sig, np.int64)
                marks = columns.windows(anchor, list(raw), np.array(left), np.array(places, float), length)
                edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                at, lo = np.nonzero(edge == 1)
                _, hi = np.nonzero(edge == -1)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchor[at], sig[at], lo, hi)], names=["anchor", "sig", "lo", "hi"])

            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if len(held) >= batch_rows and held[-1][0] != r[0]:
                        yield close()
                    held.append(r)
            if held:
                yield close()

    return run


def repeated_windows(docs: DataFrame, places: DataFrame, length: int, width: int, group_rows: int) -> DataFrame:
    """(anchor, sig, runs): the window offsets (lo, hi) of each distinct segment that occur at two places or more."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = F.min(F.struct("id", "k1", "k2", F.col("starts")[0].alias("start"), "left", "size")).alias("at")
    distinct = staged(places.groupBy("anchor", "sig").agg(F.sum(F.col("copies") * F.size("starts")).alias("places"), one), "distinct-segments")
    per = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("places").alias("all"))
    distinct = staged(distinct.join(per.filter("all >= 2"), "anchor"), "repeated-anchors")
    # All places of an anchor's only segment are equal: its order is that of one string.
    alone = distinct.filter("kinds = 1").select("anchor", "sig", F.lit(0).cast("long").alias("lo"), (F.col("at.size") - length + 1).alias("hi"))
    wanted = distinct.filter("kinds > 1").select("anchor", "sig", "kinds", "places", "at.*")
    asked = wanted.groupBy("id", "k1", "k2").agg(F.collect_list(F.struct("anchor", "sig", "kinds", "places", "start", "left", "size")).alias("asked"))
    same = docs["id"].eqNullSafe(asked["id"]) & (docs["k1"] == asked["k1"]) & (docs["k2"] == asked["k2"])
    texts = docs.join(asked, same).select(F.encode("text", "utf-8").alias("raw"), "asked")
    cut = texts.select("raw", F.explode("asked").alias("a")).select("a.*", F.expr("substring(raw, cast(a.start as int) + 1, cast(a.size as int))").alias("raw"))
    cut = staged(cut.dropDuplicates(["anchor", "sig"]), "segments")
    dealt = (cut.filter(F.col("kinds") <= group_rows).select("anchor", "sig", "left", "places", "raw")
             .repartition(n, "anchor").sortWithinPartitions("anchor"))
    found = dealt.mapInArrow(_ordered(length, BATCH_ROWS), "anchor long, sig long, lo long, hi long")
    every = alone.unionAll(found).unionAll(_split(cut.filter(F.col("kinds") > group_rows), length))
    # A segment has at most ``length`` windows, so its runs are few.
    return every.groupBy("anchor", "sig").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def _split(cut: DataFrame, length: int) -> DataFrame:
    """Windows of very large anchor groups: kept while the part on whole cells recurs, then counted by themselves."""

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(7)]
            for anchor, sig, left, places, raw in zip(*(c.to_pylist() for c in b.columns)):
                a = np.frombuffer(raw, np.uint8)
                hasher, k = Hasher(a), len(a) - length + 1
                w = np.arange(k)
                lo = w + (left - w) % CELL  # the first cell edge at or after the window's start; edges are aligned at the anchor
                first = np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1]]))
                lo = lo[first]
                hi = lo + (length - CELL + 1) // CELL * CELL
                hi = np.minimum(hi, len(a))
                for c, x in zip(out, (np.full(len(first), anchor), np.full(len(first), sig), np.full(len(first), places), left - lo,
                                      hasher.of(lo, hi).view(np.int64), first, np.append(first[1:], k))):
                    c.append(x)
            names = ["anchor", "sig", "places", "edge", "inner", "lo", "hi"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], names=names)

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(6)]
            for anchor, sig, left, places, raw, spans in zip(*(c.to_pylist() for c in b.columns)):
                hasher = Hasher(np.frombuffer(raw, np.uint8))
                w = np.concatenate([np.arange(s["lo"], s["hi"]) for s in spans])
                for c, x in zip(out, (np.full(len(w), anchor), np.full(len(w), sig), np.full(len(w), places), left - w,
                                      hasher.of(w, w + length).view(np.int64), w)):
                    c.append(x)
            names = ["anchor", "sig", "places", "off", "own", "lo"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], names=names)

    rows = cut.select("anchor", "sig", "left", "places", "raw")
    parts = staged(rows.mapInArrow(cells, "anchor long, sig long, places long, edge long, inner long, lo long, hi long"), "cells")
    often = parts.groupBy("anchor", "edge", "inner").agg(F.sum("places").alias("all")).filter("all >= 2").drop("all")
    live = parts.join(often, ["anchor", "edge", "inner"]).groupBy("anchor", "sig").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    each = staged(rows.join(live, ["anchor", "sig"]).mapInArrow(windows, "anchor long, sig long, places long, off long, own long, lo long"), "windows")
    twice = each.groupBy("anchor", "off", "own").agg(F.sum("places").alias("all")).filter("all >= 2").drop("all")
    # A segment has fewer windows than ``length``: they are put together again as runs.
    marked = each.join(twice, ["anchor", "off", "own"]).groupBy("anchor", "sig").agg(F.sort_array(F.collect_set("lo")).alias("at"))

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for anchor, sig, at in zip(*(c.to_pylist() for c in b.columns)):
                w = np.array(at, np.int64)
                gap = np.flatnonzero(np.diff(w) > 1)
                lo, hi = w[np.concatenate([[0], gap + 1])], w[np.append(gap, len(w) - 1)] + 1
                for c, x in zip(out, (np.full(len(lo), anchor), np.full(len(lo), sig), lo, hi)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], names=["anchor", "sig", "lo", "hi"])

    return marked.mapInArrow(runs, "anchor long, sig long, lo long, hi long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, width: int = ANCHOR,
                   group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(docs as (id, k1, k2, text), spans as (k1, k2, cuts)): cuts are, by text, segment places with their repeated windows."""
    width = min(width, 1 << (max(1, length // 4).bit_length() - 1))
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", *text_keys("text"), "text")
    found = segments(small, length, width)
    places = staged(found.groupBy("k1", "k2", "anchor", "sig", "left", "size", "starts").agg(F.count("*").alias("copies"), F.min("id").alias("id")), "segment-places")
    again = staged(repeated_windows(small, places, length, width, group_rows), "repeated-windows")
    spans = places.join(again, ["anchor", "sig"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("starts", "runs")).alias("cuts"))
    return small, spans


def _merged(cuts: list[dict], size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of a document of ``size`` bytes."""
    edge = np.zeros(size + 1, np.int64)
    for c in cuts:
        starts = np.array(c["starts"], np.int64)
        for r in c["runs"]:
            np.add.at(edge, starts + r["lo"], 1)
            np.add.at(edge, starts + r["hi"] - 1 + length, -1)
    return _runs(np.cumsum(edge[:-1]) > 0)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", returns: str = "digest", length: int = LENGTH, **options) -> DataFrame:
    """``'digest'``: (id_col, n_bytes, n_removed, n_spans, kept_sha256); ``'rows'``: all rows of ``docs`` with the text
    that is left (bytes that no longer form UTF-8 at a cut are dropped with it)."""
    small, spans = repeated_spans(docs, id_col, text_col, length, **options)
    if returns == "rows":
        keys = [spare_name(docs.columns, k) for k in ("k1", "k2")]
        keyed = docs.select("*", *(k.alias(n) for k, n in zip(text_keys(f"`{text_col}`"), keys)))
        cuts = spare_name(docs.columns, "cuts")
        joined = keyed.join(spans.select(F.col("k1").alias(f"{keys[0]}_"), F.col("k2").alias(f"{keys[1]}_"), F.col("cuts").alias(cuts)),
                            (F.col(keys[0]) == F.col(f"{keys[0]}_")) & (F.col(keys[1]) == F.col(f"{keys[1]}_")), "left")
        joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], cuts)
        at = docs.columns.index(text_col)

        def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = []
                for t, cuts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                    if cuts:
                        raw = t.encode("utf-8")
                        lo, hi = _merged(cuts, len(raw), length)
                        t = b"".join(raw[i:j] for i, j in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)])).decode("utf-8", "ignore")
                    texts.append(t)
                cols = [pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

        return joined.mapInArrow(rest, docs.schema)

    joined = small.join(spans, ["k1", "k2"], "left").select("id", "text", "cuts")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for t, cuts in zip(batches_of(b, "text"), batches_of(b, "cuts")):
                raw = (t or "").encode("utf-8")
                lo, hi = _merged(cuts, len(raw), length) if cuts else (np.empty(0, int), np.empty(0, int))
                kept = hashlib.sha256()
                for i, j in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]):
                    kept.update(raw[i:j])
                for c, x in zip(out, (len(raw), int((hi - lo).sum()), len(lo), kept.hexdigest())):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(digest, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


#: The digests by counting the MD5 of every window of the bytes, written in hexadecimal (DuckDB).
DEDUP_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS num, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT num, pos, md5_number(substr(h, 2 * pos + 1, {2 * LENGTH})) AS k FROM (SELECT num, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS pos FROM d)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT num, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY num ORDER BY pos) <= {LENGTH} THEN 0 ELSE 1 END AS begins FROM w WHERE k IN (SELECT k FROM again)),
runs AS (SELECT num, pos, sum(begins) OVER (PARTITION BY num ORDER BY pos) AS run FROM hit),
cut AS (SELECT num, min(pos) AS lo, max(pos) + {LENGTH} AS hi FROM runs GROUP BY num, run),
rest AS (SELECT num, lo, hi, coalesce(lag(hi) OVER (PARTITION BY num ORDER BY lo), 0) AS since FROM cut),
part AS (SELECT num, lo, substr(h, 2 * since + 1, 2 * (lo - since)) AS piece FROM rest JOIN d USING (num)
         UNION ALL SELECT num, len(h) AS lo, substr(h, 2 * coalesce(hi, 0) + 1) AS piece FROM d LEFT JOIN (SELECT num, max(hi) AS hi FROM cut GROUP BY num) USING (num)),
kept AS (SELECT num, sha256(unhex(string_agg(piece, '' ORDER BY lo))) AS kept_sha256 FROM part GROUP BY num),
sums AS (SELECT num, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM cut GROUP BY num)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM d JOIN kept USING (num) LEFT JOIN sums USING (num)
"""
