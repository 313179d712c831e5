"""Periodic run detection with longest common extensions from a difference cover.

The words of a text are the runs of bytes outside ASCII white space.  A *run* is
a stretch of words with smallest period q (words q apart are the same) and a
length of at least ``max(min_length, exponent * q)`` that no neighbouring word
extends with period q.

Texts are taken in batches of about ``BATCH_WORDS`` words (a longer text alone),
numbered words one text after the other with a separator of its own between two
texts, so that no extension leaves its text:

* only the suffixes at places whose remainder modulo ``MODULUS`` is in ``COVER``
  are sorted: by their text and first ``MODULUS`` words, then by doubling of the
  groups that are still tied;
* the common prefixes of neighbours in that order go into a sparse table of
  range minima;
* the extension of two places compares the fewer than ``MODULUS`` words up to
  the next offset at which both are in the cover, and asks the table from there;
  the same over the reversed words gives the extension to the left;
* for every period q the places 0, s, 2s, ... with s = (exponent - 1) * q are
  paired with the places q further (a harmonic grid: n/s * ln n pairs in all).
  A run of period q has at least s pairs, so one of them is on the grid, and its
  extensions to both sides give the run.  A stretch that is found for several
  periods keeps the smallest: the others are its multiples.

No shuffle: one pass over the texts.

Defined cases: null and empty texts have no words and no runs (collapsed text:
empty); repeated rows each give a row; null ids stay; an empty table gives no
rows; a very long text is held whole by one task (about 100 bytes a word);
only the named columns are read, further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from meterwise.llm.common import portions, split_words

#: Every remainder modulo 13 is a difference of two of these.
MODULUS = 13
COVER = (0, 1, 3, 9)

BATCH_WORDS = 1 << 17
PAIRS = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
#: By the remainders of two places: the first offset at which both are in the cover.
_SHIFT = np.array([[next(d for d in range(MODULUS) if (i + d) % MODULUS in COVER and (j + d) % MODULUS in COVER)
                    for j in range(MODULUS)] for i in range(MODULUS)], np.int64)


class Extensions:
    """Longest common extensions to the right within ``words``; ``text``: the number of each place's text."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        n = len(words)
        # Behind the end stand words that occur nowhere else.
        self.words = np.concatenate([words, np.arange(MODULUS + 1, dtype=np.int64) + words.max(initial=0) + 1])
        self.places = np.flatnonzero(_IN_COVER[np.arange(n) % MODULUS])
        self.sample = np.full(n + MODULUS, -1, np.int64)
        self.sample[self.places] = np.arange(len(self.places))
        levels = self._sort(text)
        self.rank = levels[-1]
        self.minima = self._table(levels, text)

    def _sort(self, text: np.ndarray) -> list[np.ndarray]:
        """Ranks by the first MODULUS, 2 * MODULUS, 4 * MODULUS, ... words; equal strings have the rank of the first of them."""
        p, m = self.places, len(self.places)
        bits = max(1, int(self.words.max(initial=0)).bit_length())
        each, keys = max(1, 62 // bits), [text[p]]
        for lo in range(0, MODULUS, each):
            key = np.zeros(m, np.int64)
            for t in range(lo, min(lo + each, MODULUS)):
                key = (key << bits) | self.words[p + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])[:m]
        rank = np.empty(m, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        levels, step = [rank], MODULUS
        tied = self._tied(rank)
        while len(tied):
            ahead = self.sample[np.minimum(p[tied] + step, len(self.sample) - 1)]
            second = np.where(ahead >= 0, rank[ahead], -1) + 1
            key = rank[tied] * (m + 1) + second
            step_order = np.argsort(key, kind="stable")
            key, at = key[step_order], tied[step_order]
            index = np.arange(len(at))
            old = rank[at]
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), index, 0))
            part = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), index, 0))
            rank = rank.copy()
            rank[at] = old + part - group
            levels.append(rank)
            step *= 2
            tied = tied[np.isin(tied, self._tied(rank), assume_unique=True)]
        return levels

    @staticmethod
    def _tied(rank: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)

    def _table(self, levels: list[np.ndarray], text: np.ndarray) -> list[np.ndarray]:
        """Range minima over the common prefixes of neighbours; entry r belongs to the ranks r - 1 and r."""
        m = len(self.places)
        at = np.empty(m, np.int64)
        at[self.rank] = self.places
        prefix = np.zeros(max(m, 1), np.int64)
        near = np.flatnonzero(text[at[1:]] == text[at[:-1]])
        a, b, common = at[near], at[near + 1], np.zeros(len(near), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = self.sample[np.minimum(a + common, len(self.sample) - 1)], self.sample[np.minimum(b + common, len(self.sample) - 1)]
            equal = (x >= 0) & (y >= 0)
            equal[equal] = levels[k][x[equal]] == levels[k][y[equal]]
            common[equal] += MODULUS << k
        live = np.arange(len(near))
        for _ in range(MODULUS):
            live = live[self.words[a[live] + common[live]] == self.words[b[live] + common[live]]]
            common[live] += 1
        prefix[near + 1] = common
        minima, width = [prefix], 1
        while 2 * width <= len(prefix):
            minima.append(np.minimum(minima[-1][:-width], minima[-1][width:]))
            width *= 2
        return minima

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from the places i and j (different places of one text) on."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        common, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(MODULUS):
            go = live[shift[live] > t]
            stay = live[shift[live] <= t]
            same = go[self.words[i[go] + t] == self.words[j[go] + t]]
            common[same] += 1
            live = np.concatenate([stay, same])
        if len(live):
            x, y = self.rank[self.sample[i[live] + shift[live]]], self.rank[self.sample[j[live] + shift[live]]]
            lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
            k = np.floor(np.log2(hi - lo)).astype(np.int64)
            for level in np.unique(k):
                at = k == level
                row = self.minima[level]
                common[live[at]] += np.minimum(row[lo[at]], row[hi[at] - (1 << int(level))])
        return common


def _grid(first: np.ndarray, size: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the pairs of the harmonic grids, in portions of about PAIRS (no less than a period)."""
    most = size // exponent
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (exponent - 1) * period
    count = (size[text] - period + step - 1) // step
    upto = np.cumsum(count)
    cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, PAIRS), "left"))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(text))):
        c = count[lo:hi]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        q = np.repeat(period[lo:hi], c)
        t = np.repeat(text[lo:hi], c)
        yield t, first[t] + nth * (exponent - 1) * q, q


def find_runs(codes: np.ndarray, size: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of the runs of texts whose word numbers follow each other in ``codes``."""
    if not len(codes) or not (size >= max(min_length, exponent)).any():
        return np.empty((0, 4), np.int64)
    k, d = int(codes.max()) + 1, len(size)
    # A separator in front of every text and one at the end, each a word of its own.
    owner = np.repeat(np.arange(d), size)
    place = np.arange(len(codes)) + owner + 1
    words = np.empty(len(codes) + d + 1, np.int64)
    words[place] = codes
    first = np.cumsum(size) - size + np.arange(d) + 1
    words[np.append(first - 1, len(words) - 1)] = k + np.arange(d + 1)
    text = np.empty(len(words), np.int64)
    text[place] = owner
    text[np.append(first - 1, len(words) - 1)] = d + np.arange(d + 1)
    right = left = None
    found = []
    for t, i, q in _grid(first, size, exponent):
        at = np.flatnonzero(words[i] == words[i + q])  # a run's pair on the grid is one of equal words
        if not len(at):
            continue
        t, i, q = t[at], i[at], q[at]
        if right is None:
            right, left = Extensions(words, text), Extensions(words[::-1].copy(), text[::-1].copy())
        ahead = right.of(i, i + q)
        behind = left.of(len(words) - i, len(words) - i - q)  # the words before i and before i + q
        length = q + ahead + behind
        ok = length >= np.maximum(min_length, exponent * q)
        found.append(np.stack([t[ok], (i - behind - first[t])[ok], length[ok], q[ok]], 1))
    if not found:
        return np.empty((0, 4), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.concatenate([[True], np.any(runs[1:, :3] != runs[:-1, :3], axis=1)])[:len(runs)]
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, exponent: int = 4) -> DataFrame:
    """(id_col, n_words, runs array of (start, length, period) by start and period, collapsed): ``collapsed`` joins with
    one space the words that no run contains after its first ``period`` words.  ``exponent`` is 2 or more."""
    if exponent < 2:
        raise ValueError("a run repeats at least once: exponent must be 2 or more")
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Words are cut a few texts at a time: a batch of very long texts is not spread out at once.
            lengths = np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0), np.int64) // 6
            for lo, hi in portions(lengths, BATCH_WORDS):
                texts = b.column(1).slice(lo, hi - lo)
                words, size = split_words(texts)
                codes = np.asarray(words.dictionary_encode().indices, np.int64)
                runs = find_runs(codes, size, min_length, exponent)
                edge = np.zeros(len(codes) + 1, np.int64)
                begin = np.cumsum(size) - size
                np.add.at(edge, begin[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
                np.add.at(edge, begin[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
                keep = np.cumsum(edge[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(keep)])[np.append(begin, len(codes))]
                kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep)))
                many = np.concatenate([[0], np.cumsum(np.bincount(runs[:, 0], minlength=hi - lo))])
                items = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(many, pa.int32()), items), pc.binary_join(kept, " ")],
                    names=["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = small.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col); where crc32 of the id (as decimal text) is divisible by 10, the words of the text from one place
    on repeat some of them, at least three times.  A text with a null id stays as it is."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    # The words are a column of their own: an expression that is used several times is not cut again for each use.
    cut = docs.select(id_col, text_col, F.when(h % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("__words"))
    words, n = F.col("__words"), F.size("__words")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(period, 11)))  # (n - a) / p is at most 10
    edited = F.when(words.isNotNull(), F.array_join(F.slice(again, F.lit(1), n), " ")).otherwise(F.col(text_col))
    return cut.select(id_col, edited.alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a text: number of runs, the run of greatest length to period, digests of all runs and of the collapsed text."""
    best = F.reduce("runs", F.col("runs")[0], lambda top, x: F.when(x["length"] * top["period"] > top["length"] * x["period"], x).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(id_col, "n_runs", "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
