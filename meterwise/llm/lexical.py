"""Ranked lexical search by per-term geometric blocking.

All documents are ranked for each item of a stated query set.  A document is a
sparse vector of integer impacts (weight of the term times its saturated
frequency), an item the set of its terms; the score is the sum of the impacts of
the item's terms.

1. The items' terms (a block of at most about ``BLOCK_TERMS`` of them at a time;
   further blocks are further passes) are the vocabulary that is looked for.
   One pass over the texts writes each document's length and the frequencies of
   those terms; document frequencies, N and L are partial aggregates over it.
2. A task reads its documents in shards of at most ``SHARD`` documents.  In a
   shard the posting list of a term is cut into blocks of similar documents:
   every document joins the representative (one of ``BLOCK`` postings) with the
   largest inner product of their random projections.  A block's summary holds,
   for every term, the largest impact among its documents.
3. An item's lists are read from the greatest impact down.  The inner product of
   an item and a summary is no less than any score in the block, so a block is
   skipped only when it is below the item's k-th score so far; the other blocks'
   documents are scored exactly.  When even the sum of the greatest impacts of
   the lists that are left is below the k-th score, no unseen document can enter
   and the item is done.  Clustering and projections decide only how much is
   skipped, never what is found.
4. The k-th score goes on from shard to shard of a task.  A first pass over one in
   ``SEED_PART`` documents gives all tasks a k-th score to start from (a true
   lower bound, whichever documents it saw).  The tasks' rows meet in one
   window per item that keeps k rows of each task before its shuffle.

No document is shuffled.  What is sent to the tasks: a block of items.

Defined cases: null and empty texts hold no term, do not count in N and are
never found; an item without terms, or with terms that no document holds, has no
rows; every row of the items is an item of its own (ids may repeat or be null);
documents with equal id and score are rows of their own; null document ids come
last among equal scores; empty tables give no rows; further columns may have any
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from meterwise.llm.common import portions, split_words, staged

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
BLOCK_TERMS = 1 << 18
SHARD = 1 << 13
SHARD_ENTRIES = 1 << 22
BLOCK = 32
SKETCH = 16
SEED_PART = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII letters in lower case and digits stay, other ASCII bytes become a space, all further bytes stay.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one text after the other, and each text's number of terms."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])  # a slice with its own buffers
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD))
    return split_words(pa.LargeStringArray.from_buffers(len(texts), offsets, folded, offset=texts.offset))


def _vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id, n, vids, tfs) of every document with a term: its number of terms and the frequencies of the vocabulary's."""
    wanted = pa.array(vocabulary, pa.large_string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size_guess = np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0), np.int64) // 6
            for lo, hi in portions(size_guess, 1 << 18):
                flat, size = terms_of(b.column(1).slice(lo, hi - lo))
                coded = flat.dictionary_encode()
                vid = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=wanted), -1), np.int64)[np.asarray(coded.indices)]
                at = np.flatnonzero(vid >= 0)
                doc = np.repeat(np.arange(hi - lo), size)[at]
                key, tf = np.unique(doc * max(len(vocabulary), 1) + vid[at], return_counts=True)
                doc, vid = np.divmod(key, max(len(vocabulary), 1))
                ends = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(vid, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["id", "n", "vids", "tfs"])
                yield out.filter(pa.array(size > 0))

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, vids array<int>, tfs array<long>")


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one range after the other, and where each begins among them."""
    size = hi - lo
    begin = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(begin - lo, size), begin


class Shard:
    """Impacts of some documents by document and by term, with blocked posting lists."""

    def __init__(self, ids: pa.Array, ptr: np.ndarray, vid: np.ndarray, impact: np.ndarray, width: int):
        self.ids, self.ptr, self.vid, self.impact, self.width = ids, ptr, vid, impact, width
        order = np.argsort(vid, kind="stable")
        self.post_doc = np.repeat(np.arange(len(ids)), np.diff(ptr))[order]
        self.post_ptr = np.concatenate([[0], np.cumsum(np.bincount(vid, minlength=width))])
        self.top = np.zeros(width, np.int64)
        np.maximum.at(self.top, vid, impact)
        self.order_of_id = np.empty(len(ids), np.int64)
        self.order_of_id[np.asarray(pc.array_sort_indices(ids))] = np.arange(len(ids))  # nulls last
        self.sketch = None
        self.blocks = {}

    def _sketches(self) -> np.ndarray:
        if self.sketch is None:
            signs = np.random.default_rng(12).choice(np.array([-1, 1], np.float32), (self.width, SKETCH))
            rows = np.zeros((len(self.ids), SKETCH), np.float32)
            full = np.flatnonzero(np.diff(self.ptr))
            if len(full):
                rows[full] = np.add.reduceat(signs[self.vid] * self.impact[:, None].astype(np.float32), self.ptr[full], axis=0)
            self.sketch = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        return self.sketch

    def blocks_of(self, term: int) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """(documents by block, block bounds, summaries as (bounds, terms, largest impacts)); short lists have no summary."""
        if term not in self.blocks:
            docs = self.post_doc[self.post_ptr[term]:self.post_ptr[term + 1]]
            if len(docs) <= BLOCK // 4:
                self.blocks[term] = docs, np.array([0, len(docs)]), None
            else:
                block = np.zeros(len(docs), np.int64)
                if len(docs) > BLOCK:
                    s = self._sketches()
                    block = np.argmax(s[docs] @ s[docs[::BLOCK]].T, axis=1)
                order = np.argsort(block, kind="stable")
                docs, block = docs[order], block[order]
                bounds = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(docs))
                entry, begin = _ranges(self.ptr[docs], self.ptr[docs + 1])
                of = np.repeat(np.arange(len(bounds) - 1), np.diff(np.append(begin, len(entry))[bounds]))
                key = of * self.width + self.vid[entry]
                by = np.argsort(key, kind="stable")
                key = key[by]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                most = np.maximum.reduceat(self.impact[entry[by]], first)
                of, vid = np.divmod(key[first], self.width)
                self.blocks[term] = docs, bounds, (np.searchsorted(of, np.arange(len(bounds))), vid, most)
        return self.blocks[term]

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold a term each; ``wanted``: 1 for the item's terms, else 0."""
        entry, begin = _ranges(self.ptr[docs], self.ptr[docs + 1])
        return np.add.reduceat(self.impact[entry] * wanted[self.vid[entry]], begin)

    def search(self, terms: np.ndarray, k: int, least: int, wanted: np.ndarray) -> tuple[list, int]:
        """([(score, id)] of the k best documents with scores of ``least`` or more, documents scored)."""
        terms = terms[self.top[terms] > 0]
        terms = terms[np.argsort(-self.top[terms], kind="stable")]
        rest = np.cumsum(self.top[terms][::-1])[::-1]
        seen = np.zeros(len(self.ids), bool)
        best_doc, best, scored = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for term, left in zip(terms.tolist(), rest.tolist()):
            if left < least:
                break
            docs, bounds, summary = self.blocks_of(term)
            if summary is None:
                portions_ = [np.arange(len(bounds) - 1)]
                bound = np.full(len(bounds) - 1, left)
            else:
                ends, vid, most = summary
                bound = np.add.reduceat(most * wanted[vid], ends[:-1])
                order = np.argsort(-bound, kind="stable")
                portions_ = [order[lo:hi] for lo, hi in ((0, 4), (4, 16), (16, 64), (64, len(order))) if lo < len(order)]
            for part in portions_:
                part = part[bound[part] >= least]
                if not len(part):
                    break
                at, _ = _ranges(bounds[part], bounds[part + 1])
                new = docs[at]
                new = new[~seen[new]]
                if not len(new):
                    continue
                seen[new] = True
                got = self.scores(new, wanted)
                scored += len(new)
                best_doc, best = np.concatenate([best_doc, new[got >= least]]), np.concatenate([best, got[got >= least]])
                if len(best) > k:
                    keep = np.lexsort((self.order_of_id[best_doc], -best))[:k]
                    best_doc, best = best_doc[keep], best[keep]
                if len(best) == k:
                    least = max(least, int(best.min()))
        return list(zip(best.tolist(), self.ids.take(pa.array(best_doc)).to_pylist())), scored


def _searched(vectors: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, least: np.ndarray) -> DataFrame:
    """(item, id, score): each task's k best documents of every item with a score of at least the item's ``least``."""
    width = len(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kth, best, kind = least.copy(), [[] for _ in items], None
        by_rank = lambda r: (-r[0], r[1] is None, r[1])
        wanted = np.zeros(width, np.int64)

        def close(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            lists, n = t["vids"].combine_chunks(), np.asarray(t["n"])
            ptr = np.asarray(lists.offsets, np.int64)
            ptr, vid, tf = ptr - ptr[0], np.asarray(lists.flatten(), np.int64), np.asarray(t["tfs"].combine_chunks().flatten(), np.int64)
            norm = np.repeat(100 - 50 + (50 * n * n_docs) // n_terms, np.diff(ptr))
            shard = Shard(t["id"].combine_chunks(), ptr, vid, weights[vid] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm)), width)
            for i, (_, terms) in enumerate(items):
                wanted[terms] = 1
                found, _ = shard.search(terms, k, int(kth[i]), wanted)
                wanted[terms] = 0
                if found:
                    best[i] = sorted(best[i] + found, key=by_rank)[:k]
                    if len(best[i]) == k:
                        kth[i] = max(kth[i], best[i][-1][0])

        held, rows, entries = [], 0, 0
        for b in batches:
            kind = b.schema.field("id").type
            for lo, hi in portions(np.asarray(pc.list_value_length(b.column(2)), np.int64), SHARD_ENTRIES, SHARD):
                part = b.slice(lo, hi - lo)
                if held and (rows + part.num_rows > SHARD or entries > SHARD_ENTRIES):
                    close(held)
                    held, rows, entries = [], 0, 0
                held.append(part)
                rows, entries = rows + part.num_rows, entries + pc.sum(pc.list_value_length(part.column(2))).as_py()
        if held:
            close(held)
        if kind is not None:
            flat = [(items[i][0], d, s) for i, rows_ in enumerate(best) for s, d in rows_]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], kind), pa.array([r[2] for r in flat], pa.int64())],
                                             names=["item", "id", "score"])

    return vectors.mapInArrow(run, f"item long, id {vectors.schema['id'].dataType.simpleString()}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_col, rank, id_col, score): the ``k`` best documents of every item with a score above 0."""
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    folded = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), _UPPER, _LOWER)
    asked = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("key"),
                                F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("terms")), "search-items")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks, parts = -(-total // block_terms), []
    for block in range(blocks):
        held = [(r["item"], r["terms"]) for r in asked.filter((F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) & (F.size("terms") > 0)).select("item", "terms").collect()]
        if found := _search_block(small, held, k):
            parts.append(found)
    if not parts:
        kind = docs.schema[id_col].dataType
        empty = T.StructType([T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()),
                              T.StructField(id_col, kind), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], empty)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    rows = rows.join(asked.select("item", "key"), "item")
    return rows.select(F.col("key").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _search_block(docs: DataFrame, held: list[tuple[int, list[str]]], k: int) -> DataFrame | None:
    vocabulary = sorted({t for _, terms in held for t in terms})
    if not vocabulary:
        return None
    vectors = staged(_vectors(docs, vocabulary), "search-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("vids").alias("vid")).groupBy("vid").count().collect():  # at most the vocabulary
        df[r["vid"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    items = [(item, np.array([number[t] for t in terms], np.int64)) for item, terms in held]
    seed = vectors.filter(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_PART)) == 0)
    first = _ranked(_searched(seed, items, weights, n_docs, n_terms, k, np.ones(len(items), np.int64)), k)
    kth = {r["item"]: r["score"] for r in first.filter(F.col("rank") == k).select("item", "score").collect()}  # one row an item
    least = np.array([kth.get(item, 1) for item, _ in items], np.int64)
    return _ranked(_searched(vectors, items, weights, n_docs, n_terms, k, least), k).select("item", "rank", "id", "score")


_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

#: The whole ranking by one scored row for every document and item that share a term (DuckDB).
SEARCH_SQL = f"""
WITH terms AS (SELECT row, doc_id, unnest(regexp_extract_all({_FOLDED}, '{TERM}')) AS term
               FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
     tf AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY row, doc_id, term),
     len AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
     whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
     df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
     asked AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all({_FOLDED}, '{TERM}')) AS term
               FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
     scored AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
                FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN len USING (row), whole GROUP BY item, item_id, row, doc_id),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
