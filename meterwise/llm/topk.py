"""Exact top-k inner-product search with ball trees.

Vectors become integers, floor(256 * x) per component.  Candidates are dealt by
hash into shards; every shard builds a ball tree (a node holds a centre, a
radius and two halves of its rows).  For a query q a node's scores are at most
q . centre + |q| * radius, so nodes are opened in the order of that bound and
the search of a shard ends when the best bound left is below the k-th score
known so far.

The k-th score is shared: a first round searches one shard for each query, and
its k-th score goes along to all other shards, which prune with it from the
start and return only rows that reach it.

The queries are a stated set (ids divisible by ``every``).  A partition sorts a
shard's candidates before its queries: the tree is built once and the queries
stream past it, so memory is bounded by the shard.  Shards grow with the square
root of the table, up to ``SHARD_ROWS`` rows.

Bounds are floating point with a margin; scores are exact integers.

Defined cases: vectors that are null or hold null, NaN or infinite components,
and rows without id take no part; only vectors of the query's length are its
candidates; rows with the query's id are its own; a repeated id asks once, with
its smallest vector, and each of its rows is a candidate; equal scores go to
the smaller id; an empty table gives no rows; only the named columns are read.
Scores are 64-bit integers: if the largest component could take one beyond
that, an ArithmeticError is raised before any search.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterwise.llm.common import staged

LEAF = 64
SHARD_ROWS = 1 << 17


class BallTree:
    """A ball tree over integer vectors (rows of ``vecs``) with their ids."""

    def __init__(self, vecs: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        self.vecs, self.exact = vecs.astype(float), vecs
        top = float(np.abs(self.vecs).max(initial=0.0))
        self.safe = top * top * max(1, vecs.shape[1]) < 2.0 ** 52  # then float products are exact
        self.centre, self.radius, self.kids, self.span = [], [], [], []
        if len(ids):
            self._node(0, len(ids), leaf)
        self.ids, self.vecs, self.exact = ids[self.order], self.vecs[self.order], vecs[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _node(self, lo: int, hi: int, leaf: int) -> int:
        pending, root = [(lo, hi, -1, 0)], 0
        while pending:
            lo, hi, parent, side = pending.pop()
            rows = self.order[lo:hi]
            v = self.vecs[rows]
            c = v.mean(0)
            far = ((v - c) ** 2).sum(1)
            me = len(self.radius)
            self.centre.append(c)
            self.radius.append(math.sqrt(float(far.max())))
            self.kids.append([-1, -1])
            self.span.append((lo, hi))
            if parent >= 0:
                self.kids[parent][side] = me
            if hi - lo > leaf and self.radius[me] > 0:
                a = v[far.argmax()]
                b = v[((v - a) ** 2).sum(1).argmax()]
                half = (hi - lo) // 2
                self.order[lo:hi] = rows[np.argpartition(v @ (b - a), half)]
                pending += [(lo + half, hi, me, 1), (lo, lo + half, me, 0)]
        return root

    def bound(self, node: int, q: np.ndarray, norm: float) -> float:
        b = float(self.centre[node] @ q) + norm * float(self.radius[node])
        return b + 1e-9 * (abs(b) + norm * float(self.radius[node])) + 1.0

    def search(self, q: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """The best (score, id), by score and then smaller id, that reach ``least``."""
        if not len(self.ids):
            return []
        qf = q.astype(float)
        norm = math.sqrt(float(qf @ qf))
        safe = self.safe and norm * float(np.abs(self.vecs).max(initial=0.0)) * math.sqrt(max(1, len(q))) < 2.0 ** 52
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its head is the k-th
        heap = [(-self.bound(0, qf, norm), 0)]
        while heap:
            up, node = heapq.heappop(heap)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -up < floor:
                break
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(heap, (-self.bound(left, qf, norm), left))
                heapq.heappush(heap, (-self.bound(right, qf, norm), right))
                continue
            lo, hi = self.span[node]
            s = (self.vecs[lo:hi] @ qf).astype(np.int64) if safe else self.exact[lo:hi] @ q
            ids = self.ids[lo:hi]
            at = np.flatnonzero((ids != own) & (s >= floor)) if floor is not None else np.flatnonzero(ids != own)
            if len(at) > k:
                at = at[np.lexsort((ids[at], -s[at]))[:k]]
            for i in at.tolist():
                item = (int(s[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in best]


def _search(k: int):
    """Rows (shard, dim, least, is_query, id, v) sorted by shard, candidates first, to (query_id, vec_id, score)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tree = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            shard, dim, query = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            ids, least = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_pylist()
            flat, off = b.column(5).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dim)])
            found: list[tuple[int, int, int]] = []
            cut = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (query[1:] != query[:-1]), [True]]))
            for lo, hi in zip(cut, cut[1:]):
                if at != (shard[lo], dim[lo]):
                    at, parts, tree = (shard[lo], dim[lo]), [], None
                v = flat[off[lo]:off[hi]].reshape(hi - lo, dim[lo])
                if not query[lo]:
                    parts.append((v, ids[lo:hi]))
                    continue
                if tree is None:
                    none = (np.empty((0, dim[lo]), np.int64), np.empty(0, np.int64))
                    tree = BallTree(*(np.concatenate(x) for x in zip(none, *parts)))
                for i in range(lo, hi):
                    found += [(int(ids[i]), v_id, s) for s, v_id in tree.search(v[i - lo], int(ids[i]), k, least[i])]
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each query."""
    x = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & fine)
    rows = staged(rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda x: F.floor(x * 256)).alias("v")), "vectors")
    largest = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    n, top, most = rows.agg(F.count("*"), F.max(largest), F.max(F.size("v"))).first()
    if n and (top or 0.0) ** 2 * most >= 2.0 ** 63:
        raise ArithmeticError(f"components up to {top / 256:g} in {most} dimensions: scores may exceed 64-bit integers")
    shards = max(1, math.ceil(math.sqrt(n) / 4), -(-n // SHARD_ROWS))
    rows = rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("dim", F.size("v")).withColumn("home", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    parts = max(shards, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = ("shard", "dim", "query", "id", "least", "v")

    def against(queries: DataFrame) -> DataFrame:
        both = (rows.withColumns({"query": F.lit(0), "least": F.lit(None).cast("long")}).select(*cols)
                .unionAll(queries.withColumn("query", F.lit(1)).select(*cols)))
        dealt = both.repartition(parts, "shard").sortWithinPartitions("shard", "dim", "query")
        return dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    first = staged(against(asked.withColumns({"shard": F.col("home"), "least": F.lit(None).cast("long")})), "first-scores")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = asked.join(kth, asked["id"] == kth["query_id"], "left").withColumn(
        "shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))))
    every_one = first.unionAll(against(others)) if shards > 1 else first
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (every_one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: The same result in SQL.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
