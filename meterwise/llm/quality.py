"""Quality classifier: supervised subword embeddings.

A text's features are its words, whether a word repeats the one before it, and
its character n-grams (code points; no n-gram spans white space), hashed into a
fixed number of buckets.  Each bucket
has a learned vector; a document is the average of its features' vectors, and a
softmax over the average gives the class probabilities.  Vectors and output
weights are trained together by numpy stochastic gradient descent over mini
batches, with a step that shrinks per coordinate as its gradients add up.

Training reads at most 2 x ``sample_rows`` labelled documents, picked by a hash
of the id and so at one rate for both classes (their shares, and with them the
scores, do not depend on the input's size), outside the held-out fold (crc32 of the id as text, modulo
``folds``, equal to 0).  Their features are computed where the rows are; the
bounded sample is then trained in one task.  The model (buckets x dims floats)
has a fixed size and is broadcast.  As the average is linear, every bucket's
vector is folded into one logit before scoring.

Defined cases: null and empty texts have no features and score the bias;
without any label all scores are 0.5; ids whose labels disagree are not used;
repeated rows are scored one by one; texts are read whole; an empty table
gives no rows; only the named columns are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterwise.llm.common import batches_of, crc_fold, staged, text_of

BUCKETS = 1 << 16
DIMS = 8
ORDERS = (2, 3, 4)
BLOCK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _P
    return h ^ (h >> np.uint64(32))


def text_features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every word and character n-gram, repeats included."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(code):
        return np.empty(0, np.int64)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    out = []
    h = code
    crossed = np.zeros(len(code), bool)
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            break
        h = h[:-1] * _P + code[n - 1:]
        if n > 2:  # the characters between the first and the last must not be white space
            crossed = crossed[:-1] | space[n - 2:len(code) - 1]
        else:
            crossed = crossed[:-1]
        if n in ORDERS:
            out.append(_mix(h[~crossed] + np.uint64(n)))
    # A word's hash: sum of code points times odd powers, from prefix sums modulo 2^64.
    edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts):
        from_start = np.concatenate([[0], starts, [len(code)]])
        place = np.arange(len(code)) - np.repeat(from_start[:-1], np.diff(from_start))
        weight = _mix(place.astype(np.uint64) + _P) | np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(code + np.uint64(1)) * weight, dtype=np.uint64)])
        word = sums[ends] - sums[starts]
        out.append(_mix(word + np.uint64(1)))
        out.append(_mix((word[1:] == word[:-1]).astype(np.uint64) + np.uint64(7)))  # the word again, or another one
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64) if out else np.empty(0, np.int64)


def blocks(text: str) -> Iterator[str]:
    """Very long texts in pieces, all of them, so that the arrays stay bounded."""
    return (text[i:i + BLOCK] for i in range(0, len(text), BLOCK))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, dims: int, steps: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """rows: (label, buckets, weights that sum to 1).  Returns the logit of class 1 against 0 for each bucket, and the bias."""
    rnd = np.random.default_rng(seed)
    vec = rnd.uniform(-1.0 / dims, 1.0 / dims, (buckets, dims))
    out, bias = np.zeros((dims, 2)), np.zeros(2)
    seen = [np.full_like(x, 1e-6) for x in (vec, out, bias)]

    def step(x, at, grad, k):
        seen[k][at] += grad * grad
        x[at] -= rate * grad / np.sqrt(seen[k][at])

    order = np.empty(0, int)
    for _ in range(steps if rows else 0):  # as many steps whatever the sample's size
        if len(order) < 16:
            order = np.concatenate([order, rnd.permutation(len(rows))])
        batch, order = [rows[i] for i in order[:16]], order[16:]
        ids, w = np.concatenate([r[1] for r in batch]), np.concatenate([r[2] for r in batch])
        doc = np.repeat(np.arange(len(batch)), [len(r[1]) for r in batch])
        part = vec[ids] * w[:, None]
        hidden = np.stack([np.bincount(doc, part[:, d], len(batch)) for d in range(dims)], 1)
        z = hidden @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(batch)), [r[0] for r in batch]] -= 1
        p /= len(batch)
        back = p @ out.T
        uniq, inv = np.unique(ids, return_inverse=True)
        grad = np.stack([np.bincount(inv, back[doc, d] * w, len(uniq)) for d in range(dims)], 1)
        step(out, slice(None), hidden.T @ p, 1)
        step(bias, slice(None), p.sum(0), 2)
        step(vec, uniq, grad, 0)
    return vec @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = 3000, folds: int = 5, buckets: int = BUCKETS, dims: int = DIMS, steps: int = 2000,
        rate: float = 0.1, seed: int = 13) -> tuple[np.ndarray, float]:
    """Train on at most 2 x ``sample_rows`` documents, both classes at one rate; (logit of each bucket, bias)."""
    known = (labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (crc_fold(id_col, folds) != 0))
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("top")).filter("y = top"))
    known = known.withColumn("h", F.xxhash64("id"))
    some = known.orderBy("h", "id").limit(2 * sample_rows)
    some = staged(some.select("id", "y", "h"), "label-sample")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(some), "id")  # 2 x sample_rows at most
    texts = texts.groupBy("id", "y", "h").agg(F.min("text").alias("text"))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = [], []
            for t in batches_of(b, "text"):
                c = np.zeros(buckets, np.int64)
                for piece in blocks(t):
                    c += np.bincount(text_features(piece, buckets), minlength=buckets)
                ids.append(np.flatnonzero(c).astype(np.int32))
                counts.append(c[ids[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
                                             names=["id", "y", "h", "ids", "counts"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            ids, counts = b.column(3), b.column(4)
            cuts = ids.offsets.to_numpy()
            flat, weight = ids.values.to_numpy(), counts.values.to_numpy()
            got += [(h, str(i), int(y), flat[lo:hi].copy(), weight[lo:hi].copy()) for i, y, h, lo, hi in
                    zip(*(b.column(k).to_pylist() for k in range(3)), cuts[:-1].tolist(), cuts[1:].tolist())]
        got.sort(key=lambda r: r[:2])
        rows = [(y, i, c / c.sum()) for _, _, y, i, c in got if len(i)]
        logits, bias = train(rows, buckets, dims, steps, rate, seed)
        yield pa.RecordBatch.from_arrays([pa.array([logits.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["logits", "bias"])

    kind = texts.schema["id"].dataType.simpleString()
    kind_y = texts.schema["y"].dataType.simpleString()
    sparse = texts.mapInArrow(features, f"id {kind}, y {kind_y}, h long, ids array<int>, counts array<float>")
    model = sparse.repartition(1).mapInArrow(learn, "logits array<double>, bias double").collect()  # one row
    return (np.array(model[0]["logits"]), model[0]["bias"]) if model else (np.zeros(buckets), 0.0)


def probability(text: str, logits: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for piece in blocks(text):
        f = text_features(piece, len(logits))
        total, n = total + float(logits[f].sum()), n + len(f)
    z = bias + (total / n if n else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
          threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one float a bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = held.value
        for b in batches:
            p = [probability(t, logits, bias) for t in batches_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = src.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (crc_fold("id", folds) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = held.value
        for b in batches:
            yield b.filter(pa.array([probability(t or "", logits, bias) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
