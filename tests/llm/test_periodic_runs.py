"""Periodic runs against plain loops over the words."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from meterwise.llm import queries
from meterwise.llm.common import split_words
from meterwise.llm.periodic_runs import digests, find_runs, periodic_runs

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def loops(w, min_length=6, exponent=4):
    """Every stretch that keeps a period, grown word by word; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(min_length, exponent * q):
                best.setdefault((s, i + q - s), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def row(doc_id, w):
    runs = loops(w)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_equal_loops():
    r = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(r.randint(1, 5)):
            n, k = r.choice([0, 1, 3, 6, 10, 40, 100, 300]), r.choice([1, 2, 3, 8])
            w = [r.randrange(k) for _ in range(n)]
            if r.random() < 0.6 and n > 8:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(3, 10)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            docs.append(w)
        e = r.choice([2, 3, 4])
        got = find_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]), 6, e)
        assert [tuple(x) for x in got.tolist()] == [(t, *x) for t, d in enumerate(docs) for x in loops(d, 6, e)]


def test_words_are_cut_at_ascii_white_space_only():
    texts = [" a  b\tc\n", "", None, "x\x0b\x0cy\r", "one\u00a0word \u2003 \x1c \x85", "\n"]
    words, size = split_words(pa.array(texts))
    want = [(t or "").encode().split() for t in texts]
    assert size.tolist() == [len(w) for w in want]
    assert [w.encode() for w in words.to_pylist()] == [x for w in want for x in w]


def test_query_equals_loops(spark):
    got = {r[0]: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = [x.decode() for x in (d["text"] or "").encode().split()]
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        assert got[d["doc_id"]] == row(d["doc_id"], w)


def test_nulls_empty_long_and_repeated_texts(spark):
    long = "a b " * 60_000 + "c"
    rows = [(1, None), (2, ""), (3, "x x x x x x"), (3, "x x x x x x"), (None, "p q p q p q p q"), (4, long), (5, "x x x x x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = periodic_runs(docs)
    by = {}
    for r in digests(found).collect():
        by.setdefault(r[0], []).append(tuple(r))
    for i, t in rows:
        if i != 4:
            assert row(i, (t or "").split()) in by[i]
    assert by[4][0][1:6] == (1, 0, 120_000, 2, 60_000_000)
    assert len(by[3]) == 2
    assert {r["doc_id"]: r["collapsed"] for r in found.collect()}[4] == "a b c"


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert digests(periodic_runs(docs)).count() == 0
    more = spark.createDataFrame([(7, "x x x x x x", 1, 2)], "doc_id long, text string, runs int, id int")
    assert digests(periodic_runs(more)).first()[:6] == (7, 1, 0, 6, 1, 6000)
    named = periodic_runs(more.withColumnRenamed("doc_id", "key"), id_col="key")
    assert named.columns == ["key", "n_words", "runs", "collapsed"]
