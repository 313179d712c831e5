import math
import random

import pytest

from meterwise.llm import topk
from meterwise.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, score double, shard string"


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ask = {}
    for i, v in ok:
        if i % every == 0:
            ask[i] = min(v, ask.get(i, v))
    out = []
    for q, qv in ask.items():
        s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    f = lambda: rnd.randrange(-64, 65) / 32  # noqa: E731  exact floats with many ties
    rows = [(i, [f() for _ in range(6)], 0.0, "x") for i in range(900)]
    rows += [(1000 + i, rows[100][1], 0.0, "x") for i in range(400)]
    rows += [(2000, None, 0.0, "x"), (2001, [1.0, None] * 3, 0.0, "x"), (2050, [float("nan")] * 6, 0.0, "x"), (2002, [float("inf")] * 6, 0.0, "x"),
             (3000, [1.0, 2.0], 0.0, "x"), (3001, [2.0, 2.0], 0.0, "x"), (3050, [], 0.0, "x"), (None, [9.0] * 6, 0.0, "x"), rows[50], rows[51], rows[51],
             (4000, [0.0] * 6, 0.0, "x"), (-50, [1.0] * 6, 0.0, "x")]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 22 + i % 3), float(-(2 ** 21) + i), 1.0], 0.0, "x") for i in range(120)]
    assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_scores_beyond_64_bits_are_an_error(spark):
    for big in (3e9, 1e300):
        df = spark.createDataFrame([(i, [big, big]) for i in range(60)], "vec_id long, embedding array<double>")
        with pytest.raises(ArithmeticError, match="64-bit"):
            topk.top_k(df)


def test_embeddings(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
