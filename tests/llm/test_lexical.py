"""Lexical search against scores by plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from meterwise.llm.lexical import Shard, search, terms_of

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, k):
    """Rows (item_id, rank, doc_id, score)."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_terms", [1 << 18, 9])
def test_equals_loops(spark, block_terms):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "the", "THE", "x-y", "a.b", "7"]
    text = lambda n: " ".join(r.choice(words[:r.choice([5, 68])]) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 5, 40]))) for i in range(400)] + [(i, "the copy of w1") for i in range(1000, 1120)]
    docs += [(None, "w2 w3"), (7, "w2 w3"), (7, "w2 w3"), (2000, None), (2001, ""), (2002, "... --")]
    items = [(i, text(r.choice([1, 4, 20]))) for i in range(12)] + [(90, "The Copy"), (90, "w1 w1 copy"), (None, "w2"), (91, None), (92, ""), (93, "nowhere")]
    got = search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), k=20, block_terms=block_terms)
    assert rows(got) == sorted(ranking(docs, items, 20), key=repr)


def test_long_text_string_ids_and_clashing_names(spark):
    docs = [("b", "w " * 300_000 + "rare", 1, 2, 3), ("a", "w rare", 1, 2, 3), (None, "rare", 1, 2, 3)]
    frame = spark.createDataFrame(docs, "doc_id string, text string, id int, item int, n int")
    items = spark.createDataFrame([(1, "rare", 5)], "item_id long, text string, terms int")
    got = search(frame, items).collect()
    want = ranking([(d, t) for d, t, *_ in docs if d] + [("zz", "rare")], [(1, "rare")], 50)
    assert [(r["rank"], r["doc_id"] or "zz", r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [w[1:] for w in want]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (spark.createDataFrame([(1, None)], DOCS), items)):
        found = search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_terms_are_folded_bytewise():
    texts = ["Ab-c É9 _x", None, "", "\x00A\x7fB", "ÀÉ"]
    flat, size = terms_of(pa.array(texts).slice(0, 5))
    want = [terms(t) for t in texts]
    assert size.tolist() == [len(w) for w in want] and flat.to_pylist() == [x for w in want for x in w]
    flat, size = terms_of(pa.array(texts).slice(2, 3))
    assert size.tolist() == [len(w) for w in want[2:]]


def test_skipped_blocks_hold_no_result():
    rng = np.random.default_rng(2)
    n, width = 3000, 300
    topic = rng.integers(0, 20, n)
    bag = [np.unique(np.concatenate([rng.integers(0, 15, 10), 15 + 14 * topic[i] + rng.integers(0, 14, 8)])) for i in range(n)]
    vid = np.concatenate(bag)
    impact = np.where(vid < 15, rng.integers(1, 50, len(vid)), rng.integers(100, 1000, len(vid)))
    ptr = np.concatenate([[0], np.cumsum([len(b) for b in bag])])
    shard = Shard(pa.array(np.arange(n)), ptr, vid, impact, width)
    fewer = 0
    for t in range(20):
        terms_ = np.unique(np.concatenate([rng.integers(0, 15, 4), 15 + 14 * t + rng.integers(0, 14, 6)]))
        wanted = np.zeros(width, np.int64)
        wanted[terms_] = 1
        found, scored = shard.search(terms_, 10, 1, wanted)
        all_ = np.add.reduceat(impact * wanted[vid], ptr[:-1])
        order = np.lexsort((np.arange(n), -all_))[:10]
        assert sorted(found, key=lambda r: (-r[0], r[1])) == [(int(all_[i]), int(i)) for i in order]
        fewer += scored < (all_ > 0).sum() / 2
    assert fewer >= 15  # the bounds skip work
