import random

import xxhash

from meterwise.llm import simhash
from tests_llm_edge import frame, rows


def brute_print(text, k=4):
    raw = (text or "").encode().lower().split()
    grams = [b" ".join(raw[i:i + k]) for i in range(max(1, len(raw) - k + 1))] if raw else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(prints, d):
    head = {p: p for p in prints}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[i + 1:]:
            if (a ^ b).bit_count() <= d:
                head[top(a)] = top(b)
    return {p: top(p) for p in ps}


def test_matches_brute_force(spark):
    data = rows()
    got = simhash.near_duplicates(frame(spark)).collect()
    prints = [brute_print(r[1]) for r in data]
    comp = brute_components(set(prints), 4)
    ids = {}
    for r, p in zip(data, prints):
        ids.setdefault(comp[p], []).append(r[0])
    small = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    want = sorted((str(r[0]), f"{p:016x}", small[comp[p]]) for r, p in zip(data, prints))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_links_with_hot_buckets(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(120):  # dense clouds round a few centres
            x = b
            for i in rnd.sample(range(64), rnd.randrange(1, 5)):
                x ^= 1 << i
            fps.add(x)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    want = brute_components(fps, 4)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == c) for c in set(m.values()))
    for bucket_rows in (1 << 15, 16):
        pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, 4, bucket_rows).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        head = {x: x for x in fps}

        def top(x):
            while head[x] != x:
                x = head[x]
            return x

        for a, b in pairs:
            head[top(a)] = top(b)
        assert groups({x: top(x) for x in fps}) == groups(want)


def test_one_of_each_keeps_columns_and_one_row(spark):
    df = frame(spark)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    heads = {(r.component_id, r.keep_key) for r in simhash.near_duplicates(df).collect()}
    assert kept.count() == len(heads)


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_one_of_each_with_clashing_names(spark):
    data = [(2, "a b c d e f", "x", 7, 8), (1, "a b c d e f", "y", 7, 8), (None, None, None, 7, 8), (3, "q r s t u v", "z", 7, 8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, __text_key string, text_key int, id_ int")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([data[1], data[2], data[3]], key=str)
