import re

import pytest

from meterwise.llm import mixing
from meterwise.llm.common import table
from tests_llm_edge import frame, rows


def brute_targets(sizes, weights=(5, 2, 1), share=1.0, most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > most * sizes[s]]
        if not over:
            out.update(t)
            break
        for s in over:
            out[s] = most * sizes[s]
            open_.remove(s)
    return out


def check(got, fan_slack=1):
    per, target, biggest, taken = {}, {}, {}, {}
    for r in got:
        per[r.source] = per.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        biggest[r.source] = max(biggest.get(r.source, 0), r.size)
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        assert r.size or not r.taken
    want = brute_targets(per)
    for s in per:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6
    assert all(r.source_size == per[r.source] for r in got)


def test_edge_rows(spark):
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(rows())
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in got) == sorted(count(r[1]) for r in rows())
    check(got)


def test_documents_and_reruns(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    first = mixing.mix(docs).collect()
    check(first)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.id, r.taken) for r in first) == sorted((r.id, r.taken) for r in again)


def test_many_units_and_small_fan(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text",
                                      "case when id % 3 = 0 then null when id % 3 = 1 then 'a' else concat('b', id % 5) end as source")
    check(mixing.mix(df, fan=4).collect())


def test_mixed_rows_follow_copies(spark):
    df = frame(spark)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in mixing.mix(df).collect())


def test_the_last_document_of_a_small_source_is_made_up_for(spark):
    """One document holds most words of its source: the others bring the words near the target."""
    sizes = [(4700, "small")] + [(10 + i, "small") for i in range(60)] + [(200, "large")] * 100
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate(sizes)], "doc_id long, text string, source string")
    for seed in range(6):
        got = mixing.mix(docs, seed=seed).collect()
        check(got)
        target = next(r.target for r in got if r.source == "small")
        assert abs(sum(r.taken for r in got if r.source == "small") - target) < 0.02 * target


def test_mixed_rows_keep_their_source_and_number(spark):
    """Rows of one id and text in two sources; further columns may have any names."""
    data = [(1, "a b c", "s1", i, 0, 0) for i in range(2)] + [(1, "a b c", "s2", i, 0, 0) for i in range(3)] + [(2, "x " * 5, "s2", 9, 0, 0), (None, None, None, 1, 0, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, key int, row int, copies int")
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.id, r.source] = want.get((r.id, r.source), 0) + r.copies
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed(frame(spark, [])).count() == 0
