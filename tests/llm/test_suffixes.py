import hashlib
import random

import numpy as np
import pytest

from meterwise.llm import suffixes
from meterwise.llm.common import table
from tests_llm_edge import SCHEMA, frame, rows


def brute(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - length + 1):
            w = r[i:i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                cover[i:i + length] = b"\x01" * length
        kept = bytes(c for c, x in zip(r, cover) if not x)
        out.append((len(r), sum(cover), sum(1 for i, x in enumerate(cover) if x and (i == 0 or not cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, data, **options):
    got = suffixes.dedup(spark.createDataFrame(data, SCHEMA), **options).collect()
    want = brute([r[1] for r in data], options.get("length", 400))
    key = lambda r: (r[0] is not None, *r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((d[0], *w) for d, w in zip(data, want)), key=key)


def planted(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 8)))
    passage = " ".join(word() for _ in range(200))
    out = []
    for i in range(n):
        t = [word() for _ in range(rnd.randrange(0, 150))]
        if i % 2:
            lo = rnd.randrange(0, 200)
            t.insert(rnd.randrange(len(t) + 1), passage[lo:lo + rnd.randrange(300, 900)])
        if i % 5 == 0 and out:
            s = list(rnd.choice(out))
            for _ in range(rnd.randrange(0, 3)):
                if s:
                    s[rnd.randrange(len(s))] = "#"
            t = ["".join(s)] + t[:3]
        out.append(" ".join(t))
    out += ["ab" * 900, "xyz" * 500, "ab" * 200, passage, passage]
    return [(i, t, "en", "s", 1, 1, 1, 1, 0.0, 1) for i, t in enumerate(out)]


@pytest.mark.parametrize("length,group_rows", [(400, 512), (400, 3), (40, 2), (64, 512)])
def test_planted(spark, length, group_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_ROWS", 7)
    check(spark, planted(length + group_rows, 90), length=length, group_rows=group_rows)


def test_edge_rows(spark):
    check(spark, [r for r in rows() if not (r[1] and len(r[1]) > 50000)])


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    b = suffixes.np.frombuffer(random.Random(1).randbytes(9000) * 2, suffixes.np.uint8)
    cut = suffixes.anchors(b, 400, 64)
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 19)
    assert all((x == y).all() for x, y in zip(cut, suffixes.anchors(b, 400, 64)))


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    data = [(r.doc_id, r.text, "en", "s", 1, 1, 1, 1, 0.0, 1) for r in docs.collect()]
    check(spark, data)


def test_rows_that_are_left(spark):
    df = frame(spark)
    left = suffixes.dedup(df, returns="rows")
    assert left.columns == df.columns and left.count() == df.count()
    size = {(r.doc_id, r.n_bytes - r.n_removed) for r in suffixes.dedup(df).collect() if r.doc_id is not None}
    text = {r.doc_id: r.text for r in left.collect()}
    assert text[6] == "" and text[0] is None  # a copy has nothing left, a null text had nothing to lose
    assert all(len((text[i] or "").encode()) <= n for i, n in size if i not in (3,))


def test_rows_with_clashing_names(spark):
    text = "".join(random.Random(3).choice("abcdefg ") for _ in range(900))
    data = [(1, text, 1, 2, 3, 4, 5, 6), (2, "x" + text, 1, 2, 3, 4, 5, 6), (None, "short", 1, 2, 3, 4, 5, 6), (3, None, 1, 2, 3, 4, 5, 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, cuts int, sid int, K1 int, k2 int, starts int, id int")
    left = suffixes.dedup(docs, returns="rows")
    assert left.columns == docs.columns
    got = {r.doc_id: (r.text, r.cuts, r.sid, r.K1, r.id) for r in left.collect()}
    assert got == {1: ("", 1, 2, 3, 6), 2: ("x", 1, 2, 3, 6), None: ("short", 1, 2, 3, 6), 3: (None, 1, 2, 3, 6)}


def test_text_that_repeats_itself(spark):
    """A million equal characters give one segment, a short period few."""
    rnd = random.Random(4)
    texts = ["a" * 1_000_000, "xyz" * 100_000, "b" * 400, "c" * 401, "".join(rnd.choice("pqrs") for _ in range(300_000))]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = data.selectExpr("doc_id as id", "text").select("id", *suffixes.text_keys("text"), "text")
    assert suffixes.segments(small.filter("id < 2"), 400, 64).count() <= 8
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.dedup(data).collect()}
    assert got == {0: (1_000_000, 1_000_000, 1), 1: (300_000, 300_000, 1), 2: (400, 0, 0), 3: (401, 401, 1), 4: (300_000, 0, 0)}


def test_state_goes_through_files(tmp_path):
    """Order, prefixes and transform of a round are read from the files of the round before it."""
    segs = [b"abcabcab", b"xbcabcab", b"abcabcay"]
    with suffixes.Columns(str(tmp_path)) as columns:
        columns.windows(np.zeros(9, np.int64), [b"z" * 30] * 9, np.full(9, 4), np.ones(9), 6)  # a larger batch before
        marks = columns.windows(np.zeros(3, np.int64), segs, np.array([2, 2, 2]), np.ones(3), 6)
    want = [[sum(s[i:i + 6] == t[i:i + 6] for t in segs) > 1 for i in range(3)] for s in segs]
    assert marks.tolist() == want
    assert {p.name for p in tmp_path.iterdir()} == {"symbols", *(f"{n}-{k}" for n in ("order", "prefix", "transform") for k in (0, 1))}


def test_empty(spark):
    assert suffixes.dedup(frame(spark, [])).count() == 0


def test_passage_shorter_than_the_length_stays(spark):
    """A passage of over 50 words but under 400 bytes is cut by a shorter length only; one of 400 bytes is cut, one of 399 is not."""
    rnd = random.Random(6)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage, full, short = " ".join(letters(5) for _ in range(60)), letters(400), letters(399)
    texts = [f"{a}{p}{b}" for p in (passage, full, short) for a, b in ("AB", "CD")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = lambda **o: {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.dedup(docs, **o).collect()}
    assert cut() == {0: (0, 0), 1: (0, 0), 2: (400, 1), 3: (400, 1), 4: (0, 0), 5: (0, 0)}
    assert cut(length=200) == {0: (359, 1), 1: (359, 1), 2: (400, 1), 3: (400, 1), 4: (399, 1), 5: (399, 1)}
