import zlib

import numpy as np

from meterwise.llm import quality
from meterwise.llm.common import table
from tests_llm_edge import frame, rows


def naive_features(text, buckets):
    """The same features by loops over code points."""
    mod, p = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(h):
        h = ((h ^ (h >> 29)) * p) & mod
        return h ^ (h >> 32)

    space = lambda c: c == 32 or 9 <= c <= 13
    code, out = [ord(c) for c in text], []
    for n in quality.ORDERS:
        for i in range(len(code) - n + 1):
            g = code[i:i + n]
            if any(map(space, g[1:-1])):
                continue
            h = g[0]
            for c in g[1:]:
                h = (h * p + c) & mod
            out.append(mix((h + n) & mod) % buckets)
    words, cur = [], []
    for c in code + [32]:
        if space(c):
            words += [cur] if cur else []
            cur = []
        else:
            cur.append(c)
    hs = [sum(mix((c + 1) & mod) * (mix((k + p) & mod) | 1) for k, c in enumerate(w)) & mod for w in words]
    out += [mix((h + 1) & mod) % buckets for h in hs]
    out += [mix((a == b) + 7) % buckets for a, b in zip(hs, hs[1:])]
    return sorted(out)


def test_features_match_loops():
    for r in rows():
        t = (r[1] or "")[:3000]
        assert sorted(quality.text_features(t, 977).tolist()) == naive_features(t, 977)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = quality.score(docs, quality.fit(docs, labels, sample_rows=1200)).toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98
    assert held[held.quality == 0].predicted.mean() < 0.25


def test_edge_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0), (None, 1), (40, None), (5, 1)], "doc_id long, quality int")
    df = frame(spark)
    model = quality.fit(df, labels, steps=20)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert (quality.fit(df, labels, steps=20)[0] == model[0]).all()
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    logits, bias = quality.fit(frame(spark), none)
    assert not logits.any() and bias == 0
    assert {r.score for r in quality.score(frame(spark), (logits, bias)).collect()} == {0.5}
    assert quality.score(frame(spark, []), (np.zeros(8), 0.0)).count() == 0


def test_scores_do_not_depend_on_the_cap(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    share = labels.toPandas().quality.mean()
    for sample_rows in (300, 3000):  # one binds, the other does not
        got = quality.score(docs, quality.fit(docs, labels, sample_rows=sample_rows)).toPandas()
        held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
        assert abs(held.score.mean() - share) < 0.06, sample_rows


def test_a_binding_cap_keeps_the_class_shares(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "staged", lambda df, tag: seen.append(df) or df)
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(4000)], "doc_id long, quality int")
    quality.fit(frame(spark), labels, sample_rows=400, steps=1)
    y = [r.y for r in seen[0].collect()]
    assert len(y) == 800 and 0.82 < np.mean(y) < 0.93
