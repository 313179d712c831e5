import re

from meterwise.llm import licenses
from meterwise.llm.common import table
from tests_llm_edge import SCHEMA, frame, rows


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        got = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += got
        labels |= {label} if got else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LINES = ["Licensed under the Apache License, Version 2.0 and the MIT\nLICENSE; cc by cc by cc-by",
         "licensed under the really apache license, version 2.0", "gnu general public Key license GNU GENERAL PUBLIC LICENSE",
         "MİT license mit licenſe Kmit license", "cc", "by cc", "License. mit license", "released under mit license terms of the mit the license"]


def data():
    return rows() + [(100 + i, x, "en", "s", 1, 1, 1, 1, 0.0, 1) for i, x in enumerate(LINES)] + \
        [(200, ("filler words " * 3000) + LINES[0], "en", "s", 1, 1, 1, 1, 0.0, 1)] * 2


def check(got, given):
    want = sorted(((r[0] is not None, r[0], *map(str, brute(r[1]))) for r in given), key=str)
    assert sorted(((r.doc_id is not None, r.doc_id, *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in got), key=str) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


def test_edge_rows(spark):
    got = licenses.scan(frame(spark, data())).collect()
    check(got, data())
    by = {r.doc_id: r for r in got}
    assert "apache-2.0" in by[100].labels and "cc-by-nc-4.0" not in by[100].labels
    assert "apache-2.0" in by[101].labels  # one word put in moves the rest to the next diagonal
    assert by[104].labels == "" and by[104].score == 0


def best_stretch(text, notice):
    """By plain loops: the largest share of the notice's pairs in a stretch of its length and six words more; whether one covers enough and has the last."""
    w, p = text.split(), notice.split()
    n = len(p) - 1
    hits = [(i, j) for i in range(len(w) - 1) for j in range(n) if (w[i], w[i + 1]) == (p[j], p[j + 1])]
    shares = [({j for k, j in hits if i <= k <= i + n + 6}) for i, _ in hits]
    return max((len(x) / n for x in shares), default=0), any(len(x) / n >= licenses.COVERAGE and n - 1 in x for x in shares)


def test_a_notice_in_a_longer_run_keeps_its_label(spark):
    notice = "licensed under the apache license version 2 0"
    texts = [notice, notice + " 2 0" * 4, "version 2 0 " * 3 + notice, notice + " 2 0" * 400, "licensed under the apache " + "version 2 0 " * 5,
             "version 2 0 " * 50_000 + notice]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts[:-1]):
        share, whole = best_stretch(t, notice)
        assert ("apache-2.0" in got[i].labels) == whole, t
        assert got[i].n_base or abs(got[i].score - share) < 1e-9
    assert "apache-2.0" in got[1].labels and "apache-2.0" in got[3].labels and "apache-2.0" in got[5].labels and "apache-2.0" not in got[4].labels


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "mit license", 1)] * 3 + [(1, None, 1), (1, None, 1), (2, "cc by", 1)], "doc_id long, text string, at int")
    got = sorted((tuple(r)[:3] for r in licenses.scan(docs.withColumnRenamed("at", "hits")).collect()), key=str)
    assert got == sorted([(None, 2, 1)] * 3 + [(1, 0, 0)] * 2 + [(2, 2, 1)], key=str)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = licenses.scan(docs).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert any("gpl-3.0" in r.labels for r in got) or any(r.n_base for r in got)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
