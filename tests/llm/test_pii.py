"""Personal data: rules against plain loops, boosted trees on held-out candidates and on written examples."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from meterwise.llm import pii, queries
from meterwise.llm.common import table

SF = "/root/testdata/sf0.1"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def by_rules(text):
    """The rules as they are written, one regular expression a kind."""
    out = []
    for k, p in enumerate(RULES):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            check = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 12 <= len(digits) <= 19 and check
                    or k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(table(spark, SF, "documents"))


def test_rules_equal_their_expressions():
    r = random.Random(1)
    parts = ["@", ".", "a", "b-c", "x_%+", "@host.example", "1", "22", "255", "256", "0007", " ", "-", "+", "+1 (509) 555-6973", "4111111111111111",
             "4111 1111 1111 1111", "10.0.0.1", "(", ")", "é", "\n", "1.2.3", "joe.x@", "a@b@c.d", "9" * 13]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == by_rules(text), text


def test_query_over_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op13_pii(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans, r = by_rules(d["text"]), got[d["doc_id"]]
        written = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        listed = r["spans"].split(",") if r["spans"] else []
        assert set(written) <= set(listed) and len(listed) == len(written) + r["n_added"]
        order = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in listed]
        assert order == sorted(order)


def test_held_out_candidates(model):
    assert set(model) == {"0", "1", "2", "3"}
    for m in model.values():
        assert m["held_out_precision"] >= 0.98 and m["held_out_recall"] >= 0.95


def test_written_examples(spark, model):
    cases = {
        "call (509) 555-6973 or 509-555-6973": ["(509) 555-6973", "509-555-6973"],
        "mail joe.doe at example dot com please": ["joe.doe at example dot com"],
        "or joe(at)mail(dot)example(dot)com": ["joe(at)mail(dot)example(dot)com"],
        "card 4111.1111.1111.1111": ["4111.1111.1111.1111"],
        "4111111111111111 5500005555555559": ["4111111111111111", "5500005555555559"],
        "+1 (826) 555-4081 190.137.223.204": ["+1 (826) 555-4081", "190.137.223.204"],
        "the token = \"5d190bd7c06284de91015a36974748794293dd8a\"": [],
        "on 2024-01-15 at 12:30 we had 1,234,567.89 items": [],
        "look at that. Then at home.Now": [],
        "order 1234567890 of 12.04.2023": [],
    }
    docs = spark.createDataFrame(list(enumerate(cases)), SCHEMA)
    for r in pii.find(docs, model).collect():
        text = list(cases)[r["doc_id"]]
        assert [text[s["start"]:s["end"]] for s in r["spans"]] == cases[text], text


def test_added_spans_leave_clean_documents_alone(spark, model):
    """Without digits and at signs nothing is found; added spans touch no base span."""
    for r in pii.find(table(spark, SF, "documents"), model).join(table(spark, SF, "documents").select("doc_id", "text"), "doc_id").collect():
        if not re.search("[0-9@]", r["text"] or ""):
            assert r["spans"] == []
        base = {(s["start"], s["kind"], s["end"]) for s in r["base"]}
        for s in r["spans"]:
            if (s["start"], s["kind"], s["end"]) not in base:
                assert not any(b[0] < s["end"] and s["start"] < b[2] for b in base)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    m = pii.boost(x[:2000], y[:2000])
    assert (((pii.margins(m, x[2000:]) > 0) == y[2000:]).mean()) > 0.98
    a, b, t = pii.calibrate(pii.margins(m, x[2000:]), y[2000:], 0.95)
    chosen = 1 / (1 + np.exp(-(a * pii.margins(m, x[2000:]) + b))) >= t
    assert y[2000:][chosen].mean() >= 0.95


def test_nulls_empty_long_and_repeated_texts(spark, model):
    long = "9" * 200_000 + " " + "a" * 200_000 + "@" + "b" * 200_000 + "+1" + " " * 200_000 + "x" + "1.2." * 50_000 + " joe@example.org"
    docs = spark.createDataFrame([(1, None, 3, "k"), (2, "", 3, "k"), (None, "joe@example.org", 3, "k"), (4, "joe@example.org", 3, "k"),
                                  (4, "joe@example.org", 3, "k"), (5, long, 3, "k")], "doc_id long, text string, base int, id string")
    got = sorted((tuple(r) for r in pii.digests(pii.find(docs, model)).collect()), key=str)
    assert [r for r in got if r[0] in (1, 2)] == [(i, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0) for i in (1, 2)]
    assert [r[1:] for r in got if r[0] in (4, None)] == [(1, 0, 0, 0, hashlib.sha256(b"email:0:15").hexdigest(), "email:0:15", 0)] * 3
    assert next(r for r in got if r[0] == 5)[1] == len([x for x in pii.base_spans(long) if x[1] == 0]) >= 1
    left = {r["doc_id"]: r for r in pii.redacted(docs, model).collect()}
    assert left[4]["text"] == "[EMAIL]" and left[4]["id"] == "k" and left[1]["text"] is None and left[2]["text"] == ""


def test_empty_table_and_no_positives(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pii.fit(docs) == {} and pii.find(docs, {}).count() == 0
    plain = spark.createDataFrame([(1, "no 123456789 data")], SCHEMA)
    assert pii.fit(plain) == {}
    assert pii.find(plain, {}).first()["spans"] == []


def test_every_candidate_counts(spark, tmp_path):
    """The trees are those of all candidates together: a corpus of copies gives the trees of plain boosting on every row, and the rows add up."""
    docs = spark.createDataFrame([(i, f"call +1 (509) 555-{6000 + i % 90} or write to joe{i % 7}@mail.example.org, order {1234567 + i}") for i in range(900)], SCHEMA)
    rows = pii.training_rows(docs.select(docs.doc_id.alias("id"), "text")).toPandas()
    got = pii.fit(docs.repartition(5), rounds=2)
    assert {k: m["rows"] for k, m in got.items()} == {str(k): n for k, n in rows.groupby("kind").size().items() if str(k) in got} and len(got) == 2
    for k, m in got.items():
        mine = rows[(rows["kind"] == int(k)) & ~rows["held_out"]]
        whole = pii.boost(np.array(mine["features"].tolist()), mine["label"].to_numpy(float), rounds=2)
        x = np.array(rows[rows["kind"] == int(k)]["features"].tolist())
        assert np.abs(pii.margins(m, x) - pii.margins(whole, x)).max() < 1e-5
    assert pii.fit(docs.repartition(2), rounds=2) == got
