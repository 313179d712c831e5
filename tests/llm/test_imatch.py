import hashlib

import pytest
import regex
import xxhash

from meterwise.llm import imatch
from meterwise.llm.common import table
from tests_llm_edge import frame, rows


def brute(given, key=lambda r: 0):
    """{(id, text): (n_chars, sha)} for documents whose ids are all different."""
    out = {}
    for i, r in enumerate(given):
        t, nxt = r[1] or "", given[(i + 1) % len(given)][1] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        out[r[0]] = (len(t), hashlib.sha256(edited.encode()).hexdigest())
    return out


def test_edited_texts(spark):
    given = [r for r in rows() if r[0] is not None][:50]
    got = imatch.fingerprints(frame(spark, given)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute(given) and len(got) == 50
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(given[r.doc_id][1], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert got[0] and {r.doc_id: r.near_next for r in got}[6] == 1  # 7 repeats 6


def test_all_edge_rows(spark):
    got = imatch.fingerprints(frame(spark)).collect()
    assert len(got) == len(rows())
    one = imatch.fingerprints(frame(spark, rows()[6:7])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_documents_keep_likeness_after_an_edit(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = imatch.fingerprints(docs).toPandas()
    want = brute([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got.itertuples()} == want
    assert got.near_edited.mean() > 0.3 > 0.05 > got.near_next.mean()


def test_empty(spark):
    assert imatch.fingerprints(frame(spark, [])).count() == 0


def test_every_term_counts(spark):
    """Each word of a text without lexicon terms changes its fingerprint, and near copies of short texts stay alike."""
    words = [f"w{i}" for i in range(40)]
    given = [" ".join(words[:k]) for k in range(1, 13)] + [" ".join(words[20:30]), " ".join(words[20:29])]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.fingerprints(df, band=(2.0, 3.0)).collect()}
    assert len({r.fingerprint for r in got.values()}) == len(given)
    assert all(got[i].near_next > 0.3 for i in range(2, 11)) and 0.3 < got[12].near_next < 1


def test_no_text_loses_its_terms(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("text rlike '[a-zA-Z]'")
    fp = imatch.with_fingerprint(docs, docs.text, "fp", imatch.lexicon(docs))
    seen = fp.select(imatch.shown(fp.fp).alias("shown"), "fp.whole").distinct().toPandas()
    assert not seen.shown.isin(["-", ""]).any() and seen.shown.is_unique and seen.whole.is_unique


def xx(data):
    """Spark's xxhash64 of a string, or of longs one after the other."""
    if isinstance(data, str):
        return xxhash.xxh64_intdigest(data.encode(), 42)
    seed = 42
    for x in data:
        seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def by_loops(texts):
    """{text: {sub-lexicon: value}} by plain loops."""
    words = {t: {xx(w) for w in regex.findall(r"[\p{L}\p{N}]+", t.lower())} for t in texts}
    n, df = len(texts), {}
    for t in texts:
        for h in words[t]:
            df[h] = df.get(h, 0) + 1
    lexicon = {h for h, k in df.items() if imatch.BAND[0] * n <= k <= imatch.BAND[1] * n}
    out = {}
    for t in texts:
        ranked = sorted(words[t], key=lambda h: (h not in lexicon, signed(h)))
        used = ranked[:max(imatch.FEW, len(words[t] & lexicon))]
        low, hashes, got, shift = (1 << 56) - 1, sorted((signed(xx([h])) for h in used)), {}, 0
        for classes, one in imatch.FAMILIES:
            for k in range(classes):
                held = [g for g in hashes if one == ((g & (1 << 64) - 1) >> shift & classes - 1 == k)]
                if held:
                    got[k + (0 if not one else imatch.FAMILIES[0][0])] = xx(held)
            shift += classes.bit_length()
        first, fine = sum(c for c, _ in imatch.FAMILIES), {}
        for g in hashes:
            k = first + ((g & (1 << 64) - 1) >> shift & imatch.FINE - 1)
            fine.setdefault(k, []).append(signed(g & low | k << 56))
        got |= {k: xx(",".join(map(str, sorted(g)))) for k, g in fine.items()}
        out[t] = {k: v & low | k << 56 for k, v in got.items()}
    return out


def alike(a, b):
    return 1.0 if a == b else sum(a.get(k) == b.get(k) for k in a.keys() & b.keys()) / len(a.keys() | b.keys())


def test_fingerprints_equal_loops(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    given = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    want = by_loops([t for _, t in given])
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    for i, (d, t) in enumerate(given):
        numbers = sorted(want[t], key=lambda k: (k >= 12, signed(want[t][k]) if k >= 12 else k))
        assert got[d].fingerprint == (".".join(f"{want[t][k]:x}" for k in numbers) or "-")
        assert got[d].near_next == pytest.approx(alike(want[t], want[given[(i + 1) % len(given)][1]]))


@pytest.mark.parametrize("common", range(0, 60, 4))
def test_one_word_changes_little_at_every_size(spark, common):
    """Texts of 70 words, ``common`` of them in the lexicon; one of either kind is changed: no switch at any size."""
    lex = [f"c{i}" for i in range(60)]
    first = lex[:common] + [f"r{i}" for i in range(70 - common)]
    texts = [first, [*first[:-1], "new"], [*first[1:], lex[59] if common else "new"]]
    filler = [[f"f{i}x{j}" for j in range(5)] + (lex if i % 20 == 0 else []) for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts + filler)], "doc_id long, text string")
    kept = imatch.lexicon(df)
    fp = imatch.with_fingerprint(df.filter("doc_id < 3"), df.text, "fp", kept)
    a, b, c = (r.fp for r in fp.orderBy("doc_id").select("fp").collect())
    share = lambda x, y: len(set(x.parts) & set(y.parts)) / len({p >> 56 for p in [*x.parts, *y.parts]})
    assert share(a, b) > 0.55 and share(a, c) > 0.5


def test_lexicon_holds_exactly_the_band(spark):
    data = [(i, " ".join(["all", *(f"half{i % 2}",), *([f"w{k}" for k in range(30) if i % (k + 2) == 0])])) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    n = {}
    for _, t in data:
        for w in t.split():
            n[w] = n.get(w, 0) + 1
    assert imatch.lexicon(df, band=(0.05, 0.2)) == sorted(signed(xx(w)) for w, k in n.items() if 20 <= k <= 80)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(120_000))), (2, "z" * 1_000_000), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    assert got[2].n_chars == 1_000_000 and got[1].near_edited < 1 and got[3].fingerprint == "-"
