import hashlib
import random

import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from meterwise.llm import byte_bpe, mixing, simhash
from meterwise.llm.common import table
from test_suffixes import brute
from tests_llm_edge import frame

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix_dedup", "mixing", "byte_bpe"]
    seen, held = [docs], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, SF).cache()
        assert held.columns == docs.columns and held.dtypes == docs.dtypes
        seen.append(held)
    raw, good, single, cut, mix = seen
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = set(ids(good))
    assert len([i for i, q in quality.items() if q == 1 and i in kept]) > 0.95 * sum(quality.values())
    heads = {r.component_id for r in simhash.near_duplicates(good).collect()}
    assert ids(single) == sorted(heads)
    assert ids(cut) == ids(single)
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    given = [(r.doc_id, r.text) for r in single.collect()]
    left = {r.doc_id: len(r.text.encode()) for r in cut.collect()}
    for (i, _), (n_bytes, n_removed, *_) in zip(given, brute([t for _, t in given], corpus_pipeline.PASSAGE_BYTES), strict=True):
        assert n_bytes - n_removed - 6 <= left[i] <= n_bytes - n_removed  # a cut can split a character at either end
    copies = {r.id: r.copies for r in mixing.mix(cut).collect()}
    assert ids(mix) == sorted(i for i, n in copies.items() for _ in range(n))
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.BYTE_BPE))
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, len(ref.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mix.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, mix, SF).collect()) == want


def test_passages_of_fifty_words_are_cut(spark):
    """Texts of their own words that share a passage of 50 words or more lose it and nothing else."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(n) for n in (50, 60, 90, 200)]
    data, want = [], {}
    for i in range(24):
        before, after = words(80) + " " + str(i), str(i) + " " + words(60)
        middle = passages[i % 4] if i < 16 else words(70)
        data.append((i, f"{before} {middle} {after}"))
        want[i] = len(before) + len(after) + (len(middle) if i >= 16 else 0)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    for i, t in left.items():
        assert abs(len(t) - want[i]) <= 4 and not any(p in t for p in passages)


def test_run_gives_rows_and_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op") and k[2].isdigit()}


def test_stages_on_edge_rows_and_nothing(spark):
    for data in (None, []):
        held = frame(spark, data)
        columns = held.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, SF)
            assert held.columns == columns
        out = corpus_pipeline.STAGES[-1][1](spark, held, SF)
        assert out.columns[0] == "doc_id" and (out.count() > 0) == (data is None)
