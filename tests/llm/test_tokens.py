import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from meterwise.llm import byte_bpe, token_counts, token_files
from meterwise.llm.common import table
from tests_llm_edge import frame, rows, texts

PATH = public_tokenizers.path(token_counts.WORD_BPE)
POOL = [" ", "\n", "  ", "\t", "'s", "'re", "Σ", "İ", "é", "é", "\x1c", "\x85", "　", "a", "B", "1", "२", "!", "<|endoftext|>", "漢",
        "\U0001F600", "​", "ǅ", "ﬁ", "\x00", "͸", " x", "Foo", "K", "́", "가", "'", "ß", "ẞ"]


@pytest.fixture(scope="module")
def given():
    rnd = random.Random(1)
    mixed = ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(0, 40))) for _ in range(4000)]
    chars = [f"a{chr(c)}b {chr(c)}1" for c in range(0, 0x30000, 7) if not 0xD800 <= c <= 0xDFFF]
    return [t or "" for t in texts()] + mixed + chars


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, ts):
    return [e.ids for e in library.encode_batch(ts, add_special_tokens=False)]


def test_counts_and_ids_equal_the_library(given, library):
    want = ids(library, given)
    counter = token_counts.TokenCounter(PATH, token_counts.proven_whole_tokens(PATH))
    assert [counter.count(t) for t in given] == [len(w) for w in want]
    encoder = token_files.RunEncoder(PATH, "<u2")
    got, n = encoder.encode(pa.array(given), 1)
    assert n.tolist() == [len(w) + 1 for w in want]
    assert got.tolist() == [i for w in want for i in [*w, 1]]


def test_proven_tokens_are_single(library):
    whole = sorted(token_counts.proven_whole_tokens(PATH))
    assert len(whole) > 30000 and all(len(w) == 1 for w in ids(library, whole))


def test_count_query(spark, library):
    got = token_counts.token_counts(frame(spark), limit=100).collect()
    want = [(r[0], len((r[1] or "").encode()), len(w), len(w) > 100) for r, w in zip(rows(), ids(library, [r[1] or "" for r in rows()]))]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert token_counts.token_counts(frame(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_files_round_trip(spark, library, tmp_path, partitions):
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    manifest = token_files.write_token_files(frame(spark), folder=f"file://{tmp_path}/out", partitions=partitions)
    assert [r.part for r in manifest.orderBy("part").collect()] == sorted({r.part for r in manifest.collect()})
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.seq)
    full = sorted(token_files.read_token_files(manifest, "ids").collect(), key=lambda r: r.seq)
    start = 0
    for r, f, d, w in zip(got, full, data, ids(library, [d[1] or "" for d in data]), strict=True):
        w = w + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d[0], start, len(w), zlib.crc32(np.array(w, "<u4").tobytes()))
        assert f.ids == w
        start += len(w)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_tmp")]


def test_no_files_for_an_empty_table(spark, tmp_path):
    manifest = token_files.write_token_files(frame(spark, []), folder=str(tmp_path / "none"))
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.BYTE_BPE))


@pytest.fixture(scope="module")
def table_of(ranks):
    return byte_bpe.PerfectHash(ranks)


def test_perfect_hash_is_minimal_and_exact(ranks, table_of):
    assert len(table_of.slots) == len(ranks) and None not in table_of.slots
    assert all(table_of.get(k) == v for k, v in ranks.items())
    rnd = random.Random(2)
    other = [k for k in (rnd.randbytes(rnd.randrange(0, 9)) for _ in range(20000)) if k not in ranks]
    assert all(table_of.get(k) is None for k in other)


def test_encoding_equals_the_library(given, ranks, table_of):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBPE(ranks, table_of)
    for t in given:
        got = bpe.encode(t)
        assert got == ref.encode_ordinary(t)
        assert bpe.decode(got) == t.encode()


def test_units_put_together_equal_the_library(given, ranks, table_of):
    """Units, blanks and white space outside ASCII, several texts at a time."""
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(7)
    spaces = ["".join(rnd.choice([" ", "\n", "\t", "\r", "\x0b", "\u3000", "a", "b1", "é", "!", "\x1c"]) for _ in range(rnd.randrange(12))) for _ in range(4000)]
    bpe = byte_bpe.ByteBPE(ranks, table_of)
    for texts_ in (spaces, given, [], [""], ["", " ", ""]):
        known, at, n = bpe.units_of(pa.array(texts_, pa.string()))
        ends = np.cumsum(n).tolist()
        for t, lo, hi in zip(texts_, [0, *ends], ends):
            ids_ = [i for k in at[lo:hi] for i in known[k]]
            assert ids_ == ref.encode_ordinary(t), t
            assert bpe.decode(ids_) == t.encode()


def test_ids_are_gathered(spark, ranks):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = [(i, r[1]) for i, r in enumerate(rows())]
    got = byte_bpe.encode_documents(spark.createDataFrame(data, "doc_id long, text string"), returns="ids").collect()
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), data, strict=True):
        assert r.ids == ref.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()


def test_token_files_of_text_ids(spark, library, tmp_path):
    data = [(None, "b a"), (None, "a b"), ("x", "one"), ("x", "one"), ("a", None), ("é", "")]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    manifest = token_files.write_token_files(docs, folder=str(tmp_path / "named"), partitions=3)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.seq)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    assert [r.n_tokens for r in got] == [len(w) + 1 for w in ids(library, [r[1] or "" for r in order])]


def test_long_repeated_piece(ranks, table_of):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBPE(ranks, table_of)
    for t in ("a" * 30000, "ab" * 9000, "\n" * 5000 + "x", "é" * 4000):
        assert bpe.encode(t) == ref.encode_ordinary(t)


def test_encode_query(spark, ranks):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(w := ref.encode_ordinary(r[1] or "")), sha(",".join(map(str, w)).encode()), sha((r[1] or "").encode())) for r in rows()]
    assert sorted(map(str, (tuple(r) for r in byte_bpe.encode_documents(frame(spark)).collect()))) == sorted(map(str, want))
    assert byte_bpe.encode_documents(frame(spark, []), returns="ids").count() == 0


def test_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    data = docs.collect()
    assert got == {d.doc_id: len(w) for d, w in zip(data, ids(library, [d.text for d in data]))}
