"""Token ids in flat binary files.

Documents are put in ascending id order (range partitioning, one shuffle of
the texts), encoded by the tokenizers library, and each partition writes two
flat files into the shared folder: the ids as unsigned little-endian integers
(16 bits while every id fits, else 32) and, per document, its 64-bit token
offset inside the partition; a small key file lists the documents' ids.  A partition's base is the prefix sum of the
token totals before it, so a document's global start is ``base + offset`` and
no task ever holds more than its own partition.  Readers map the files into
memory.

A few megabytes of texts at a time are cut into units (stretches of letters,
single digits, signs: ``common.units``) and dictionary-encoded in Arrow; each
different unit is encoded once per Python worker and remembered (a memo with a
fixed number of entries).  Units of proven characters go straight to the
library's merge model, all others, and whole texts with a special token's
string, through its whole encoder.

A task writes to a name of its own attempt and then renames, so a retried or
speculative task leaves the same committed files.

Defined cases: a null text is empty and holds only the end id; null ids come
first; rows with equal ids are ordered by text; an empty table writes no
files; only the named columns are read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from meterwise.llm.common import gathered, new_dir, portions, text_of, units
from meterwise.llm.token_counts import MEMO_ENTRIES, WORD_BPE, RunPieces

END_ID = 1
BATCH_BYTES = 1 << 23


class RunEncoder:
    """Texts to ids: the different units of the texts are encoded, the texts' ids gathered from them."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.pieces = RunPieces(self.tok)
        self.dtype = np.dtype(dtype)
        self.memo: dict[str, bytes] = {}

    def ids(self, run: str) -> list[int]:
        run = run.strip(" \t\n\r\x0b\x0c")
        if run.isascii() and run.isalpha():
            return [t.id for t in self.tok.model.tokenize(run.lower())]
        found = self.pieces.cut(run)
        if found is None:
            return self.tok.encode(run, add_special_tokens=False).ids
        merge, spelled = self.tok.model.tokenize, self.pieces.spelled
        return [t.id for p in found for t in merge(spelled(p))]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, each closed by ``end_id``, and each text's number of ids."""
        odd = np.zeros(len(texts), bool)
        for special in self.pieces.special:
            odd |= np.asarray(pc.match_substring(texts, special).cast(pa.uint8())).astype(bool)
        runs, n = units(pc.if_else(pa.array(odd), "", texts), single_digits=True, lower=True)
        words = runs.dictionary_encode()
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        memo, known = self.memo, []
        for r in words.dictionary.to_pylist():
            got = memo.get(r)
            if got is None:
                got = memo[r] = array(self.dtype.char, self.ids(r)).tobytes()
            known.append(got)
        at = np.asarray(words.indices, np.int64)
        if odd.any():  # the strings of special tokens are found in the whole text: it is encoded whole
            where = np.flatnonzero(odd)
            at = np.insert(at, (np.cumsum(n) - n)[where], len(known) + np.arange(len(where)))
            n[where] = 1
            known += [array(self.dtype.char, self.tok.encode(t, add_special_tokens=False).ids).tobytes() for t in texts.take(pa.array(where)).to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        store, end = np.frombuffer(b"".join(known), self.dtype), np.cumsum(size)
        total = np.diff(np.concatenate([[0], np.cumsum(size[at])])[np.concatenate([[0], np.cumsum(n)])]) + 1
        out = np.full(int(total.sum()), end_id, self.dtype)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(total) - 1] = False
        out[inner] = store[gathered((end - size)[at], end[at])]
        return out, total


_ENCODERS: dict[tuple[str, str], RunEncoder] = {}


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _commit(fs: pafs.FileSystem, folder: str, name: str, write) -> None:
    tc = TaskContext.get()
    own = f"{folder}/_tmp-{name}-{tc.taskAttemptId()}"
    with fs.open_output_stream(own) as f:
        write(f)
    fs.move(own, f"{folder}/{name}")


def _array(fs: pafs.FileSystem, path: str, dtype: np.dtype) -> np.ndarray:
    """The file as an array: mapped where the folder is mounted, else read whole (one partition's file)."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the files; returns the manifest (part, n_docs, n_tokens, base), also kept as ``manifest.json``."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(WORD_BPE)
    folder = folder or new_dir(spark, "token-files")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocab = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(vocab, end_id) <= 0xFFFF else "<u4"
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, dtype) not in _ENCODERS:
            _ENCODERS[path, dtype] = RunEncoder(path, dtype)
        encoder = _ENCODERS[path, dtype]
        tc = TaskContext.get()
        part, lens, n_docs = tc.partitionId(), [np.empty(0, np.int64)], 0
        fs, root = _filesystem(folder)
        own, ids = f"{root}/_tmp-{part:06d}.ids-{tc.taskAttemptId()}", None
        keys: list[int | None] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = ids or fs.open_output_stream(own)
            keys += b.column(0).to_pylist()
            for lo, hi in portions(np.asarray(pc.binary_length(b.column(1)), np.int64), BATCH_BYTES):
                coded, total = encoder.encode(b.column(1).slice(lo, hi - lo), end_id)
                ids.write(coded)
                lens.append(total)
            n_docs += b.num_rows
        if ids is None:
            return
        ids.close()
        fs.move(own, f"{root}/{part:06d}.ids")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype("<i8")
        _commit(fs, root, f"{part:06d}.offsets", lambda f: f.write(offsets.tobytes()))
        names = pa.table({"id": pa.array(keys, b.schema.field(0).type)})
        _commit(fs, root, f"{part:06d}.keys", lambda f: pq.write_table(names, f))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()),
                                          pa.array([int(offsets[-1])], pa.int64())], names=["part", "n_docs", "n_tokens"])

    # Rows of one id (or without one) can be many: their texts' first characters deal them out further.
    ordered = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
               .repartitionByRange(n, F.col("id"), F.substring("text", 1, 32)).sortWithinPartitions("id", "text"))
    parts = sorted(ordered.mapInArrow(write, "part int, n_docs long, n_tokens long").collect())  # a row a partition
    rows, base, first = [], 0, 0
    for p, d, t in parts:
        rows.append((p, d, t, base, first))
        base, first = base + t, first + d
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "folder": folder,
                            "parts": [dict(zip(("part", "n_docs", "n_tokens", "base", "first"), r)) for r in rows]}).encode())
    out = spark.createDataFrame(rows, "part int, n_docs long, n_tokens long, base long, first long")
    kind = docs.schema[id_col].dataType.simpleString()
    return out.withColumns({"folder": F.lit(folder), "dtype": F.lit(dtype), "id": F.lit(None).cast(kind)})


def read_token_files(manifest: DataFrame, what: str = "digest", id_col: str = "doc_id") -> DataFrame:
    """Per document, in file order: its id (of the type of the manifest's empty column ``id``), seq (its number), start,
    n_tokens and either the ids' crc32 as 32-bit little-endian integers (``digest``) or the ids themselves (``ids``)."""
    id_type = manifest.schema["id"].dataType.simpleString()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, root = _filesystem(r["folder"])
                ids = _array(fs, f"{root}/{r['part']:06d}.ids", np.dtype(r["dtype"]))
                off = _array(fs, f"{root}/{r['part']:06d}.offsets", np.dtype("<i8"))
                keys = pq.read_table(f"{root}/{r['part']:06d}.keys", filesystem=fs).column(0).combine_chunks()
                for lo in range(0, r["n_docs"], 4096):
                    hi = min(lo + 4096, r["n_docs"])
                    spans = [ids[off[i]:off[i + 1]] for i in range(lo, hi)]
                    last = (pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in spans], pa.int64()) if what == "digest"
                            else pa.array([s.astype(np.int64) for s in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(
                        [keys[lo:hi], pa.array(np.arange(lo, hi) + r["first"]), pa.array(off[lo:hi] + r["base"], pa.int64()),
                         pa.array(np.diff(off[lo:hi + 1]), pa.int64()), last],
                        names=["id", "seq", "start", "n_tokens", "ids_crc32" if what == "digest" else "ids"])

    last = "ids_crc32 long" if what == "digest" else "ids array<long>"
    n = max(1, manifest.count())
    out = manifest.drop("id").repartition(n, "part").mapInArrow(read, f"id {id_type}, seq long, start long, n_tokens long, {last}")
    return out.withColumnRenamed("id", id_col)
