"""Helpers shared by the corpus operators: table access, the shared staging
folder, row keys and Arrow batch mapping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees.  The session's ``spark.checkpoint.dir``
    wins, then a folder set with ``setCheckpointDir``; a scratch folder is made
    only for a local master, where driver and executors are one process."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = held.get() if held.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="meterwise-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the copy:
    cuts the lineage, survives lost executors, is read column by column."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id is fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(0))


#: Python counts these as white space, the tokenizers' patterns do not.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_CHUNK = re.compile(r"(?:\S|[\x1c-\x1f])+")


def chunks(text: str) -> list[str]:
    """The runs of the text without Unicode white space."""
    if any(c in text for c in _NOT_SPACE):
        return _CHUNK.findall(text)
    return text.split()


def flat(parts) -> Iterator:
    return chain.from_iterable(parts)


def batches_of(batch: pa.RecordBatch, col: str) -> list:
    return batch.column(batch.schema.get_field_index(col)).to_pylist()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (cut at ASCII white space, nulls have none), one text after the other, and each text's number of words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = parts.flatten(), np.asarray(parts.offsets, np.int64)
    kept = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(np.asarray(kept))])
    return flat.filter(kept), np.diff(upto[ends - ends[0]])


def portions(size: np.ndarray, most: int, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Neighbouring rows (lo, hi) whose sizes sum to at most ``most`` (one larger row stands alone), at most ``rows`` of them."""
    lo, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > lo and (total + n > most or i - lo >= rows):
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(size):
        yield lo, len(size)


#: White space outside ASCII (fixed values: the characters with the Unicode property White_Space).
FURTHER_SPACES = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPACE, _LETTER, _DIGIT, _APOSTROPHE, _SIGN, _FURTHER = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    out[_IS_SPACE] = _SPACE
    out[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
    out[[b for b in range(128) if chr(b).isdigit()]] = _DIGIT
    out[ord("'")] = _APOSTROPHE
    out[128:] = _FURTHER
    return out


def _cuts(single_digits: bool) -> np.ndarray:
    """By the classes of two neighbouring bytes: whether pre-tokens always end between them.  Not known next to bytes outside
    ASCII, nor after an apostrophe, which may take letters with it."""
    out = np.zeros((6, 6), bool)
    out[_LETTER, [_DIGIT, _APOSTROPHE, _SIGN]] = True
    out[_DIGIT, [_LETTER, _APOSTROPHE, _SIGN]] = True
    out[_SIGN, [_LETTER, _DIGIT]] = True
    out[_APOSTROPHE, _DIGIT] = True
    out[_DIGIT, _DIGIT] = single_digits
    return out.ravel()


_CLASS = _classes()
_LOWER = bytes(range(256)).lower()


def units(texts: pa.Array, single_digits: bool = False, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The texts (without nulls and FURTHER_SPACES) cut into units, one text after the other, and each text's number of units.

    A unit is a stretch of ASCII letters, digits or signs, or of anything with bytes outside ASCII, together with one
    blank right before it, or what is left of a run of white space; if the last character of such a run is no blank and
    a word follows, it is a unit of its own.  No pre-token reaches over two units.  ``lower``: ASCII letters in lower case."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, offsets, buffer = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = buffer.to_pybytes()[:off[-1]] if buffer is not None else b""
    if lower:
        raw = raw.translate(_LOWER)
    data = np.frombuffer(raw, np.uint8)
    kind = _CLASS[data]
    space = kind == _SPACE
    start = np.zeros(len(data) + 1, bool)
    first = off[:-1][np.diff(off) > 0]
    start[1:-1] = _cuts(single_digits)[kind[:-1] * 6 + kind[1:]] if len(data) else False
    start[first] = True
    after = np.zeros(len(data), bool)  # the character before stands in the same text and is white space
    after[1:] = space[:-1]
    after[first] = False
    start[:-1] |= space & ~after
    word = np.flatnonzero(after & ~space)
    start[word - 1] = True
    start[word[data[word - 1] != 32]] = True
    at = np.flatnonzero(start[:-1])
    ends = np.append(at, len(data)).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(raw))
    return flat, np.diff(np.searchsorted(at, off))


def gathered(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one range after the other."""
    size = hi - lo
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)


def spare_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name += "_"
    return name
