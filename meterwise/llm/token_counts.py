"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone by the
tokenizers library; those that come back as exactly their own id are *proven*
whole tokens.  A text's pre-tokens found in the proven table count one each,
without running the merges; only the rest is merged, by the library's model.

White space never takes part in a pre-token of this vocabulary's pattern, so a
text is first cut at white space and each distinct run is costed once per
Python worker (a memo with a fixed number of entries).

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
and repeated or null ids are counted row by row; very long texts are counted
whole; an empty table gives no rows; only the named id and text columns are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from meterwise.llm.common import batches_of, chunks, text_of

WORD_BPE = "word_bpe_49k.json"
END_OF_WORD = "</w>"
#: The tokenizer file's own split pattern (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MEMO_ENTRIES = 1 << 19


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in own)
    spare = {b: 256 + i for i, b in enumerate(others)}
    return [chr(spare.get(b, b)) for b in range(256)]


def proven_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the library encodes alone as their single id and
    that its normalizer and pattern leave in one piece."""
    tok = Tokenizer.from_file(path)
    to_byte = {c: b for b, c in enumerate(byte_alphabet())}
    pattern = regex.compile(PIECES)
    found, ids = [], []
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        body = piece.removesuffix(END_OF_WORD)
        if body == piece or not all(c in to_byte for c in body):
            continue
        try:
            text = bytes(to_byte[c] for c in body).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(text) and pattern.findall(text) == [text]:
            found.append(text)
            ids.append(i)
    codes = tok.encode_batch_fast(found, add_special_tokens=False)
    normal = tok.normalizer.normalize_str
    return frozenset(t for t, i, e in zip(found, ids, codes) if e.ids == [i] and normal(t) == t)


class RunPieces:
    """Cuts a run without white space into the library's pre-tokens, spelled in its byte alphabet.

    Characters below U+0250 never compose with each other; those that the library only lower-cases, as Python does,
    are proven one by one, and a run of them needs no call of the library's normalizer."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.pattern = regex.compile(PIECES)
        self.alphabet = byte_alphabet()
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.proven_chars: dict[str, bool] = {}
        normal = tok.normalizer.normalize_str
        self.plain = {c for c in map(chr, range(0x250)) if normal(c) == c.lower() and self.known(c)}

    def known(self, c: str) -> bool:
        """Whether the pattern module and the library class this character alike."""
        if c not in self.proven_chars:
            probe = self.tok.normalizer.normalize_str(f"a{c}1")
            theirs = self.tok.pre_tokenizer.pre_tokenize_str(probe)
            self.proven_chars[c] = [self.spelled(p) for p in self.pattern.findall(probe)] == [p for p, _ in theirs]
        return self.proven_chars[c]

    def spelled(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        return "".join(self.alphabet[b] for b in piece.encode("utf-8"))

    def cut(self, run: str) -> list[str] | None:
        """The normalized pre-tokens, or None where only the library is known to be right."""
        if any(s in run for s in self.special):
            return None
        if self.plain.issuperset(run):
            return self.pattern.findall(run.lower())
        if not all(map(self.known, run)):
            return None
        return self.pattern.findall(self.tok.normalizer.normalize_str(run))


class TokenCounter:
    """Counts the tokens of texts; ``costs`` remembers what a run costs."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok = Tokenizer.from_file(path)
        self.whole = whole
        self.pieces = RunPieces(self.tok)
        self.costs: dict[str, int] = {}

    def cost(self, run: str) -> int:
        found = self.pieces.cut(run)
        if found is None:
            return len(self.tok.encode(run, add_special_tokens=False).ids)
        whole, merge, spelled = self.whole, self.tok.model.tokenize, self.pieces.spelled
        return sum(1 if p in whole else len(merge(spelled(p))) for p in found)

    def count(self, text: str) -> int:
        runs, costs = chunks(text), self.costs
        try:
            return sum(map(costs.__getitem__, runs))
        except KeyError:
            pass
        if len(costs) > MEMO_ENTRIES:
            costs.clear()
        for r in set(runs).difference(costs):
            costs[r] = self.cost(r)
        return sum(map(costs.__getitem__, runs))


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Rows of (``id_col``, n_bytes, n_tokens, over_limit), one for each row of ``docs``."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(WORD_BPE)
    whole = spark.sparkContext.broadcast(proven_whole_tokens(path))  # at most the vocabulary

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path, whole.value)
        counter = _COUNTERS[path]
        for b in batches:
            n = [counter.count(t) for t in batches_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
                      text_of(text_col).alias("text"))
    out = src.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
