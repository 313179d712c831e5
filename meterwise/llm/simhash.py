"""SimHash near-duplicates through deletion-variant signatures.

Fingerprint: bit i is 1 when it is set in more than half of the 64-bit hashes
of the text's word shingles, repeats included.

Linking at up to d differing bits: the fingerprint is cut into d // 2 + 1
segments, the fewest for which one segment differs in at most one bit.  Each
segment is indexed under its one-wildcard variants (one bit blanked), which are
equal for two fingerprints exactly when that segment differs in that bit at
most.  Rows meet by equality of (wildcard, value) and are verified by counting
the differing bits.

Equal fingerprints are one node, so exact copies never meet in pairs.  A bucket
is searched breadth first against what is still unvisited and gives a spanning
forest of its links, never all pairs.  Buckets that could hold more than
``bucket_rows`` fingerprints (found by counting exact segment values) are dealt
into chunks whose pairs are searched in different tasks, so no bucket has to
fit one task and no link is lost.

Defined cases: null and empty texts have no words and fingerprint 0; a text of
fewer words than a shingle is hashed as one sequence; null ids are carried and
never become a component's id unless all ids are null; repeated rows share a
fingerprint; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from meterwise.llm.common import batches_of, spare_name, staged, text_of
from meterwise.llm.components import components

BLOCK = 1 << 16
SMALL = 16


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = text.encode("utf-8").lower().split()  # bytes: lower-cases A-Z and splits at ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    n, ones, xxh = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        h = np.array([xxh(joined[s:e], seed) for s, e in zip(starts[lo:lo + BLOCK], ends[lo:lo + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, text_key, fp) of every row; text_key is a hash of the text that tells rows with equal ids apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, shingle, seed) for t in batches_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["id", "text_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), text_of(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, text_key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_masks(distance: int) -> list[int]:
    """The bits of each segment: distance // 2 + 1 runs of nearly equal width."""
    n = distance // 2 + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def _masked(masks: list[int]) -> Column:
    return F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])


def _forest(fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links within a bucket: each fingerprint is compared once with those not yet reached."""
    left, out = fp, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                got = left[near]
                out.append((np.full(len(got), x), got))
                queue.extend(got)
                left = left[~near]
    return out


def _links(distance: int, n_keys: int):
    """Rows (keys..., fp), sorted by the keys within a partition, to verified links (a, b)."""

    def one(keys: list[np.ndarray], fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        new = np.zeros(len(fp), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        group, sizes = np.cumsum(new) - 1, np.diff(np.append(starts, len(fp)))
        out = []
        small = sizes[group] <= SMALL
        f, g = fp[small], group[small]
        for k in range(1, SMALL):
            at = np.flatnonzero(g[k:] == g[:-k])
            if not len(at):
                break
            at = at[np.bitwise_count(f[at] ^ f[at + k]) <= distance]
            out.append((f[at], f[at + k]))
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            out += _forest(np.unique(fp[s:s + n]), distance)
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the bucket that the last batch broke off in

        def give(cols):
            for a, b in one(cols[:-1], cols[-1]):
                keep = a != b
                a, b = a[keep].view(np.int64), b[keep].view(np.int64)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[-1] = cols[-1].view(np.uint64)
            n = batch.num_rows
            same = np.ones(n, bool)
            for c in cols[:n_keys]:
                same &= c == c[-1]
            cut = int(n - np.argmin(same[::-1])) if not same.all() else 0  # where the last bucket begins
            if cut or (held and any(h[-1] != c[0] for h, c in zip(held[-1][:n_keys], cols))):
                done = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols])]
                if len(done[-1]):
                    yield from give(done)
                held = []
            held.append([c[cut:].copy() for c in cols])
        if held:
            yield from give([np.concatenate(x) for x in zip(*held)])

    return run


def links(fps: DataFrame, distance: int = 4, bucket_rows: int = 1 << 15) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs at up to ``distance`` bits."""
    masks = segment_masks(distance)
    wild = [m & ~(1 << i) for m in masks for i in range(64) if m >> i & 1]
    seg_of = [s for s, m in enumerate(masks) for i in range(64) if m >> i & 1]
    variants = fps.select("fp", F.posexplode(_masked(wild)).alias("j", "v"))
    # A bucket holds two exact segment values at most: a large one has a value with half of its rows.
    heavy = staged(fps.select(F.posexplode(_masked(masks)).alias("s", "value")).groupBy("s", "value").count()
                   .filter(F.col("count") > bucket_rows // 2), "heavy")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if heavy.isEmpty():
        keys, rows = ["j", "v"], variants
    else:
        which = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("s"), F.col("value").bitwiseAND(F.lit(_signed(m))).alias("v"))
                          for j, (s, m) in enumerate(zip(seg_of, wild))])
        hot = (heavy.select("s", "count", F.explode(F.filter(which, lambda x: x["s"] == F.col("s"))).alias("x"))
               .groupBy("x.j", "x.v").agg(F.ceil(F.sum("count") * 2 / bucket_rows).cast("int").alias("chunks")))
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                            lambda o: F.struct(F.least(F.col("own"), o).alias("p"), F.greatest(F.col("own"), o).alias("q")))
        rows = (variants.join(hot, ["j", "v"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
                .withColumn("own", own).select("j", "v", F.explode(pairs).alias("pq"), "fp").select("j", "v", "pq.p", "pq.q", "fp"))
        keys = ["j", "v", "p", "q"]
    rows = rows.select(*keys, "fp").repartition(n, *keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_links(distance, len(keys)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4,
                    seed: int = 42, bucket_rows: int = 1 << 15) -> DataFrame:
    """(id_col, text_key, fingerprint, component_id, keep_key): a row for each row of ``docs``.  The smallest
    (id, text_key) of a component is (component_id, keep_key)."""
    prints = staged(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")
    nodes = prints.groupBy("fp").agg(first)
    comps = components(links(prints.select("fp").distinct(), distance, bucket_rows))
    nodes = staged(nodes.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left")
                   .withColumn("comp", F.coalesce("comp", "fp")), "nodes")
    heads = nodes.groupBy("comp").agg(F.min("first").alias("head"))
    named = nodes.join(heads, "comp").select("fp", "head")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("head.id").alias("component_id"), F.col("head.text_key").alias("keep_key"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept."""
    found = near_duplicates(docs, id_col, text_col, **options)
    stay = found.filter(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("keep_key")))
    key, own = spare_name(docs.columns, "text_key"), spare_name(docs.columns, "id_")
    stay = stay.select(F.col(id_col).alias(f"{own}_"), F.col("text_key").alias(f"{key}_")).distinct()
    keyed = docs.select("*", F.xxhash64(F.col(f"`{text_col}`")).alias(key))
    kept = keyed.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{own}_")) & (F.col(key) == F.col(f"{key}_")), "left_semi")
    return kept.dropDuplicates([id_col, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
