"""I-Match document fingerprints.

Terms are the distinct lower-case words of a text.  A lexicon keeps those whose
document frequency lies within a chosen band of inverse document frequency: very
common terms say little, very rare ones are often damage.  Frequencies are
counted by term (its 64-bit hash) over all documents; a term of the lexicon
stands in ``BAND[0]`` of all documents at least, so the lexicon has at most (mean
number of distinct terms a document) / ``BAND[0]`` terms, whatever the corpus holds.

A text's terms within the lexicon are used, and where they are fewer than
``FEW``, as many others, those of smallest hash, as are missing.  A text
that changes by one term thus changes by one or two of its used terms, however
many the lexicon holds of them.

The used terms are hashed for several randomised, overlapping sub-lexicons: four
that leave out a quarter of the terms each, eight of an eighth (``FAMILIES``) and
``FINE`` of a 128th.  The large ones tell whether texts are
practically the same, the small ones how much of them is.  Every term falls in
five, so every term used counts.  A text's sorted terms in a sub-lexicon are
hashed to one value, with the number of the sub-lexicon in its upper bits; the
fingerprint is the list of values.  The likeness of two fingerprints is the
share of equal values among the sub-lexicons that either text has terms of.

The *next* document is found without a global window: ids are range
partitioned, neighbours are read inside a partition, and the first id of each
partition closes the gap to the one before it.

DataFrame functions only.

Defined cases: a null text is empty; texts without any term share one
fingerprint (likeness 1); null ids come first; rows that agree in id and text
are one document in the order and all get its result; rows with equal ids and
different texts are ordered by a hash of the text; the only document is its own
next; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterwise.llm.common import staged, text_of

#: Document frequency, as a share of all documents, that a lexicon term has at least and at most.
BAND = (0.005, 0.1)
PART_BITS = 8
FEW = 32
#: (number of classes, whether a sub-lexicon holds one class or all but one): the terms' hashes are dealt into classes anew for each family.
FAMILIES = ((4, False), (8, True))
#: Classes of the last family, each a sub-lexicon: few terms each, so that a sorted list of all terms is cut into them.
FINE = 128
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The hashes of the distinct lower-case words of a text, sorted."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    return F.array_sort(F.transform(found, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> list[int]:
    """The hashes of the terms whose document frequency lies within the band, sorted."""
    n = docs.count()
    df = docs.select(F.explode(terms(text_of(text_col))).alias("t")).groupBy("t").count()
    kept = df.filter(F.col("count").between(band[0] * n, band[1] * n))
    return sorted(r["t"] for r in kept.select("t").collect())  # bounded by the band


def part_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - PART_BITS)


def ranked_terms(text: Column, kept: list[int]) -> Column:
    """(other, h) of the terms: those of the lexicon first, both kinds by hash."""
    known = (lambda t: t.isin(kept)) if kept else (lambda t: F.lit(False))
    return F.array_sort(F.transform(terms(text), lambda t: F.struct((~known(t)).alias("other"), t.alias("h"))))


def used_terms(ranked: Column) -> Column:
    """The terms that make the fingerprint: those of the lexicon, and others of smallest hash if they are few."""
    inside = F.size(F.filter(ranked, lambda x: ~x["other"]))
    return F.transform(F.slice(ranked, F.lit(1), F.greatest(inside, F.lit(FEW))), lambda x: x["h"])


_LOW = (1 << 64 - PART_BITS) - 1


def _numbered(h: Column, number: int | Column) -> Column:
    return h.bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft(F.lit(number).cast("long") if isinstance(number, int) else number, 64 - PART_BITS))


def coarse_values(hashes: Column) -> list[Column]:
    """A value for each sub-lexicon of the families, null where it holds no term of ``hashes``."""

    def held(shift: int, classes: int, k: int, one: bool) -> Column:
        own = lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(classes - 1))
        return F.filter(hashes, lambda h: (own(h) == k) if one else (own(h) != k))

    out, shift = [], 0
    for classes, one in FAMILIES:
        for k in range(classes):
            terms_ = held(shift, classes, k, one)
            out.append(F.when(F.size(terms_) > 0, _numbered(F.xxhash64(terms_), len(out))))
        shift += classes.bit_length()
    return out


def classed(hashes: Column) -> Column:
    """The hashes under the numbers of their classes in the last family, sorted."""
    shift, first = sum(c.bit_length() for c, _ in FAMILIES), sum(c for c, _ in FAMILIES)
    return F.array_sort(F.transform(hashes, lambda h: _numbered(h, F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(FINE - 1)) + first)))


def fine_values(u: Column) -> Column:
    """One value for each class in ``u`` (a column: it is read again for each term): its terms are written side by side, ';' between classes."""
    border = lambda h, i: F.when(i == 0, "").when(part_of(h) == part_of(F.get(u, i - 1)), ",").otherwise(";")
    joined = F.array_join(F.transform(u, lambda h, i: F.concat(border(h, i), h.cast("string"))), "")
    number = lambda g: part_of(F.substring_index(g, ",", 1).cast("long"))
    return F.transform(F.split(joined, ";"), lambda g: _numbered(F.xxhash64(g), number(g)))


def with_fingerprint(df: DataFrame, text: Column, name: str, kept: list[int]) -> DataFrame:
    """``df`` with the column ``name``: struct(whole, parts).  ``whole`` hashes all terms used; ``parts`` are the values."""
    # What is used more than once is a column of its own, so that it is computed once.
    df = df.withColumn("r", ranked_terms(text, kept))
    # Hashed again: the classes do not follow the hashes by which terms were chosen.
    df = df.withColumn("e", F.array_sort(F.transform(used_terms(F.col("r")), lambda t: F.xxhash64(t))))
    df = df.withColumn("u", classed(F.col("e")))
    coarse = F.filter(F.array(*coarse_values(F.col("e"))), lambda v: v.isNotNull())
    parts = F.when(F.size("e") > 0, F.concat(coarse, fine_values(F.col("u")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.struct(F.xxhash64("e").alias("whole"), parts.alias("parts"))).drop("r", "e", "u")


def shown(fp: Column) -> Column:
    """A fingerprint as text: its values in hexadecimal, '-' for a text without any term."""
    return F.when(F.size(fp["parts"]) > 0, F.array_join(F.transform(fp["parts"], lambda p: F.lower(F.hex(p))), ".")).otherwise("-")


def likeness(a: Column, b: Column) -> Column:
    numbers = [F.transform(x["parts"], part_of) for x in (a, b)]
    share = F.size(F.array_intersect(a["parts"], b["parts"])) / F.size(F.array_union(*numbers))
    return F.when(a["whole"] == b["whole"], F.lit(1.0)).otherwise(share)


def key_of(id_col: str, text_col: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(text_col)))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, n_chars, next_key) of every distinct document, in ascending id order, the first after the last."""
    spark = docs.sparkSession
    keys = docs.select(key_of(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"),
                       F.char_length(text_of(text_col)).cast("long").alias("n_chars"))
    keys = staged(keys.groupBy("key").agg(F.min("id").alias("id"), F.min("h").alias("h"), F.min("n_chars").alias("n_chars")), "keys")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(keys.repartitionByRange(n, F.col("id").asc_nulls_first(), "h").withColumn("part", F.spark_partition_id()), "ranges")
    order = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "h")
    inside = parts.withColumn("next_key", F.lead("key").over(order))
    place = F.struct(F.col("id").isNotNull().alias("some"), "id", "h", "key")
    firsts = parts.groupBy("part").agg(F.min(place).alias("first"))
    row = Window.orderBy("part")  # a row for each range partition
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(row), F.first("first").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))["key"].alias("over"))
    return inside.join(firsts, "part").select("key", "id", "n_chars", F.coalesce("next_key", "over").alias("next_key"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The edited text has its last n_chars // 4 code points replaced by the first as many of the next document."""
    kept = lexicon(docs, text_col, band)
    order = staged(successors(docs, id_col, text_col), "order")
    after = order.select(F.col("next_key").alias("key"), F.col("key").alias("prev_key"), (F.col("n_chars") / 4).cast("long").cast("int").alias("cut"))
    # Lender and borrower read the same columns, so that texts and their fingerprints are made and shuffled once (the exchange is reused).
    held = docs.select(key_of(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    held = with_fingerprint(held, F.col("text"), "fp", kept)
    given = held.join(after, "key").groupBy(F.col("prev_key").alias("key")).agg(
        F.min(F.substring("text", F.lit(1), F.col("cut"))).alias("lent"), F.min("fp").alias("nfp"))
    both = held.join(order, "key").join(given, "key")
    stays = (F.col("n_chars") - (F.col("n_chars") / 4).cast("long")).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), stays), F.col("lent")))
    both = with_fingerprint(both, F.col("edited"), "efp", kept)
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"))
