"""License scans by diagonal voting.

Every text is cut into words; the hash of each pair of neighbouring words (a
rolling word k-gram, k = 2, the length of the shortest phrase) is joined with
the positions of the same pair in the license templates.  A hit at word ``pos``
of the text and ``tpos`` of the template votes for the diagonal pos - tpos.  A
template that stands unbroken collects all its pairs on one diagonal; an
inserted or missing word moves the rest to a diagonal nearby, so neighbouring
diagonals whose spans touch are merged before a span is verified: the words of
the pairs are compared themselves, and enough different template pairs must
have been seen within a stretch of the run not much longer than the template.

Two kinds of template: *phrases* count only as an unbroken place (all pairs on
one diagonal); *notices* are longer wordings with labels of their own, accepted
from ``COVERAGE`` of their pairs on if the last pair (the version) is there.

DataFrame functions only.  The template table is a constant of this module, so
its broadcast has a fixed size; the texts themselves are never shuffled.

Defined cases: null and empty texts have no words and no labels; repeated rows
get the same result each; null ids are carried; texts are scanned whole; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meterwise.llm.common import staged, text_of

#: Phrases and their labels (fixed values).
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Common wordings of license notices, and the label each gives.
NOTICES = [
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
]
COVERAGE = 0.8
NEAR = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text_col: str = "text") -> Column:
    """Words of the text with A-Z in lower case.  The Kelvin sign is the one other character
    whose lower case is an ASCII letter, so it is put aside first."""
    plain = F.lower(F.replace(text_of(text_col), F.lit("K"), F.lit("ĸ")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _templates() -> list[tuple[str, list[str], str]]:
    return [("phrase", p.split(), label) for p, label in PHRASES] + [("notice", p.split(), label) for p, label in NOTICES]


def template_table(spark: SparkSession) -> DataFrame:
    """(t, kind, label, n_pairs): a row for each template."""
    rows = [f"({t}, '{kind}', '{label}', {len(w) - 1})" for t, (kind, w, label) in enumerate(_templates())]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v(t, kind, label, n_pairs)")


def pair_table(spark: SparkSession) -> DataFrame:
    """(x, y, at): a row for each different pair of neighbouring words in the templates, with its places (t, tpos)."""
    places: dict[tuple[str, str], list[str]] = {}
    for t, (_, w, _) in enumerate(_templates()):
        for i in range(len(w) - 1):
            places.setdefault((w[i], w[i + 1]), []).append(f"named_struct('t', {t}, 'tpos', {i})")
    rows = [f"('{x}', '{y}', array({', '.join(at)}))" for (x, y), at in places.items()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v(x, y, at)")


def pair_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_words, n_rows, hits): one row for all rows with this id and text.  ``hits``: (pos, at) of every
    word pair that stands in a template.

    The texts are cut into words once.  A document's first pair goes along whether it is a hit or not: it carries the
    number of words, so that only these and the hits are shuffled."""
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), words_of(text_col).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))
    grams = cut.select("id", "text_key", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "g"))
    grams = grams.select("id", "text_key", "n_words", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.xxhash64("g.a", "g.b").alias("h"))
    known = pair_table(docs.sparkSession).withColumn("k", F.xxhash64("x", "y"))
    same = (F.col("h") == F.col("k")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))
    first = F.coalesce("pos", F.lit(0)) == 0
    found = grams.join(F.broadcast(known), same, "left").filter(first | F.col("at").isNotNull())
    return found.groupBy("id", "text_key").agg(F.max("n_words").alias("n_words"), F.count_if(first).alias("n_rows"),
                                               F.collect_set(F.when(F.col("at").isNotNull(), F.struct("pos", "at"))).alias("hits"))


def votes(found: DataFrame) -> DataFrame:
    """(id, text_key, t, kind, label, n_pairs, diagonal, places): the hits (pos, tpos) on each diagonal."""
    at = found.select("id", "text_key", F.explode("hits").alias("hit")).select("id", "text_key", "hit.pos", F.explode("hit.at").alias("at"))
    at = at.select("id", "text_key", "at.t", "at.tpos", "pos").join(F.broadcast(template_table(found.sparkSession)), "t")
    at = at.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    return at.groupBy("id", "text_key", "t", "kind", "label", "n_pairs", "diagonal").agg(F.collect_set(F.struct("pos", "tpos")).alias("places"))


def spans(diagonals: DataFrame) -> DataFrame:
    """Neighbouring diagonals whose hits touch, merged, and the best stretch of each merged run verified:
    (id, text_key, label, coverage, whole).

    A stretch is as long as the template and 2 * NEAR words more; from every hit of the run one begins.  ``coverage``: the
    largest share of the template's pairs in a stretch.  ``whole``: a stretch covers enough and has the last pair."""
    run_of = ["id", "text_key", "t"]
    order = Window.partitionBy(*run_of).orderBy("diagonal")
    ends = diagonals.withColumns({"first": F.array_min("places.pos"), "last": F.array_max("places.pos")})
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR) | (F.col("first") > F.lag("last").over(order) + NEAR + 1)
    marked = ends.withColumn("run", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(order))
    each = marked.select(*run_of, "label", "n_pairs", "run", F.inline("places"))
    longest = max(len(w) - 1 for _, w, _ in _templates()) + 2 * NEAR
    ahead = Window.partitionBy(*run_of, "run").orderBy("pos").rangeBetween(0, longest)
    near = F.filter(F.collect_list(F.struct("pos", "tpos")).over(ahead), lambda x: x["pos"] <= F.col("pos") + F.col("n_pairs") + 2 * NEAR)
    seen = each.withColumn("seen", F.array_distinct(F.transform(near, lambda x: x["tpos"])))
    share = F.size("seen") / F.col("n_pairs")
    return (seen.groupBy(*run_of, "label", "run").agg(F.max(share).alias("coverage"), F.max((share >= COVERAGE) & F.array_contains("seen", F.col("n_pairs") - 1)).alias("whole"))
            .select("id", "text_key", "label", "coverage", "whole"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``."""
    found = staged(pair_hits(docs, id_col, text_col), "license-hits")
    on = votes(found.filter(F.size("hits") > 0))
    # An unbroken phrase is a full diagonal; a phrase votes with nothing less.
    places = on.filter((F.col("kind") == "phrase") & (F.size(F.array_distinct("places.tpos")) == F.col("n_pairs"))).select(
        "id", "text_key", F.lit(True).alias("base"), "label", F.col("diagonal").alias("at"), F.lit(1.0).alias("score"))
    noted = spans(on.filter("kind = 'notice'")).select(
        "id", "text_key", F.lit(False).alias("base"), F.when(F.col("whole"), F.col("label")).alias("label"),
        F.lit(None).cast("int").alias("at"), F.col("coverage").alias("score"))
    per = places.unionAll(noted).groupBy(F.col("id").alias("hid"), F.col("text_key").alias("hkey")).agg(
        F.count_if("base").alias("n_base"), F.min("at").cast("long").alias("first_word"), F.max("at").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"))
    out = found.drop("hits").join(per, F.col("id").eqNullSafe(F.col("hid")) & (F.col("text_key") == F.col("hkey")), "left")
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))


def _template_rows() -> str:
    return ", ".join(f"({t}, '{kind}', '{label}', {len(w) - 1}, {i}, '{w[i]}', '{w[i + 1]}')"
                     for t, (kind, w, label) in enumerate(_templates()) for i in range(len(w) - 1))


#: The same result in SQL (documents have unique ids there).
SCAN_SQL = rf"""
WITH tpl(t, kind, label, n_pairs, tpos, x, y) AS (VALUES {_template_rows()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
hits AS (SELECT doc_id, t, kind, label, n_pairs, pos - tpos AS diagonal, tpos, pos FROM g JOIN tpl ON a = x AND b = y),
votes AS (SELECT doc_id, t, kind, label, n_pairs, diagonal, count(DISTINCT tpos) AS n_seen, min(pos) AS first, max(pos) AS last
          FROM hits GROUP BY ALL),
base AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
         FROM votes WHERE kind = 'phrase' AND n_seen = n_pairs GROUP BY doc_id),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {NEAR} OR first > lag(last) OVER o + {NEAR + 1} OR lag(last) OVER o IS NULL
                          THEN 1 ELSE 0 END AS starts
           FROM votes WHERE kind = 'notice' WINDOW o AS (PARTITION BY doc_id, t ORDER BY diagonal)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS run FROM marked),
own AS (SELECT DISTINCT r.doc_id, r.t, r.label, r.n_pairs, r.run, h.pos, h.tpos FROM runs r JOIN hits h USING (doc_id, t, diagonal)),
stretch AS (SELECT a.doc_id, a.t, a.label, a.n_pairs, a.run, a.pos, a.tpos, count(DISTINCT b.tpos) / a.n_pairs AS coverage, max(b.tpos) = a.n_pairs - 1 AS ends
            FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.t = b.t AND a.run = b.run AND b.pos BETWEEN a.pos AND a.pos + a.n_pairs + {2 * NEAR}
            GROUP BY a.doc_id, a.t, a.label, a.n_pairs, a.run, a.pos, a.tpos),
cover AS (SELECT doc_id, label, coverage, ends FROM stretch),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
           FROM (SELECT doc_id, label FROM votes WHERE kind = 'phrase' AND n_seen = n_pairs
                 UNION ALL SELECT doc_id, label FROM cover WHERE coverage >= {COVERAGE} AND ends) GROUP BY doc_id),
best AS (SELECT doc_id, max(coverage) AS coverage FROM cover GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(CAST(coverage AS DOUBLE), 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""
