"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: its weight's share of all words, at
most ``most`` times what the source holds; what is cut off is shared again by
weight until no target exceeds its limit.  (The result is the water level L at
which the targets ``least(limit, L * weight)`` add up to the whole, so it is
read off sorted prefix sums of the sources.)

A document of a source with target t and size s is taken t / s times: the whole
part always, the fractional part by rounding.  Two documents with fractional
parts p and q and sizes a and b pass words between them, in a random direction
that keeps each one's expectation, until one of the fractions is 0 or 1; a*p +
b*q does not change.  That one is decided, the other goes on to the next
pairing.  Documents are dealt by hash into small groups, each group leaves one
document undecided, and these residuals meet in groups again: a tree whose
levels are one small shuffle each.  In a source's last group the last document
goes to the nearer side, and the group's others make up for what is left over.

DataFrame functions only.  Randomness is a hash of the ids and texts, so reruns
and retried tasks agree whatever the partitioning.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own, last in order; repeated rows are numbered and
rounded one by one; null ids are allowed; the sources (not the documents) are
ordered in one task; an empty table gives no rows; only the named columns are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterwise.llm.common import spare_name, staged, text_of

WORD = r"[^\x20\x09-\x0D]+"
FAN = 32
SMALL = 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, n, target) from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit") / F.col("weight"))
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (whole - before) / rest)
    # From the first source on whose limit lies above the level, nothing is cut off any more.
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())
    level = found["level"]
    per = per.withColumn("target", F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", level * F.col("weight"))))
    return per.select("source", "source_size", "n", "target")


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _pair(acc: Column, x: Column) -> Column:
    """Let the undecided unit of ``acc`` meet ``x``."""
    a, b = acc["unit"], x
    a_free, b_free = a["size"] * (1 - a["p"]), b["size"] * (1 - b["p"])
    a_held, b_held = a["size"] * a["p"], b["size"] * b["p"]
    gain, loss = F.least(a_free, b_held), F.least(a_held, b_free)
    grows = _uniform(a["h"], b["h"]) * (gain + loss) < loss
    p_of = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    unit = lambda u, p: F.struct(u["h"].alias("h"), u["id"].alias("id"), u["size"].alias("size"), p_of(p).alias("p"))
    ended = lambda u, x: F.struct(u["h"].alias("h"), u["id"].alias("id"), u["size"].alias("size"), F.lit(x).alias("x"))
    step = lambda done, kept: F.struct(kept.alias("unit"), F.concat(acc["done"], F.array(done)).alias("done"))
    return (F.when(grows & (a_free <= b_held), step(ended(a, 1), unit(b, b["p"] - gain / b["size"])))
            .when(grows, step(ended(b, 0), unit(a, a["p"] + gain / a["size"])))
            .when(a_held <= b_free, step(ended(a, 0), unit(b, b["p"] + loss / b["size"])))
            .otherwise(step(ended(b, 1), unit(a, a["p"] - loss / a["size"]))))


def _closed(r: Column) -> Column:
    """The last group of a source: its last unit goes to the nearer side, and what that leaves over or short is made up for by
    the group's other units, larger ones first: each changes sides if the source's words come nearer to the target."""
    last = F.struct(r["unit"]["h"].alias("h"), r["unit"]["id"].alias("id"), r["unit"]["size"].alias("size"), (r["unit"]["p"] >= 0.5).cast("int").alias("x"))
    short = r["unit"]["size"] * (r["unit"]["p"] - last["x"])
    by_size = F.reverse(F.array_sort(F.transform(r["done"], lambda d: F.struct(d["size"].alias("size"), d["h"].alias("h"), d["id"].alias("id"), d["x"].alias("x")))))
    unit = lambda d, x: F.struct(d["h"].alias("h"), d["id"].alias("id"), d["size"].alias("size"), x.alias("x"))

    def turn(acc: Column, d: Column) -> Column:
        left = acc["short"] - d["size"] * (1 - 2 * d["x"])
        better = F.abs(left) < F.abs(acc["short"])
        return F.struct(F.when(better, left).otherwise(acc["short"]).alias("short"),
                        F.concat(acc["done"], F.array(unit(d, F.when(better, 1 - d["x"]).otherwise(d["x"])))).alias("done"))

    return F.aggregate(by_size, F.struct(short.alias("short"), F.array(last).alias("done")), turn)["done"]


def rounded(units: DataFrame, largest: int, fan: int = FAN) -> DataFrame:
    """Decide every unit (source, n, h, id, size, p): (source, h, id, x) with x 0 or 1.  ``largest``: the most units of a source."""
    # A source of few documents is one group, so that all of them can make up for its last one.
    buckets = F.when(F.col("n") <= SMALL * fan, F.lit(1)).otherwise(F.ceil(F.col("n") / fan)).cast("long")
    units = units.select("source", F.pmod("h", buckets).alias("node"), buckets.alias("nodes"), F.struct("h", "id", "size", "p").alias("unit"))
    decided, left = [], -(-largest // fan)
    while True:
        groups = units.groupBy("source", "node", "nodes").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        start = F.struct(F.col("units")[0].alias("unit"), F.array().cast("array<struct<h:bigint,id:" + units.schema["unit"].dataType["id"].dataType.simpleString() + ",size:double,x:int>>").alias("done"))
        groups = staged(groups.select("source", "node", "nodes", F.aggregate(F.slice("units", 2, F.greatest(F.size("units"), F.lit(1))), start, _pair).alias("r")), "rounding")
        done = F.when(F.col("nodes") == 1, _closed(F.col("r"))).otherwise(F.col("r.done"))
        decided.append(groups.select("source", F.explode(done).alias("d")).select("source", "d.h", "d.id", "d.x"))
        if left <= 1:
            break
        units = groups.filter("nodes > 1").select("source", F.floor(F.col("node") / fan).alias("node"), F.ceil(F.col("nodes") / fan).alias("nodes"), "r.unit")
        left = -(-left // fan)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionAll(d)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1),
        share: float = 1.0, most: float = 3.0, seed: int = 17, fan: int = FAN) -> DataFrame:
    """(id, text_key, copy, size, source, source_size, target, copies, taken): a row for each row of ``docs``; ``copy`` numbers
    the rows that agree in id, text and source."""
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_key"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    base = base.withColumn("copy", F.row_number().over(Window.partitionBy("id", "text_key", "source").orderBy("size")))
    base = staged(base.withColumn("h", F.xxhash64(F.lit(seed), "id", "text_key", "source", "copy")), "sizes")
    per = staged(targets(base, weights, share, most), "targets")
    per = per.withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = per.withColumn("whole", F.floor("times").cast("int")).withColumn("p", F.col("times") - F.col("whole"))
    largest = per.agg(F.max("n")).first()[0] or 0
    rates = per.withColumnRenamed("source", "s")
    joined = base.join(rates, base["source"].eqNullSafe(rates["s"])).drop("s")
    units = joined.filter((F.col("size") > 0) & (F.col("p") > 0)).select("source", "n", "h", "id", F.col("size").cast("double").alias("size"), "p")
    picks = rounded(units, largest, fan).select(F.col("h").alias("ph"), F.col("id").alias("pid"), "x")
    out = joined.join(picks, (F.col("h") == F.col("ph")) & F.col("id").eqNullSafe(F.col("pid")), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("x", F.lit(0))).otherwise(F.lit(0))
    return out.withColumn("copies", copies).select("id", "text_key", "copy", "size", "source", "source_size", "target", "copies",
                                                   (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.  Rows that agree in id, text and source are numbered in the
    order of their other columns' hash."""
    total = mix(docs, id_col, text_col, source_col, **options).filter("copies > 0").select("id", "text_key", "source", "copy", "copies")
    name = {c: spare_name(docs.columns, c) for c in ("key", "row", "copies", "again")}
    key, row = name["key"], name["row"]
    whole = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{source_col}`").cast("string").alias("source")))
    keyed = whole.withColumn(row, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
    taken = total.select(F.struct("id", "text_key", "source").alias(f"{key}_"), F.col("copy").alias(f"{row}_"), F.col("copies").alias(name["copies"]))
    one = keyed.join(taken, F.col(key).eqNullSafe(F.col(f"{key}_")) & (F.col(row) == F.col(f"{row}_")))
    again = one.withColumn(name["again"], F.explode(F.sequence(F.lit(1), F.col(name["copies"]).cast("int"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
