"""D3 isolation forest and D4 permutation importance (Liu, Ting & Zhou 2008).

Spark has no isolation forest, so this is the one detector with Python in the
hot path, and it is Arrow-batched and bounded per task:

* **Fit** - each tree draws ``psi = min(max_samples, n)`` positions of its
  sensor uniformly without replacement from *all* rows (a hash of seed, sensor,
  tree and draw), so no row is out of reach of the forest however long the
  series.  The drawn positions are joined with the rows, and one
  ``applyInPandas`` group holds the draws of ``TREES_A_GROUP`` trees; random
  feature, uniform split, depth <= ceil(log2 psi).  Nothing depends on
  partitioning or block size.  Output: forest table (sensor_id, tree_id, psi
  and the nodes as flat arrays).
* **Score** - the rows of each ``(sensor_id, blk)`` follow their sensor's trees
  in one sorted stream: a task keeps one forest and scores an Arrow batch at a
  time with NumPy, all rows of a tree at once, step by step from the root.  ``s = 2^(-E[h]/c(psi))``.
* **Threshold** - a row is an anomaly when its score is above the linearly
  interpolated ``1 - contamination`` quantile of its sensor's scores (the same
  as the decision function below 0); confidence = (s - min s) / (max s - min s).
  Quantile, min and max are per-sensor aggregates.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..config import ENGINEERED_FEATURES, FOREST_FEATURES, SCALED_FEATURES, DetectionConfig
from ..schema import FOREST
from .quantiles import exact_quantiles

EULER = 0.5772156649015329


def feature_vector(df: DataFrame) -> DataFrame:
    """``fx``: the forest features, scaled where the scaler applies, missing
    values (first-row differences and deviations) as 0 = the feature mean."""
    cols = []
    for f in FOREST_FEATURES:
        c = F.col(f"{f}_scaled") if f in SCALED_FEATURES and f"{f}_scaled" in df.columns else F.col(f)
        cols.append(F.coalesce(c.cast("double"), F.lit(0.0)))
    return df.withColumn("fx", F.array(*cols))


TREES_A_GROUP = 25
#: Strides for seeded bijections of 0..n-1: the first that does not divide n is used.
_STRIDES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)


def _avg_path(n):
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _seed_for(seed: int, sensor: str) -> int:
    import zlib
    return (zlib.crc32(sensor.encode("utf-8")) * 1_000_003 + seed) % (2 ** 32)


def _grow_forest(X: np.ndarray, picks: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow several trees at once, level by level.

    ``picks`` (trees x psi) indexes the training rows of each tree.  Nodes of
    all trees form one table of flat arrays; each level splits every splittable
    node with per-node min / max (``reduceat`` over samples sorted by node).
    Returns, per tree, (feature, threshold, left, right, size) with tree-local
    child indices."""
    n_trees, psi = picks.shape
    xs = X[picks.reshape(-1)]                       # samples of all trees
    node_of = np.repeat(np.arange(n_trees), psi)    # root of tree t has id t
    tree = np.arange(n_trees)
    feat, thr = np.full(n_trees, -1), np.zeros(n_trees)
    left, right, size = np.full(n_trees, -1), np.full(n_trees, -1), np.full(n_trees, psi)
    frontier = np.arange(n_trees)
    for _ in range(max_depth):
        frontier = frontier[np.bincount(node_of, minlength=len(feat))[frontier] > 1]
        if len(frontier) == 0:
            break
        idx = np.flatnonzero(np.isin(node_of, frontier))
        order = idx[np.argsort(node_of[idx], kind="stable")]
        nodes_sorted = node_of[order]
        starts = np.flatnonzero(np.r_[True, nodes_sorted[1:] != nodes_sorted[:-1]])
        ids = nodes_sorted[starts]
        lo = np.minimum.reduceat(xs[order], starts, axis=0)
        hi = np.maximum.reduceat(xs[order], starts, axis=0)
        r = rng.random(lo.shape)
        r[~(hi > lo)] = -1.0
        f = r.argmax(axis=1)
        ok = r[np.arange(len(ids)), f] >= 0
        ids, f, lo_f, hi_f = ids[ok], f[ok], lo[ok, f[ok]], hi[ok, f[ok]]
        if len(ids) == 0:
            break
        t = lo_f + rng.random(len(ids)) * (hi_f - lo_f)
        base = len(feat)
        lid = base + 2 * np.arange(len(ids))
        rid = lid + 1
        fmap = np.full(base, -1)
        fmap[ids] = np.arange(len(ids))
        # route the samples of split nodes; neither side is empty, as t lies in [lo, hi)
        k = fmap[node_of]
        moving = np.flatnonzero(k >= 0)
        km = k[moving]
        node_of[moving] = np.where(xs[moving, f[km]] < t[km], lid[km], rid[km])
        feat[ids], thr[ids], left[ids], right[ids] = f, t, lid, rid
        more = 2 * len(ids)
        feat, thr = np.append(feat, np.full(more, -1)), np.append(thr, np.zeros(more))
        left, right = np.append(left, np.full(more, -1)), np.append(right, np.full(more, -1))
        size = np.append(size, np.bincount(node_of, minlength=base + more)[base:])
        tree = np.append(tree, np.repeat(tree[ids], 2))
        frontier = np.arange(base, base + more)
    order = np.argsort(tree, kind="stable")
    cuts = np.flatnonzero(np.diff(tree[order])) + 1
    first = np.concatenate([[0], cuts])
    local = np.empty(len(tree), dtype=np.int64)
    local[order] = np.arange(len(tree)) - first[tree[order]]
    left, right = np.where(left >= 0, local[left], -1), np.where(right >= 0, local[right], -1)
    return [tuple(c[i] for c in (feat, thr, left, right, size)) for i in np.split(order, cuts)]


def _fit_group(cfg: DetectionConfig):
    seed = cfg.forest_seed
    names = ["sensor_id", "tree_id", "psi", "feature", "threshold", "left", "right", "size"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree_id", "pos"])
        sensor, first = str(pdf["sensor_id"].iloc[0]), int(pdf["tree_id"].iloc[0])
        X = np.vstack(pdf["fx"].to_numpy())
        ids, psi = np.unique(pdf["tree_id"].to_numpy()), int(pdf["psi"].iloc[0])
        rng = np.random.default_rng([_seed_for(seed, sensor), first])
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        trees = _grow_forest(X, np.arange(len(X)).reshape(len(ids), psi), rng, max_depth)
        return pd.DataFrame([(sensor, int(t), psi, *tree) for t, tree in zip(ids, trees)], columns=names)

    return fit


def tree_draws(sensors: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """(sensor_id, tree_id, psi, blk, pos): the rows each tree is grown on, from (sensor_id, n).
    Short series order all positions by hash; in long ones twice as many hashed draws hold
    ``psi`` different positions but for a chance far below 2^-100."""
    m = cfg.max_samples
    each = sensors.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_estimators - 1))))
    hashed = lambda i: F.xxhash64(F.lit(cfg.forest_seed), F.col("sensor_id"), F.col("tree_id"), i)
    every = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("n"), F.lit(16 * m)) - 1),
                                                 lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))), lambda s: s["i"])
    some = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(2 * m).cast("bigint")), lambda i: F.pmod(hashed(i), F.col("n"))))
    each = each.withColumn("psi", F.least(F.col("n"), F.lit(m)).cast("int"))
    drawn = each.select("sensor_id", "tree_id", "psi", F.explode(F.slice(F.when(F.col("n") <= 16 * m, every).otherwise(some), F.lit(1), F.col("psi"))).alias("pos"))
    return drawn.withColumn("blk", F.floor(F.col("pos") / cfg.block_rows).cast("bigint"))


def fit_forest(j: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Forest table per sensor; every tree draws from all rows of its sensor."""
    x = feature_vector(j).select("sensor_id", "blk", "pos", "fx")
    draws = tree_draws(j.groupBy("sensor_id").agg(F.max("n").alias("n")), cfg)
    pool = x.join(draws, ["sensor_id", "blk", "pos"]).select("sensor_id", "tree_id", "psi", "pos", "fx")
    return pool.groupBy("sensor_id", F.floor(F.col("tree_id") / TREES_A_GROUP)).applyInPandas(_fit_group(cfg), FOREST)


class _Packed(NamedTuple):
    """Trees as flat arrays over all their nodes.  A leaf leads to itself, so that all rows take ``height`` steps;
    ``path`` is a node's depth and the expected rest of the path below it."""

    roots: np.ndarray
    heights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray


def _packed(trees) -> _Packed:
    sizes = [len(t[0]) for t in trees]
    roots = np.cumsum([0, *sizes])[:-1]
    feature, threshold, left, right, size = (np.concatenate(c) for c in zip(*trees))
    me, base = np.arange(len(feature)), np.repeat(roots, sizes)
    inner = feature >= 0
    child = np.stack([np.where(inner, left + base, me), np.where(inner, right + base, me)], 1)
    depth, tree, level, node, heights = np.zeros(len(me)), np.repeat(np.arange(len(trees)), sizes), 0, roots, np.zeros(len(trees), np.int64)
    while len(node := node[inner[node]]):
        level += 1
        heights[tree[node]] = level
        node = child[node].ravel()
        depth[node] = level
    return _Packed(roots, heights, np.where(inner, feature, 0).astype(np.int64), threshold, child.ravel().astype(np.int64), depth + _avg_path(size))


SCORE_ROWS = 1 << 13


def _score(X: np.ndarray, trees, psi: int) -> np.ndarray:
    if len(trees) == 0 or len(X) == 0:
        return np.full(len(X), np.nan)
    f = trees if isinstance(trees, _Packed) else _packed(trees)
    total = np.zeros(len(X))
    for lo in range(0, len(X), SCORE_ROWS):  # arrays that stay in the processor's cache
        x = np.ascontiguousarray(X[lo:lo + SCORE_ROWS], dtype=float)
        n, at = len(x), np.arange(len(x)) * x.shape[1]
        flat, sums = x.ravel(), total[lo:lo + n]
        for root, height in zip(f.roots.tolist(), f.heights.tolist()):
            node = np.full(n, root)
            for _ in range(height):
                right = ~(flat.take(at + f.feature.take(node)) < f.threshold.take(node))
                node = f.child.take(2 * node + right)
            sums += f.path.take(node)
    mean_h = total / len(f.roots)
    return np.power(2.0, -mean_h / max(_avg_path([psi])[0], 1e-12))


def _forest_per_block(forest: DataFrame, rows: DataFrame) -> DataFrame:
    """The sensor's forest replicated to each of its blocks (the block list
    is a distinct over the rows' own partitioning key), keys renamed so both
    cogroup sides stay distinct."""
    blocks = rows.select(F.col("sensor_id").alias("f_sensor"), F.col("blk").alias("f_blk")).distinct()
    return forest.join(blocks, forest["sensor_id"] == blocks["f_sensor"]).drop("sensor_id")


def _with_trees(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """The rows of each (sensor, block) behind its sensor's trees, in one sorted stream: ``tree.tree_id`` is set on tree rows only.
    The other rows have empty lists: Arrow's list writer takes time with the square of a batch's null lists in turn."""
    fb = _forest_per_block(forest, rows)
    parts = [F.col(c) for c in ("tree_id", "psi", "feature", "threshold", "left", "right", "size")]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in ("sensor_id", "blk")]
    trees = fb.select(F.col("f_sensor").alias("sensor_id"), F.col("f_blk").alias("blk"), *empty, F.struct(*parts).alias("tree"))
    none = F.lit(None).cast(trees.schema["tree"].dataType)
    both = trees.unionByName(rows.withColumn("tree", none))
    both = both.repartition("sensor_id", "blk").sortWithinPartitions("sensor_id", "blk", F.col("tree").isNull(), "tree.tree_id")
    full = [F.coalesce(F.col(f"tree.{f.name}"), F.array().cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"tree.{f.name}")
            for f in trees.schema["tree"].dataType.fields]
    return both.withColumn("tree", F.struct(*full))


def _per_batch(score):
    """``score(key, batch of rows, trees, psi)`` for every stretch of rows of one (sensor, block) within an Arrow batch; the
    trees that came before the rows are kept from batch to batch."""

    def run(batches):
        key, trees, psi = None, [], 1
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(b.schema.get_field_index("tree"))
            sensors, blocks = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("sensor_id", "blk"))
            is_tree = t.field("tree_id").is_valid().to_pylist()
            marks = list(zip(sensors, blocks, is_tree))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if (sensors[lo], blocks[lo]) != key:
                    key, trees, psi = (sensors[lo], blocks[lo]), [], 1
                if is_tree[lo]:
                    for x in t.slice(lo, hi - lo).to_pylist():
                        trees.append((np.asarray(x["feature"], np.int64), np.asarray(x["threshold"], float), np.asarray(x["left"], np.int64),
                                      np.asarray(x["right"], np.int64), np.asarray(x["size"], float)))
                        psi = x["psi"]
                else:
                    trees = _packed(trees) if isinstance(trees, list) and trees else trees
                    yield from score(key, b.slice(lo, hi - lo), trees, psi)

    return run


def _matrix(batch, name: str) -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(name))
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def score_rows(j: DataFrame, forest: DataFrame, cfg: DetectionConfig,
               keep: list[str] | None = None) -> DataFrame:
    """Adds ``if_score`` (higher = more isolated).  ``keep``: columns passed
    through the Arrow batches (default: every primitive column)."""
    x = feature_vector(j)
    if keep is None:
        keep = [f.name for f in x.schema.fields
                if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    rows = x.select(*keep, "fx")
    out_schema = T.StructType([f for f in rows.schema.fields if f.name != "fx"]
                              + [T.StructField("if_score", T.DoubleType())])
    names = [f.name for f in out_schema.fields]

    def score(key, batch, trees, psi):
        import pyarrow as pa
        s = _score(_matrix(batch, "fx"), trees, psi)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names[:-1]] + [pa.array(s, from_pandas=True)], names=names)

    return _with_trees(rows, forest).mapInArrow(_per_batch(score), out_schema)


def forest_thresholds(scored: DataFrame, aggs: list, cfg: DetectionConfig) -> DataFrame:
    """Per sensor the aggregates, the least and greatest score and the interpolated contamination quantile."""
    q = 1.0 - cfg.contamination
    aggs = [*aggs, F.min("if_score").alias("if_min"), F.max("if_score").alias("if_max")]
    if cfg.quantiles == "selection":
        found = exact_quantiles(scored, [q], "if_score").select("sensor_id", F.get("quantiles", F.lit(0)).alias("if_threshold"))
        return scored.groupBy("sensor_id").agg(*aggs).join(found, "sensor_id", "left")
    at = (F.percentile("if_score", F.lit(q)) if cfg.quantiles == "exact"
          else F.percentile_approx("if_score", q, cfg.quantile_accuracy))
    return scored.groupBy("sensor_id").agg(*aggs, at.alias("if_threshold"))


def forest_confidence(j: DataFrame, cfg: DetectionConfig) -> DataFrame:
    conf = F.try_divide(F.col("if_score") - F.col("if_min"), F.col("if_max") - F.col("if_min"))
    flag = F.col("if_score") > F.col("if_threshold")
    return j.withColumn("conf_isolation_forest", F.when(flag, F.coalesce(conf, F.lit(0.0))))


def iforest_detect(frame_scaled: DataFrame, cfg: DetectionConfig, materialize: bool = True) -> DataFrame:
    """Scaled series frame -> rows with if_score and conf_isolation_forest.
    With ``materialize`` the input rows and the forest are checkpointed:
    fitting and scoring both read them."""
    from ..session import cut_lineage
    from .layout import attach_per_sensor
    if materialize:
        frame_scaled = cut_lineage(frame_scaled)
    forest = fit_forest(frame_scaled, cfg)
    if materialize:
        forest = cut_lineage(forest)
    scored = score_rows(frame_scaled, forest, cfg)
    if materialize:  # the scores feed the threshold aggregate and the rows
        scored = cut_lineage(scored)
    th = forest_thresholds(scored, [F.max("n").alias("n")], cfg)
    return forest_confidence(attach_per_sensor(scored, th, cfg), cfg)


def permuted_features(x: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """(sensor_id, blk, pos, px): each forest feature of ``x`` permuted over the sensor's *whole* series by a
    seeded bijection of positions, ``(stride * pos + shift) mod n`` with a stride coprime to n.  Arithmetic
    only: no sort, no group per sensor, and the same result for every block size."""
    n = F.col("n")

    def target(i: int):
        turned = _STRIDES[i % len(_STRIDES):] + _STRIDES[:i % len(_STRIDES)]
        fits = F.filter(F.array(*[F.lit(p).cast("bigint") for p in turned]), lambda p: F.pmod(n, p) != 0)
        shift = F.pmod(F.xxhash64(F.lit(cfg.forest_seed), F.col("sensor_id"), F.lit(i)), n)
        return F.pmod(F.pmod(fits[0], n) * F.col("pos") + shift, n)

    moved = F.array(*[F.struct(target(i).alias("to"), F.lit(i).alias("i"), F.col("fx")[i].alias("v")) for i in range(len(FOREST_FEATURES))])
    rows = x.select("sensor_id", F.explode(moved).alias("m")).select("sensor_id", F.col("m.to").alias("pos"), F.struct("m.i", "m.v").alias("e"))
    rows = rows.withColumn("blk", F.floor(F.col("pos") / cfg.block_rows).cast("bigint"))
    return (rows.groupBy("sensor_id", "blk", "pos").agg(F.array_sort(F.collect_list("e")).alias("es"))
            .select("sensor_id", "blk", "pos", F.transform("es", lambda e: e["v"]).alias("px")))


def permutation_importance_rows(j: DataFrame, cfg: DetectionConfig, forest: DataFrame | None = None) -> DataFrame:
    """|mean s - mean s_permuted| per (sensor, feature).  Scores of the rows and of the rows with one
    feature permuted are summed per block and added up per sensor, so every row counts."""
    if forest is None:
        from ..session import cut_lineage
        j = cut_lineage(j)
        forest = cut_lineage(fit_forest(j, cfg))
    x = feature_vector(j).select("sensor_id", "blk", "pos", "n", "fx")
    x = x.join(permuted_features(x, cfg), ["sensor_id", "blk", "pos"]).select("sensor_id", "blk", "fx", "px")
    schema = "sensor_id string, feature string, n bigint, base double, perm double"

    def imp(key, batch, trees, psi):
        import pyarrow as pa
        if not trees:
            return
        X, P = _matrix(batch, "fx"), _matrix(batch, "px")
        base, out = _score(X, trees, psi).sum(), []
        for i, name in enumerate(FOREST_FEATURES):
            Xp = X.copy()
            Xp[:, i] = P[:, i]
            out.append((key[0], name, len(X), base, _score(Xp, trees, psi).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["sensor_id", "feature", "n", "base", "perm"])

    sums = _with_trees(x, forest).mapInArrow(_per_batch(imp), schema)
    agg = sums.groupBy("sensor_id", "feature").agg(
        F.abs((F.sum("perm") - F.sum("base")) / F.sum("n")).alias("importance"))
    ordinal = F.lit(len(ENGINEERED_FEATURES))
    for i, f in enumerate(ENGINEERED_FEATURES):
        ordinal = F.when(F.col("feature") == f, F.lit(i)).otherwise(ordinal)
    return agg.withColumn("ordinal", ordinal)
