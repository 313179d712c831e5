import math

import numpy as np

from helpers import series
from meterwise.config import DetectionConfig
from meterwise.operators.features import series_frame
from meterwise.operators.iforest import _grow_forest, _score, iforest_detect, permutation_importance_rows, tree_draws
from meterwise.operators.scaler import apply_scaler, fit_scaler
from meterwise.sources import raw_by_type

CFG = DetectionConfig(n_estimators=50)


def _scaled(spark, readings, cfg=CFG):
    f = series_frame(readings, cfg)
    return apply_scaler(f, fit_scaler(f, cfg))


def test_grow_forest_structure():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(1000, 4))
    X[:5] += 8
    picks = np.stack([rng.choice(1000, 256, replace=False) for _ in range(30)])
    trees = _grow_forest(X, picks, rng, 8)
    for t in trees:
        feature, _, left, right, size = t
        assert size[feature < 0].sum() == 256 and size[0] == 256
        assert left.max() < len(size) and right.max() < len(size)
    s = _score(X, trees, 256)
    assert s[:5].min() > np.quantile(s[5:], 0.99)  # injected points isolate first


def test_forest_properties(spark):
    d = iforest_detect(_scaled(spark, raw_by_type(spark, "/root/testdata/sf0.001")), CFG).toPandas()
    for _, g in d.groupby("sensor_id"):  # without ties, the interpolated quantile leaves this many scores above it
        assert g.conf_isolation_forest.notna().sum() == math.ceil(round(0.1 * (len(g) - 1), 9))
    c = d.conf_isolation_forest.dropna()
    assert c.min() >= 0 and c.max() <= 1.0
    assert np.isclose(d.groupby("sensor_id").conf_isolation_forest.max(), 1.0).all()


def test_forest_independent_of_partitioning(spark):
    r = raw_by_type(spark, "/root/testdata/sf0.001")
    a = iforest_detect(_scaled(spark, r), CFG).select("sensor_id", "pos", "if_score").toPandas()
    b = iforest_detect(_scaled(spark, r.repartition(3), CFG.with_(block_rows=300)), CFG.with_(block_rows=300)) \
        .select("sensor_id", "pos", "if_score").toPandas()
    m = a.merge(b, on=["sensor_id", "pos"])
    assert len(m) == len(a) and np.allclose(m.if_score_x, m.if_score_y)


def test_permutation_importance(spark):
    x = np.random.default_rng(1).normal(10, 1, 300)
    imp = permutation_importance_rows(_scaled(spark, series(spark, list(x))), CFG).toPandas()
    assert len(imp) == 12 and (imp.importance >= 0).all()


def test_permutation_importance_independent_of_blocks(spark):
    r = raw_by_type(spark, "/root/testdata/sf0.001")
    frames = [permutation_importance_rows(_scaled(spark, r, c), c).toPandas().set_index(["sensor_id", "feature"]).importance.sort_index()
              for c in (CFG.with_(n_estimators=20), CFG.with_(n_estimators=20, block_rows=200))]
    assert np.allclose(*frames)


def test_draws_reach_all_rows(spark):
    cfg = CFG.with_(max_samples=8, n_estimators=40)
    s = spark.createDataFrame([("short", 5), ("middle", 100), ("long", 1000)], "sensor_id string, n bigint")
    d = tree_draws(s, cfg).toPandas()
    for name, n in (("short", 5), ("middle", 100), ("long", 1000)):
        g = d[d.sensor_id == name]
        assert (g.groupby("tree_id").pos.nunique() == min(8, n)).all() and (g.groupby("tree_id").size() == min(8, n)).all()
        assert g.pos.between(0, n - 1).all() and g.pos.max() >= 0.8 * n - 1 and g.pos.min() <= 0.2 * n


def _path(tree, x):
    """Plain traversal: depth of the leaf and its expected rest."""
    node, depth = 0, 0
    while tree.feature[node] >= 0:
        node = tree.left[node] if x[tree.feature[node]] < tree.threshold[node] else tree.right[node]
        depth += 1
    n = tree.size[node]
    return depth + (0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def _plain_score(trees, x):
    psi = trees[0].psi
    rest = 1.0 if psi == 2 else 2 * (math.log(psi - 1) + 0.5772156649015329) - 2 * (psi - 1) / psi
    return 2.0 ** (-sum(_path(t, x) for t in trees) / len(trees) / rest)


def _small(spark):
    from meterwise.operators.iforest import feature_vector, fit_forest
    cfg = CFG.with_(n_estimators=30, max_samples=32, block_rows=250)
    frame = _scaled(spark, raw_by_type(spark, "/root/testdata/sf0.001"), cfg).cache()
    rows = {}
    for r in feature_vector(frame).select("sensor_id", "pos", "fx").collect():
        rows.setdefault(r.sensor_id, {})[r.pos] = r.fx
    forest = {}
    for r in fit_forest(frame, cfg).collect():
        forest.setdefault(r.sensor_id, []).append(r)
    return cfg, frame, rows, forest


def test_trees_and_scores_equal_plain_loops(spark):
    """Every tree is a valid one over its drawn rows, and every score that of a row by row traversal."""
    cfg, frame, rows, forest = _small(spark)
    draws = {}
    for r in tree_draws(frame.groupBy("sensor_id").agg({"n": "max"}).withColumnRenamed("max(n)", "n"), cfg).collect():
        draws.setdefault((r.sensor_id, r.tree_id), []).append(rows[r.sensor_id][r.pos])
    for sensor, trees in forest.items():
        assert sorted(t.tree_id for t in trees) == list(range(30))
        for t in trees:
            held = [(0, 0, draws[sensor, t.tree_id])]
            while held:
                node, depth, xs = held.pop()
                assert t.size[node] == len(xs)
                f = t.feature[node]
                if f < 0:  # a leaf: alone, at the depth limit, or all the same
                    assert len(xs) <= 1 or depth == math.ceil(math.log2(32)) or all(x == xs[0] for x in xs)
                    continue
                assert min(x[f] for x in xs) <= t.threshold[node] < max(x[f] for x in xs)
                held.append((t.left[node], depth + 1, [x for x in xs if x[f] < t.threshold[node]]))
                held.append((t.right[node], depth + 1, [x for x in xs if x[f] >= t.threshold[node]]))
    got = iforest_detect(frame, cfg).select("sensor_id", "pos", "if_score", "if_min", "if_max", "if_threshold", "conf_isolation_forest").collect()
    assert len(got) == sum(map(len, rows.values()))
    plain = {}
    for r in got:
        s = plain[r.sensor_id, r.pos] = _plain_score(forest[r.sensor_id], rows[r.sensor_id][r.pos])
        assert abs(r.if_score - s) < 1e-9
    for sensor in rows:
        s = [plain[sensor, p] for p in rows[sensor]]
        cut = np.quantile(s, 0.9)
        for r in (r for r in got if r.sensor_id == sensor):
            x = plain[sensor, r.pos]
            assert abs(r.if_threshold - cut) < 1e-9
            want = (x - min(s)) / (max(s) - min(s)) if r.if_score > r.if_threshold else None
            assert (r.conf_isolation_forest is None) == (want is None) and (want is None or abs(r.conf_isolation_forest - want) < 1e-9)


def test_importance_equals_plain_loops(spark):
    from meterwise.config import FOREST_FEATURES
    from meterwise.operators.iforest import feature_vector, fit_forest, permuted_features
    cfg, frame, rows, forest = _small(spark)
    moved = {}
    x = feature_vector(frame).select("sensor_id", "blk", "pos", "n", "fx")
    for r in permuted_features(x, cfg).collect():
        moved.setdefault(r.sensor_id, {})[r.pos] = r.px
    got = {(r.sensor_id, r.feature): r.importance for r in permutation_importance_rows(frame, cfg, fit_forest(frame, cfg)).collect()}
    for sensor, held in rows.items():
        for i in range(len(FOREST_FEATURES)):  # a permutation: the same values at other places
            assert sorted(p[i] for p in moved[sensor].values()) == sorted(f[i] for f in held.values())
        base = np.mean([_plain_score(forest[sensor], f) for f in held.values()])
        for i in (0, 3, 11):
            perm = np.mean([_plain_score(forest[sensor], [*f[:i], moved[sensor][p][i], *f[i + 1:]]) for p, f in held.items()])
            assert abs(got[sensor, FOREST_FEATURES[i]] - abs(perm - base)) < 1e-9


def test_selected_threshold_equals_the_exact_one(spark):
    frame = _scaled(spark, raw_by_type(spark, "/root/testdata/sf0.001")).cache()
    a, b = (iforest_detect(frame, CFG.with_(quantiles=q)).select("sensor_id", "pos", "if_threshold").orderBy("sensor_id", "pos").collect() for q in ("exact", "selection"))
    assert a == b


def test_row_batches_hold_no_null_lists(spark):
    """Arrow's list writer takes time with the square of a batch's null lists in turn: the rows behind the trees have empty ones."""
    from meterwise.operators.iforest import _with_trees
    forest = spark.createDataFrame([("s", 0, 2, [0, -1, -1], [0.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [2, 1, 1])],
                                   "sensor_id string, tree_id int, psi int, feature array<int>, threshold array<double>, left array<int>, right array<int>, size array<int>")
    rows = spark.createDataFrame([("s", 0, [0.1]), ("s", 0, [0.9])], "sensor_id string, blk bigint, fx array<double>")
    got = [r["tree"] for r in _with_trees(rows, forest).collect()]
    assert [t["tree_id"] for t in got] == [0, None, None]
    assert all(t[c] == [] for t in got[1:] for c in ("feature", "threshold", "left", "right", "size"))


def test_packed_trees_score_as_walked_ones():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(500, 4))
    X[0, 1], X[1, 2] = np.nan, np.inf
    trees = _grow_forest(np.nan_to_num(X, posinf=3.0), np.stack([rng.permutation(500)[:64] for _ in range(7)]), rng, 6)
    from meterwise.operators.iforest import _avg_path
    for i in (0, 1, 2, 300):
        total = 0.0
        for feat, thr, left, right, size in trees:
            node, depth = 0, 0
            while feat[node] >= 0:
                node, depth = (left if X[i, feat[node]] < thr[node] else right)[node], depth + 1
            total += depth + _avg_path([size[node]])[0]
        assert _score(X, trees, 64)[i] == np.power(2.0, -(total / 7) / _avg_path([64])[0])
