"""Look-up tables of the attribution, byte walks and one-stage sums against the longer ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathgram.operators import boosting as BO
from pathgram.operators import boxes as BX


def some_forest(depth, trees=12, features=4, seed=1):
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1)
    cover = np.zeros((trees, nodes))
    cover[:, 0] = 1000.0
    for t in range(trees):
        for k in range(2**depth - 1):
            if cover[t, k] > 0 and rng.random() < 0.85:
                feature[t, k] = rng.integers(features)
                share = rng.uniform(0.1, 0.9)
                cover[t, 2 * k + 1], cover[t, 2 * k + 2] = cover[t, k] * share, cover[t, k] * (1 - share)
    return BO.Forest([f"x{k}" for k in range(features)], 3.0, feature, rng.integers(1, 9, (trees, nodes)).astype(float),
                     rng.normal(size=(trees, nodes)), cover, np.ones((trees, nodes)))


@pytest.mark.parametrize("depth, most", [(3, 4096), (3, 12), (5, 4096), (0, 4096), (4, 1)])
def test_look_up_equals_attributions(depth, most):
    forest = some_forest(depth)
    boxes = BX.leaf_boxes(forest)
    x = np.random.default_rng(2).integers(0, 10, (500, 4)).astype(float)  # many values on a cut
    found = BX.cells_of_trees(boxes, 4, most).look_up(x)
    assert np.allclose(found[:, :4], BX.attributions(boxes, x, 4), atol=1e-12)
    assert np.allclose(found[:, 4], forest.score(x), atol=1e-12)


def test_shapley_of_rows_without_a_value(spark):
    forest = some_forest(3)
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0), (2, 1.0, None, 3.0, 4.0)], "id long, x0 double, x1 double, x2 double, x3 double")
    rows = BX.tree_shapley(df, forest, "id").collect()
    x = np.array([[1.0, 2.0, 3.0, 4.0], [1.0, np.nan, 3.0, 4.0]])
    want = BX.attributions(BX.leaf_boxes(forest), x, 4)
    assert len(rows) == 8
    for r in rows:
        assert r.phi == pytest.approx(want[r.case_id - 1, int(r.feature[1])], abs=1e-12)
        assert r.prediction == pytest.approx(forest.score(x)[r.case_id - 1], abs=1e-12)


@pytest.mark.parametrize("depth", [1, 3, 7, 8])
def test_walk_finds_the_nodes_of_a_walk_by_row(depth):
    forest = some_forest(depth, trees=3)
    trees = BO.Trees(forest.feature.astype(np.int16), forest.cut.astype(np.int16), forest.value, forest.cover, forest.gain)
    bins = np.random.default_rng(4).integers(0, 10, (4, 300)).astype(np.uint8)
    found = BO._walk(trees, slice(0, 3), bins, depth)
    for m in range(3):
        for row in range(300):
            node = 0
            for _ in range(depth):
                f = trees.feature[m, node]
                if f >= 0:
                    node = 2 * node + 1 + int(bins[f, row] > trees.bin[m, node])
            assert found[m, row] == node


def test_sums_on_the_driver_or_merged_by_the_executors(spark, monkeypatch):
    """Both ways grow the same trees, on several blocks."""
    df = spark.range(3000).select("id", (F.col("id") * 7 % 83).cast("double").alias("a"), (F.col("id") * 5 % 61).cast("double").alias("b"),
                                  (F.col("id") * 7 % 83 * (F.col("id") * 5 % 61)).cast("double").alias("y"), (F.col("id") % 3).cast("int").alias("fold")).repartition(4)
    settings = BO.Settings(max_depth=3, n_estimators=4, colsample_bytree=0.5)
    cuts = BO.bin_cuts(df, ["a", "b"], 32)
    forests = []
    for most in (BO.DRIVER_BYTES, 0):
        monkeypatch.setattr(BO, "DRIVER_BYTES", most)
        booster = BO.Booster(df, ["a", "b"], "y", "id", cuts, [settings] * 4, [-1, 0, 1, 2], block=400)
        assert booster.blocks > 1
        forests.append((booster.forest(booster.grow(4, [0])[0], 0), booster.errors()))
        booster.close()
    (one, errors), (two, again) = forests
    assert (one.feature == two.feature).all() and (one.cut == two.cut).all()
    assert np.allclose(one.value, two.value, rtol=1e-9) and np.allclose(errors, again, rtol=1e-9)


def test_grid_runs_without_a_pass_for_each_level(spark, monkeypatch):
    """Tables of many blocks: the grid's models are dealt to tasks, with the same scores as by passes over blocks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2))
    rows = [(k, float(a), float(b), float(a * b + a), k % 4 - 1) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, fold int").repartition(5)
    points = [BO.Settings(d, 0.3, t, s, 1.0, 1.0) for d in (1, 3) for t in (2, 4) for s in (0.8, 1.0)]
    plain = BO.Booster.__init__
    monkeypatch.setattr(BO.Booster, "__init__", lambda self, *a, **k: plain(self, *a, **k, block=100, batch=4))
    monkeypatch.setattr(BO, "ALONE", 10)
    by_block = BO.search_grid(df, ["a", "b"], "y", "id", points, 3, 42, 16)
    monkeypatch.setattr(BO, "ALONE", 1000)
    monkeypatch.setattr(BO, "Booster", None)
    assert np.allclose(BO.search_grid(df, ["a", "b"], "y", "id", points, 3, 42, 16), by_block)
