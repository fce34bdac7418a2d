"""Boosting, attribution and optimum of trees against plain loops over rows, coalitions and cells."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathgram.functions.hashing import PRIME, lane_array
from pathgram.operators import boosting, optimum, trees
from pathgram.operators.boosting import Forest, Settings, bin_cuts, boost, search_grid
from pathgram.operators.boxes import attributions, leaf_boxes, tree_shapley

FEATURES = ["a", "b", "c"]
SEED = 42


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 240
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n), rng.normal(size=n)]).astype(float)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 5, -5) * x[:, 2] + rng.normal(size=n) * 0.3
    fold = np.arange(n) % 3
    fold[:30] = -1
    return np.arange(n) * 7, x, y, fold


@pytest.fixture(scope="module")
def table(spark, rows):
    ids, x, y, fold = rows
    data = [(int(i), *map(float, v), float(t), int(k)) for i, v, t, k in zip(ids, x, y, fold)]
    return spark.createDataFrame(data, "case_id long, a double, b double, c double, y double, fold int").repartition(5)


def plain_boost(ids, x, y, fold, left_out, s, cuts):
    """The same model by loops: every cut of every feature is tried on the rows of a node."""
    train = (fold >= 0) & (fold != left_out)
    margin = np.full(len(y), y[train].mean())
    grown = []
    for turn in range(s.n_estimators):
        lane = lane_array(ids, np.array([turn]), SEED + boosting.ROW_STREAM)[:, 0] / PRIME
        used = train & (lane < s.subsample) if s.subsample < 1 else train
        order = np.argsort(lane_array(np.arange(x.shape[1]), np.array([turn]), SEED + boosting.COLUMN_STREAM)[:, 0], kind="stable")
        columns = sorted(order[: max(1, int(s.colsample_bytree * x.shape[1] + 1e-9))])
        g = margin - y

        def leaf(at):
            return -g[at & used].sum() / ((at & used).sum() + s.reg_lambda) * s.learning_rate

        def grow(at, level):
            best = (1e-6, None)
            if level < s.max_depth:
                total, n = g[at & used].sum(), (at & used).sum()
                for f in columns:
                    for c in cuts[f]:
                        left = at & used & (x[:, f] < c)
                        gl, hl = g[left].sum(), left.sum()
                        if hl >= 1 and n - hl >= 1:
                            gain = gl**2 / (hl + s.reg_lambda) + (total - gl) ** 2 / (n - hl + s.reg_lambda) - total**2 / (n + s.reg_lambda)
                            if gain > best[0] * (1 + 1e-12):
                                best = gain, (f, c)
            if best[1] is None:
                return np.where(at, leaf(at), 0.0), [(None, 0.0)]
            f, c = best[1]
            a, under = grow(at & (x[:, f] < c), level + 1)
            b, over = grow(at & (x[:, f] >= c), level + 1)
            return a + b, [(f, best[0]), *under, *over]

        step, splits = grow(np.ones(len(y), bool), 0)
        margin = margin + step
        grown.append(splits)
    return margin, grown


@pytest.mark.parametrize("settings", [
    Settings(1, 0.5, 3, 1.0, 1.0, 0.0), Settings(3, 0.3, 6, 0.8, 0.7, 5.0), Settings(5, 0.1, 4, 0.7, 1.0, 1.0)])
def test_boosting_equals_plain_loops(table, rows, settings):
    ids, x, y, fold = rows
    cuts = bin_cuts(table.filter("fold >= 0"), FEATURES, 32)
    forest, scores = boost(table, FEATURES, "y", "case_id", settings, 3, SEED, 32)
    want, grown = plain_boost(ids, x, y, fold, -1, settings, cuts)
    assert np.allclose(forest.score(x), want)
    gains = [g for f, g in itertools.chain(*grown) if f is not None]
    assert np.isclose(sum(g for *_, g in forest.gains()), sum(gains)) and sum(n for _, n, _ in forest.gains()) == len(gains)
    for k, (r2, rmse, mae) in enumerate(scores):
        held, guess = fold == k, plain_boost(ids, x, y, fold, k, settings, cuts)[0]
        gap = y[held] - guess[held]
        assert np.allclose([r2, rmse, mae], [1 - (gap**2).sum() / ((y[held] - y[held].mean()) ** 2).sum(), math.sqrt((gap**2).mean()), np.abs(gap).mean()])


def test_blocks_and_batches_do_not_matter(table, monkeypatch):
    settings = Settings(3, 0.3, 4, 0.8, 0.7, 1.0)
    one, scores = boost(table, FEATURES, "y", "case_id", settings, 3, SEED)
    plain = boosting.Booster.__init__
    monkeypatch.setattr(boosting.Booster, "__init__", lambda self, *a, **k: plain(self, *a, **k, block=17, batch=2))
    monkeypatch.setattr(boosting, "KEEP", 2)
    many, again = boost(table, FEATURES, "y", "case_id", settings, 3, SEED)
    assert (one.feature == many.feature).all() and np.allclose(one.value, many.value) and np.allclose(scores, again)


def test_grid_choice_equals_a_loop(table):
    grid = {"max_depth": [1, 3], "learning_rate": [0.1, 0.4], "n_estimators": [2, 5], "subsample": [0.8, 1.0], "reg_lambda": [0.0, 20.0]}
    points = trees.grid_points(grid, {"colsample_bytree": 1.0})
    assert len(points) == 32
    found = search_grid(table, FEATURES, "y", "case_id", points, 3, SEED, 32)
    some = [0, 7, 13, 22, 31]
    alone = np.array([boost(table, FEATURES, "y", "case_id", points[k], 3, SEED, 32)[1].mean(axis=0) for k in some])
    assert np.allclose(found[some], alone)
    fit = trees.train_trees(table.drop("fold"), FEATURES, "y", "case_id", grid, {"colsample_bytree": 1.0}, 3, max_bins=32)
    parts = trees.modelling_parts(table.drop("fold"), FEATURES, "y", "case_id", 3, 0.2, 42)
    scores = search_grid(parts, FEATURES, "y", "case_id", points, 3, 42, 32)
    assert Settings(**fit.params) == points[trees.best_point(scores)]
    cv = {r["part"]: r for r in fit.validation.collect()}["cv"]
    assert np.isclose(cv["r2"], np.nanmax(scores[:, 0]))


def test_training_report(table):
    fit = trees.train_trees(table.drop("fold"), FEATURES, "y", "case_id", None, {"n_estimators": 20, "learning_rate": 0.3}, 3)
    got = {r["part"]: r for r in fit.validation.collect()}
    assert set(got) == {"train", "test", "cv"} and got["train"]["r2"] > 0.9 and got["cv"]["r2"] > 0.6
    shares = fit.importance.collect()
    assert abs(sum(r["percent"] for r in shares) - 100) < 1e-9 and abs(sum(r["percent_total"] for r in shares) - 100) < 1e-9


def test_constant_features_and_target(spark):
    df = spark.createDataFrame([(k, 1.0, float(k % 2), 4.0, k % 2) for k in range(20)], "case_id long, a double, b double, y double, fold int")
    forest, scores = boost(df, ["a", "b"], "y", "case_id", Settings(n_estimators=2), 2)
    assert np.allclose(forest.score(np.array([[1.0, 0.0], [1.0, 1.0]])), 4.0) and np.isnan(scores[:, 0]).all()
    assert all(n == 0 for _, n, _ in forest.gains())


# --- attribution


def plain_shapley(forest, x):
    """All coalitions; unknown features follow both children by cover."""
    d = len(forest.features)

    def value(t, node, known):
        f = forest.feature[t, node]
        if f < 0:
            return forest.value[t, node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            return value(t, left if x[f] < forest.cut[t, node] else right, known)
        a, b = forest.cover[t, left], forest.cover[t, right]
        return (a * value(t, left, known) + b * value(t, right, known)) / (a + b)

    total = lambda known: sum(value(t, 0, known) for t in range(len(forest.feature)))
    games = {s: total(set(s)) for n in range(d + 1) for s in itertools.combinations(range(d), n)}
    phi = np.zeros(d)
    for s, v in games.items():
        for j in range(d):
            if j not in s:
                weight = math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)
                phi[j] += weight * (games[tuple(sorted((*s, j)))] - v)
    return phi


def random_forest(features, trees_, depth, seed, whole=()):
    rng = np.random.default_rng(seed)
    nodes, inner = 2 ** (depth + 1) - 1, 2**depth - 1
    feature, cut, value, cover = np.full((trees_, nodes), -1), np.zeros((trees_, nodes)), np.zeros((trees_, nodes)), np.zeros((trees_, nodes))
    for t in range(trees_):
        cover[t, 0] = 1000
        for k in range(nodes):
            value[t, k] = rng.normal()
            if k < inner and cover[t, k] > 0 and rng.random() < 0.9:
                feature[t, k] = rng.integers(features)
                cut[t, k] = rng.integers(1, 10) if feature[t, k] in whole else rng.random()
                cover[t, 2 * k + 1] = cover[t, k] * rng.uniform(0.1, 0.9)
                cover[t, 2 * k + 2] = cover[t, k] - cover[t, 2 * k + 1]
    return Forest([f"f{k}" for k in range(features)], 0.5, feature, cut, value, cover, np.zeros((trees_, nodes)))


@pytest.mark.parametrize("features,depth", [(3, 3), (4, 5), (1, 2)])
def test_attribution_equals_all_coalitions(features, depth):
    forest = random_forest(features, 4, depth, features)
    x = np.random.default_rng(1).random((12, features))
    got = attributions(leaf_boxes(forest), x, features)
    assert np.allclose(got, [plain_shapley(forest, row) for row in x])


def test_attribution_of_thirty_features_adds_up(spark):
    forest = random_forest(30, 60, 4, 8)
    x = np.random.default_rng(2).random((200, 30))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "case_id long, " + ", ".join(f"f{k} double" for k in range(30)))
    phi = tree_shapley(df, forest, "case_id")
    sums = phi.groupBy("case_id").agg((F.sum("phi") - F.first("prediction") + F.first("baseline")).alias("gap"), F.first("prediction").alias("p")).collect()
    assert len(sums) == 200 and max(abs(r["gap"]) for r in sums) < 1e-9
    assert np.allclose([r["p"] for r in sorted(sums, key=lambda r: r["case_id"])], forest.score(x))


# --- optimum


def corners(forest, ends):
    """Every cell, by its lowest value."""
    axes = []
    for f, (low, high, whole) in enumerate(ends):
        cuts = sorted({float(c) for c in forest.cut[forest.feature == f] if low < c <= high} | {low})
        axes.append(sorted({math.ceil(c) if whole else c for c in cuts if not whole or math.ceil(c) <= high}))
    points = np.array(list(itertools.product(*axes)), float)
    values = forest.score(points)
    return values.min(), values.max()


@pytest.mark.parametrize("split,steps", [(256, 60), (2, 1)])
def test_tree_optimum_equals_every_cell(spark, split, steps):
    forest = random_forest(3, 12 if steps > 1 else 6, 3, 5, whole=(0,))
    df = spark.createDataFrame([(0, 0.05, 0.0), (9, 0.95, 1.0), (4, 0.5, 0.5)], "f0 int, f1 double, f2 double")
    got = {r["goal"]: r for r in optimum.response_optimum(df, forest.features, forest, split=split, steps=steps).collect()}
    low, high = corners(forest, optimum.search_box(df, forest.features))
    assert np.isclose(got["min"]["value"], low) and np.isclose(got["max"]["value"], high)
    for r in got.values():
        assert np.isclose(forest.score(np.array([[r[f] for f in forest.features]]))[0], r["value"]) and r["f0"] == int(r["f0"])


@pytest.mark.parametrize("d", [10, 12, 20])
def test_jump_of_several_features_is_found(spark, d):
    names = [f"x{k}" for k in range(d)]
    df = spark.createDataFrame([tuple([0.0] * d), tuple([1.0] * d), tuple([0.37] * d)], ", ".join(f"{n} double" for n in names))
    last = names[-4:]
    text = f"CASE WHEN {' AND '.join(f'{n} > 0.95' for n in last)} THEN 50.0 ELSE 0.0 END - ({' + '.join(last)})"
    best = {r["goal"]: r for r in optimum.response_optimum(df, names, trees.formula_predictor(text), generations=14).collect()}["max"]
    assert 46.0 < best["value"] <= 46.2 + 1e-9 and all(best[n] > 0.95 for n in last)


def test_formula_optimum(spark):
    df = spark.createDataFrame([(0, 0.0), (5, 0.5), (10, 1.0)], "whole int, part double")
    text = "(whole - 3) * (whole - 3) + (part - 0.4) * (part - 0.4)"
    out = {r["goal"]: r for r in optimum.response_optimum(df, ["whole", "part"], trees.formula_predictor(text)).collect()}
    assert out["min"]["whole"] == 3.0 and abs(out["min"]["part"] - 0.4) < 1e-4
    assert out["max"]["whole"] == 10.0 and out["max"]["part"] == pytest.approx(1.0)


def test_formula_without_values(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    out = optimum.response_optimum(df, ["x"], trees.formula_predictor("CAST(NULL AS DOUBLE)"), generations=1).collect()
    assert all(r["value"] is None for r in out)
