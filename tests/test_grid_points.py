"""Models of a grid on points (rows of equal bins as one) against the same models on rows.

Nodes of a few points may be cut alike by two features, with gains that differ by rounding only; the tables avoid them.
"""

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from pathgram.operators import boosting as BO
from pathgram.operators import trees as TR


def some_rows(n, copies=1, features=3, seed=0):
    rng = np.random.default_rng(seed)
    bins = np.stack([rng.integers(0, 6 + 9 * k, n) for k in range(features)]).astype(np.uint8)
    y = bins[0] * 40.0 + bins[-1] * bins[0] + rng.normal(size=n)
    bins, y = np.tile(bins, copies), np.tile(y, copies) + rng.normal(size=n * copies)
    ids = np.arange(n * copies) * 3 - n
    return ids, bins, y, (np.arange(n * copies) * 7 // 3 % 3).astype(np.int32)


def some_run(bins, y, rate, depth, folds=(0, 1, 2, -1)):
    settings = [BO.Settings(d, a, 0, rate, c, 2.0) for d in {1, depth} for c in (0.5, 1.0) for a in (0.1, 0.6) for _ in folds]
    left_out = np.array(list(folds) * (len(settings) // len(folds)))
    return BO.Run(settings, left_out, np.full(len(settings), y.mean()), [int(b.max()) + 1 for b in bins], 42)


@pytest.mark.parametrize("rate", [0.6, 1.0])
@pytest.mark.parametrize("n, copies, depth", [(300, 1, 3), (60, 9, 3), (900, 3, 5), (900, 1, 8), (1, 40, 2), (25, 1, 2)])
def test_points_grow_the_trees_of_rows(n, copies, depth, rate):
    ids, bins, y, fold = some_rows(n, copies)
    run = some_run(bins, y, rate, depth)
    m = len(run.settings)
    cell = BO.Cell(0, slice(0, m), ids, bins, y, fold, np.repeat(run.base[:, None], len(ids), axis=1))
    points = BO.Points.of(ids, bins, y, fold, run.seed)
    first, last = BO._grow_points(points, run, [2, 7], keep=True)
    cell, _ = BO._rounds(cell, run, 0, 2, ())
    assert first[0] == 2 and np.allclose(first[1], BO._errors(cell, run))
    cell, kept = BO._rounds(cell, run, 2, 5, range(m))
    assert last[0] == 7 and np.allclose(last[1], BO._errors(cell, run))
    assert (points.bins.shape[1] < len(ids)) == (copies > 1 or len(np.unique(bins, axis=1).T) < n)
    for model, rows in kept:
        for one, other in zip(rows, last[2]):
            nodes = one.feature.shape[1]
            assert (one.feature[0] == other.feature[model, :nodes]).all() and (one.bin[0] == other.bin[model, :nodes]).all()
            assert np.allclose(one.value[0], other.value[model, :nodes]) and np.allclose(one.cover[0], other.cover[model, :nodes])


def test_work_of_the_models_does_not_grow_with_copies(monkeypatch):
    """50 copies of a table: as many numbers go into the models' sums as from one copy of which all rows are drawn."""
    seen = []
    plain = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: seen.append(len(x)) or plain(x, *a, **k))
    work = []
    for copies in (1, 50):
        ids, bins, y, fold = some_rows(200, copies)
        seen.clear()
        list(BO._grow_points(BO.Points.of(ids, bins, y, fold, 42), some_run(bins, y, 1.0, 3, (-1,)), [5]))
        work.append(sum(seen))
    assert work[1] <= 1.1 * work[0]


def test_batches_of_few_points_do_not_matter(spark, monkeypatch):
    """Models that do not fit a task at once are grown in turns; a task has models of one depth and share of rows."""
    df = spark.range(500).select("id", (F.col("id") * 7 % 23).cast("double").alias("a"), (F.col("id") * 5 % 11).cast("double").alias("b"),
                                 (F.col("id") * 7 % 23 * (F.col("id") * 5 % 11)).cast("double").alias("y"), (F.col("id") % 4 - 1).cast("int").alias("fold"))
    points = [BO.Settings(d, 0.3, t, s, 1.0, 1.0) for d in (1, 3) for t in (2, 4) for s in (0.8, 1.0)]
    whole = BO.search_grid(df, ["a", "b"], "y", "id", points, 3, 42, 16)
    monkeypatch.setattr(BO, "MARGINS", 1)
    monkeypatch.setattr(BO, "WAVES", 1)
    assert np.allclose(BO.search_grid(df.repartition(7), ["a", "b"], "y", "id", points, 3, 42, 16), whole)
    for tasks in (1, 5, 100):
        dealt = BO._dealt(points, tasks)
        assert sorted(m for batch in dealt for m in batch) == list(range(len(points)))
        assert all(len({(points[m].max_depth, points[m].subsample) for m in batch}) == 1 for batch in dealt)
        assert [points[b[0]].max_depth for b in dealt] == sorted((points[b[0]].max_depth for b in dealt), reverse=True)


def test_final_model_of_a_grid_needs_no_passes(spark, monkeypatch):
    df = spark.range(900).select("id", (F.col("id") * 7 % 83).cast("double").alias("a"), (F.col("id") * 5 % 61).cast("double").alias("b"),
                                 (F.col("id") * 7 % 83 * (F.col("id") * 5 % 61)).cast("double").alias("y"))
    grid = {"max_depth": [1, 3], "n_estimators": [3, 6], "learning_rate": [0.4]}
    table = TR.modelling_parts(df, ["a", "b"], "y", "id", 3, 0.2, 42)
    with monkeypatch.context() as m:
        m.setattr(BO, "Booster", None)
        fit = TR.train_trees(df, ["a", "b"], "y", "id", grid, {"subsample": 0.8}, 3, max_bins=32)
    want, _ = BO.boost(table, ["a", "b"], "y", "id", BO.Settings(**fit.params), 0, 42, 32)
    with monkeypatch.context() as m:
        m.setattr(BO, "ALONE", 10)
        by_passes = BO.fit_point(table, ["a", "b"], "y", "id", BO.Settings(**fit.params), 42, 32)
    for forest in (fit.model, by_passes):
        assert forest.features == want.features and np.isclose(forest.base, want.base)
        assert (forest.feature == want.feature).all() and (forest.cut == want.cut).all()
        assert all(np.allclose(getattr(forest, n), getattr(want, n)) for n in ("value", "cover", "gain"))


def test_chunks_and_wide_bins_do_not_matter(monkeypatch):
    ids, bins, y, fold = some_rows(700, 2)
    bins[:, :350] = bins[:, 350:700]
    run = some_run(bins, y, 0.7, 4)
    (_, whole, _), = BO._grow_points(BO.Points.of(ids, bins, y, fold, run.seed), run, [5])
    monkeypatch.setattr(BO, "CHUNK", 37)
    (_, pieces, _), = BO._grow_points(BO.Points.of(ids, bins, y, fold, run.seed), run, [5])
    (_, wide, _), = BO._grow_points(BO.Points.of(ids, bins.astype(np.int32), y, fold, run.seed), run, [5])
    assert np.allclose(pieces, whole) and np.allclose(wide, whole)


def test_partitions_without_models(spark, monkeypatch):
    """A session may deal the models to more partitions than there are batches."""
    df = spark.range(300).select("id", (F.col("id") * 7 % 23).cast("double").alias("a"), (F.col("id") * 7 % 23 + F.col("id") % 5).cast("double").alias("y"),
                                 (F.col("id") % 3).cast("int").alias("fold"))
    points = [BO.Settings(d, 0.3, 3, 0.8, 1.0, 1.0) for d in (1, 2)]
    whole = BO.search_grid(df, ["a"], "y", "id", points, 3, 42, 16)
    plain = RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, parts, *a, **k: plain(self, max(parts, 40), *a, **k))
    assert np.allclose(BO.search_grid(df, ["a"], "y", "id", points, 3, 42, 16), whole)
    assert BO.fit_point(df, ["a"], "y", "id", points[1], 42, 16).depth == 2
