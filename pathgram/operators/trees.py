"""Boosted-tree regression: training, validation, grid search, importance, prediction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathgram.functions.columns import col
from pathgram.functions.hashing import lane
from pathgram.operators.boosting import GRID, MAX_BINS, Forest, Settings, boost, fit_point, search_grid
from pathgram.operators.prepare import feature_target, train_test
from pathgram.session import discard, materialise

Predictor = Callable[[DataFrame], DataFrame]

# The tone of R squared.
TONE_GOOD, TONE_FAIR = 0.75, 0.5


def formula_predictor(formula: str | Column) -> Predictor:
    expr = F.expr(formula) if isinstance(formula, str) else formula
    return lambda df: df.withColumn("prediction", expr.cast("double"))


def regression_metrics(df: DataFrame, actual: str, predicted: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, r2, rmse, mae) in one aggregation."""
    error = col(actual) - col(predicted)
    spread = F.var_pop(col(actual)) * F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(spread > 0, 1 - F.sum(error * error) / spread).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )


def tone(r2: Column) -> Column:
    return F.when(r2 >= TONE_GOOD, "good").when(r2 >= TONE_FAIR, "fair").otherwise("bad")


@dataclass
class TreeFit:
    model: Forest
    features: list[str]
    target: str
    params: dict
    validation: DataFrame  # part, r2, rmse, mae: train, test and the fold mean
    predictions: DataFrame  # case_id, part, actual, prediction
    importance: DataFrame  # feature, splits, gain, percent (of mean gain a split), percent_total (of total gain)

    def predictor(self) -> Predictor:
        return self.model.predictor()


def modelling_parts(df: DataFrame, features: Sequence[str], target: str, case_id: str, folds: int, test_share: float, seed: int) -> DataFrame:
    """Complete rows with part (train, test) and fold of the training part (-1 elsewhere)."""
    table = train_test(feature_target(df, features, target, [case_id]), case_id, test_share, seed)
    fold = F.when(F.col("part") == "train", (lane(col(case_id), 1, seed) % max(1, folds)).cast("int")).otherwise(-1)
    return materialise(table.withColumn("fold", fold), "tree-parts")


def grid_points(grid: dict, params: dict | None = None) -> list[Settings]:
    return [Settings(**{**(params or {}), **dict(zip(grid, values))}) for values in product(*grid.values())]


def best_point(scores: np.ndarray) -> int:
    """The first point with the largest mean R squared."""
    return int(np.where(np.isnan(scores[:, 0]), -np.inf, scores[:, 0]).argmax())


def train_trees(df: DataFrame, features: Sequence[str], target: str, case_id: str, grid: dict | None = None,
                params: dict | None = None, folds: int = 5, test_share: float = 0.2, seed: int = 42, max_bins: int = MAX_BINS) -> TreeFit:
    """Fit on the training part. With a grid every point is validated on key-hashed folds and the best by R squared is
    fitted; without one the folds grow beside the model."""
    features, spark = list(features), df.sparkSession
    table = modelling_parts(df, features, target, case_id, folds, test_share, seed)
    settings = Settings(**(params or {}))
    if grid:
        points = grid_points(grid, params)
        scores = search_grid(table, features, target, case_id, points, folds, seed, max_bins)
        at = best_point(scores)
        settings, cv = points[at], scores[at]
        forest = fit_point(table, features, target, case_id, settings, seed, max_bins)
    else:
        forest, by_fold = boost(table, features, target, case_id, settings, folds, seed, max_bins)
        cv = by_fold.mean(axis=0)
    scored = forest.predictor()(table).select(col(case_id).alias("case_id"), "part", col(target).alias("actual"), "prediction")
    predictions = materialise(scored, "tree-predictions")
    discard(table)
    rows = [("cv", *(None if np.isnan(v) else float(v) for v in cv))]
    rows += [(r["part"], r["r2"], r["rmse"], r["mae"]) for r in regression_metrics(predictions, "actual", keys=["part"]).collect()]
    return TreeFit(forest, features, target, asdict(settings), spark.createDataFrame(rows, "part string, r2 double, rmse double, mae double"),
                   predictions, gain_importance(spark, forest))


def gain_importance(spark, forest: Forest) -> DataFrame:
    """(feature, splits, gain, percent, percent_total); unused features have zeros."""
    gains = forest.gains()
    means = [g / n if n else 0.0 for _, n, g in gains]
    of_means, of_all = sum(means) or 1.0, sum(g for *_, g in gains) or 1.0
    rows = [(f, n, g, 100.0 * m / of_means, 100.0 * g / of_all) for (f, n, g), m in zip(gains, means)]
    return spark.createDataFrame(rows, "feature string, splits long, gain double, percent double, percent_total double")


def top_features(importance: DataFrame, value: str = "percent", k: int = 3) -> DataFrame:
    """The k strongest features; the table has one row per feature."""
    return importance.orderBy(F.col(value).desc(), "feature").limit(k)


__all__ = ["GRID", "Forest", "Settings", "TreeFit", "best_point", "formula_predictor", "gain_importance", "grid_points", "modelling_parts",
           "regression_metrics", "tone", "top_features", "train_trees"]
