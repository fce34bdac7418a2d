import numpy as np
import pytest
from pyspark.sql import functions as F

from pathgram.functions import sobol
from pathgram.operators import attribution, formula, sensitivity, trees
from pathgram.operators.prepare import feature_target

FEATURES, TARGET = ["n_orders", "n_lines", "qty"], "revenue"


@pytest.fixture(scope="module")
def table(fx):
    return feature_target(fx, FEATURES, TARGET, ["case_id"])


@pytest.fixture(scope="module")
def fitted(table):
    return trees.train_trees(table, FEATURES, TARGET, "case_id", {"max_depth": [2, 3]}, {"n_estimators": 5, "learning_rate": 0.3}, folds=2)


def test_trees_learn_the_signal(fitted):
    got = {r["part"]: r for r in fitted.validation.collect()}
    assert set(got) == {"train", "test", "cv"} and got["train"]["r2"] > 0.5 and got["cv"]["r2"] > 0.2
    assert abs(sum(r["percent"] for r in fitted.importance.collect()) - 100) < 1e-6
    assert fitted.params["max_depth"] in (2, 3)


def test_attribution_adds_up(table, fitted):
    phi = attribution.shapley(table, FEATURES, fitted.predictor(), "case_id", background=4)
    gap = phi.groupBy("case_id").agg((F.sum("phi") - F.first("prediction") + F.first("baseline")).alias("gap"))
    assert gap.agg(F.max(F.abs("gap"))).first()[0] < 1e-6
    assert abs(attribution.attribution_importance(phi).agg(F.sum("percent")).first()[0] - 100) < 1e-9


def test_sampled_attribution_adds_up(table):
    names = [f"x{k}" for k in range(9)]
    wide = table.select("case_id", *[(F.col("qty") * (k + 1) % 13).alias(n) for k, n in enumerate(names)])
    text = "x0 * x1 + x2 - 2 * x3 + x4 * x8"
    phi = attribution.shapley(wide, names, trees.formula_predictor(text), "case_id", background=2, permutations=6)
    gap = phi.groupBy("case_id").agg((F.sum("phi") - F.first("prediction") + F.first("baseline")).alias("gap"))
    assert gap.agg(F.max(F.abs("gap"))).first()[0] < 1e-9


def test_sobol_of_an_additive_function(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0), (1.0, 1.0, 3.0)], "a double, b double, c double")
    out = sensitivity.sobol(df, ["a", "b", "c"], trees.formula_predictor("a + 2 * b"), 11, resamples=10).filter("power = 11")
    got = {r["feature"]: r for r in out.collect()}
    assert abs(got["a"]["s1"] - 0.2) < 0.02 and abs(got["b"]["st"] - 0.8) < 0.02 and abs(got["c"]["st"]) < 1e-9


def test_coalitions_of_many_features_need_draws(spark):
    names = [f"x{k}" for k in range(13)]
    df = spark.range(2).select("id", *[F.lit(1.0).alias(n) for n in names])
    with pytest.raises(ValueError, match="permutations"):
        attribution.shapley(df, names, trees.formula_predictor("x0"), "id")


def test_sobol_points_equal_the_published_ones(spark):
    # The start of the sequence in Gray-code order, in eighths.
    start = np.array([[0, 0, 0], [4, 4, 4], [6, 2, 2], [2, 6, 6], [3, 3, 5], [7, 7, 1], [5, 1, 7], [1, 5, 3]]) / 8
    assert (np.column_stack([sobol.sobol_points(np.arange(8), k) for k in range(3)]) == start).all()
    for d in range(40):  # every dimension, also beyond the published table: each power of two is met once in each interval
        x = sobol.sobol_points(np.arange(1024), d)
        assert sorted((x * 1024).astype(int)) == list(range(1024)) and (x[:64] * 64 % 1 == 0).all()
    assert len({sobol.directions(d)[:12] for d in range(60)}) == 60
    cols = [sobol.sobol_column(F.col("id"), d, 10).alias(f"x{d}") for d in range(6)]
    got = np.array(spark.range(1024).repartition(5).select("id", *cols).orderBy("id").collect())[:, 1:]
    assert (got == np.column_stack([sobol.sobol_points(np.arange(1024), d) for d in range(6)])).all()


def test_sobol_indices_of_a_published_function(spark):
    """sin x1 + 7 sin^2 x2 + 0.1 x3^4 sin x1 on (-pi, pi), with known indices; half-widths cover the error."""
    df = spark.createDataFrame([(-np.pi,) * 3, (np.pi,) * 3], "x1 double, x2 double, x3 double")
    text = "sin(x1) + 7 * pow(sin(x2), 2) + 0.1 * pow(x3, 4) * sin(x1)"
    out = sensitivity.sobol(df, ["x1", "x2", "x3"], trees.formula_predictor(text), 13, resamples=40)
    want = {"x1": (0.3139, 0.5576), "x2": (0.4424, 0.4424), "x3": (0.0, 0.2437)}
    for r in out.filter("power >= 9").collect():
        for value, width, true in zip((r["s1"], r["st"]), (r["s1_conf"], r["st_conf"]), want[r["feature"]]):
            assert 0 < width < 6 / 2 ** (r["power"] / 2) and abs(value - true) < max(1.5 * width, 0.01)
    last = {r["feature"]: r for r in out.filter("power = 13").collect()}
    assert all(abs(last[f]["s1"] - a) < 0.01 and abs(last[f]["st"] - b) < 0.01 for f, (a, b) in want.items())


def test_directional_impact(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0), (1.0, 1.0, 5.0)], "a double, b double, c double")
    curves = sensitivity.response_curves(df, ["a", "b", "c"], trees.formula_predictor("a * a - sqrt(b + 0.01)"))
    got = {r["feature"]: r for r in sensitivity.directional_impact(curves).collect()}
    assert got["a"]["dominant"] == "accelerating_rise" and got["b"]["dominant"] == "decelerating_fall"
    assert got["c"]["flat"] == 100.0


def test_gradient_equals_numpy(spark):
    y = np.cumsum(np.random.default_rng(1).normal(size=20))
    df = spark.createDataFrame([("f", k, float(v)) for k, v in enumerate(y)], "feature string, step int, y double")
    got = sensitivity.gradient(df, ["feature"], "step", "y", F.lit(0.5), "dy").orderBy("step").toPandas()["dy"]
    assert np.allclose(got, np.gradient(y, 0.5))


def test_formula_front(spark):
    # Complexity and loss of a published nine-formula front.
    front = [(1, 2.5333085), (3, 0.4200054), (5, 0.3142199), (6, 0.23504539), (7, 0.21909466),
             (9, 0.16638306), (10, 0.12577821), (11, 0.08729267), (13, 0.08729266)]
    df = spark.createDataFrame(front + [(8, 0.5)], "complexity int, loss double")
    assert sorted(r["complexity"] for r in formula.pareto_front(df).collect()) == [c for c, _ in front]
