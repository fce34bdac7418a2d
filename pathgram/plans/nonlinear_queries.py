"""Registered queries: boosted trees, attribution, formulas, sensitivity, optimum."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathgram.functions.sobol import sobol_sql
from pathgram.operators import attribution as AT
from pathgram.operators import formula as FM
from pathgram.operators import sensitivity as SN
from pathgram.operators import trees as TR
from pathgram.operators.prepare import bounds_table, feature_target
from pathgram.plans import sql as S
from pathgram.plans.fixtures import customer_indicators
from pathgram.plans.registry import query, r, rounded
from pathgram.session import materialise

FEATURES, TARGET = ["n_orders", "n_lines", "qty", "acctbal"], "revenue"
FORM = ("25000 + 36000 * n_lines + 2.0 * n_lines * qty + 5 * n_lines * n_lines + 0.05 * qty * qty "
        "+ 30 * n_orders * n_orders + 0.001 * acctbal * acctbal")
CANDIDATES = [(1, "1500000.0"), (3, "52000 * n_lines"), (5, "40000 + 52000 * n_lines"), (7, "1500 * qty + 100 * n_orders"),
              (9, "700 * qty + 26000 * n_lines"), (11, "700 * qty + 26000 * n_lines + square(n_orders)"),
              (12, "log_abs(qty) * 100000 + sqrt_abs(n_lines) * 100000")]


def modelling(spark, sf):
    fx = customer_indicators(spark, sf).select("case_id", *FEATURES, TARGET)
    return materialise(feature_target(fx, FEATURES, TARGET, ["case_id"]), "modelling")


MODEL = "md AS MATERIALIZED (SELECT case_id, n_orders, n_lines, qty, acctbal, revenue FROM fx WHERE n_orders IS NOT NULL AND n_lines IS NOT NULL AND revenue IS NOT NULL)"
WITH = f"WITH {S.FX}, {MODEL}"


@query("g04_prediction_metrics", WITH + f""", pr AS (SELECT revenue AS actual, {FORM} AS prediction,
       CASE WHEN ({S.lane_sql('case_id', '0', 42)}) / 2147483647.0 < 0.2 THEN 'test' ELSE 'train' END AS part FROM md)
       SELECT part, count(*) AS n, {r('1 - sum(power(actual - prediction, 2)) / (var_pop(actual) * count(*))')} AS r2,
       {r('sqrt(avg(power(actual - prediction, 2)))', 2)} AS rmse, {r('avg(abs(actual - prediction))', 2)} AS mae FROM pr GROUP BY part""")
def prediction_metrics(spark, sf):
    from pathgram.operators.prepare import train_test

    scored = TR.formula_predictor(FORM)(train_test(modelling(spark, sf), "case_id"))
    return rounded(TR.regression_metrics(scored, TARGET, keys=["part"]), rmse=2, mae=2)


# For a linear predictor the Shapley value has a closed form: slope x (value - background mean).
LINEAR = "26000 * n_lines + 700 * qty - 50 * n_orders + 3 * acctbal"
SLOPES = {"n_lines": 26000, "qty": 700, "n_orders": -50, "acctbal": 3}
PHI = WITH + f""", bg AS (SELECT * FROM md ORDER BY {S.lane_sql('case_id', '2', 42)}, case_id LIMIT 8),
ph AS MATERIALIZED ({" UNION ALL ".join(f"SELECT case_id, '{f}' AS feature, {f} AS value, {s} * ({f} - (SELECT avg({f}) FROM bg)) AS phi FROM md" for f, s in SLOPES.items())}) """


def linear_attribution(spark, sf):
    return AT.shapley(modelling(spark, sf), FEATURES, TR.formula_predictor(LINEAR), "case_id", background=8)


@query("g06_shapley_values", PHI + "SELECT case_id, feature, round(value, 2) + 0.0 AS value, round(phi, 2) + 0.0 AS phi FROM ph")
def shapley_values(spark, sf):
    return rounded(linear_attribution(spark, sf).select("case_id", "feature", "value", "phi"), 2)


@query("g06_shapley_importance", PHI + "SELECT feature, round(100 * avg(abs(phi)) / (SELECT sum(m) FROM (SELECT avg(abs(phi)) AS m "
       "FROM ph GROUP BY feature)), 6) + 0.0 AS percent FROM ph GROUP BY feature")
def shapley_importance(spark, sf):
    return rounded(AT.attribution_importance(linear_attribution(spark, sf)))


@query("g07_dependence_curve", PHI + ", qs AS (SELECT quantile_cont(value, [" + ", ".join(str(k / 10) for k in range(1, 10))
       + "]) AS q FROM ph WHERE feature = 'acctbal') SELECT CAST(len(list_filter(q, lambda e: e <= value)) AS INT) AS bin, count(*) AS n, "
       "round(avg(value), 3) + 0.0 AS value, round(avg(phi), 3) + 0.0 AS phi FROM ph, qs WHERE feature = 'acctbal' GROUP BY 1")
def dependence_curve(spark, sf):
    phi = materialise(linear_attribution(spark, sf), "attribution")
    return rounded(AT.dependence_curve(phi, "acctbal", 10), 3)


def _plain(text: str) -> str:
    """The formula with its unary operators written out."""
    return (text.replace("square(n_orders)", "(n_orders * n_orders)")
            .replace("log_abs(qty)", "ln(abs(qty) + 1e-8)").replace("sqrt_abs(n_lines)", "sqrt(abs(n_lines))"))


LOSS = ", ls AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT {c} AS complexity, '{t}' AS equation, avg(power(revenue - ({_plain(t)}), 2)) AS loss, var_pop(revenue) AS spread FROM md"
    for c, t in CANDIDATES) + ")"
SCORE = (", sc AS MATERIALIZED (SELECT *, lag(loss) OVER (ORDER BY complexity) AS pl, lag(complexity) OVER (ORDER BY complexity) AS pc, "
         "min(loss) OVER (ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ls)")
SHOW = ("SELECT complexity, equation, round(loss / 1e9, 5) + 0.0 AS loss, round(1 - loss / spread, 6) + 0.0 AS r2, "
        "round(-(ln(loss) - ln(pl)) / (complexity - pc), 6) + 0.0 AS score FROM sc")


def scored(spark, sf):
    return FM.score_formulas(modelling(spark, sf), TARGET, CANDIDATES)


def shown(df):
    return rounded(df.withColumn("loss", F.col("loss") / 1e9), loss=5)


@query("g08_formula_scores", WITH + LOSS + SCORE + SHOW)
def formula_scores(spark, sf):
    return shown(scored(spark, sf))


@query("d05_pareto_front", WITH + LOSS + SCORE + SHOW + " WHERE best IS NULL OR loss < best")
def pareto_front(spark, sf):
    return shown(FM.pareto_front(scored(spark, sf)))


BOX = ", bx AS MATERIALIZED (SELECT " + ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FEATURES) + " FROM md)"
DESIGN = BOX + ", so AS MATERIALIZED (SELECT i, " + ", ".join(
    f"{sobol_sql('i', k, 13)} AS a{k}, {sobol_sql('i', 4 + k, 13)} AS b{k}" for k in range(4)) + " FROM (SELECT unnest(range(8192)) AS i)), sp AS MATERIALIZED (SELECT i, w, " + ", ".join(
    f"lo_{f} + CASE WHEN w = -1 OR w = {k} THEN b{k} ELSE a{k} END * (hi_{f} - lo_{f}) AS {f}"
    for k, f in enumerate(FEATURES)) + " FROM bx, so, (SELECT unnest(range(-2, 4)) AS w))"
SOBOL = DESIGN + f""", yy AS MATERIALIZED (SELECT i, w, {FORM} AS y FROM sp),
wy AS (SELECT i, max(y) FILTER (w = -2) AS a, max(y) FILTER (w = -1) AS b, max(y) FILTER (w = 0) AS y0, max(y) FILTER (w = 1) AS y1,
       max(y) FILTER (w = 2) AS y2, max(y) FILTER (w = 3) AS y3 FROM yy GROUP BY i),
pw AS MATERIALIZED (SELECT p AS power, wy.* FROM wy, (SELECT unnest([5, 7, 9, 11, 13]) AS p) WHERE i < power(2, p)),
ce AS (SELECT power, (avg(a) + avg(b)) / 2 AS c, (avg(a * a) + avg(b * b)) / 2 - power((avg(a) + avg(b)) / 2, 2) AS v FROM pw GROUP BY power),
ix AS MATERIALIZED ({" UNION ALL ".join(
    f"SELECT pw.power, '{f}' AS feature, avg((b - c) * (y{k} - a)) / any_value(v) AS s1, avg(power(a - y{k}, 2)) / 2 / any_value(v) AS st "
    f"FROM pw JOIN ce ON ce.power = pw.power GROUP BY pw.power" for k, f in enumerate(FEATURES))})"""


def sobol_formula(spark, sf):
    return SN.sobol(modelling(spark, sf), FEATURES, TR.formula_predictor(FORM), 13)


@query("g09_sobol_formula", WITH + SOBOL + "SELECT power, feature, round(s1, 5) + 0.0 AS s1, round(st, 5) + 0.0 AS st, "
       "round(st - s1, 5) + 0.0 AS interaction FROM ix")
def sobol_indices(spark, sf):
    return rounded(sobol_formula(spark, sf).select("power", "feature", "s1", "st", "interaction"), 5)


@query("d07_most_sensitive", WITH + SOBOL + "SELECT arg_max(feature, st) AS feature, round(max(st), 5) + 0.0 AS st, "
       "round(sum(st - s1), 5) + 0.0 AS total_interaction FROM ix WHERE power = 13")
def most_sensitive(spark, sf):
    return rounded(SN.most_sensitive(sobol_formula(spark, sf)), 5)


CURVES = BOX + ", cv AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT feature, step, at_, width, {FORM} AS y FROM (SELECT '{f}' AS feature, step, (hi_{f} - lo_{f}) / 99 AS width, "
    f"lo_{f} + step * ((hi_{f} - lo_{f}) / 99) AS at_, " + ", ".join(
        (f"lo_{f} + step * ((hi_{f} - lo_{f}) / 99) AS {g}" if g == f else f"(lo_{g} + hi_{g}) / 2 AS {g}") for g in FEATURES)
    + " FROM bx, (SELECT unnest(range(100)) AS step))" for f in FEATURES) + ")"


def _grad(y: str) -> str:
    o = "OVER (PARTITION BY feature ORDER BY step)"
    return (f"CASE WHEN lag({y}) {o} IS NULL THEN (lead({y}) {o} - {y}) / width WHEN lead({y}) {o} IS NULL THEN ({y} - lag({y}) {o}) / width "
            f"ELSE (lead({y}) {o} - lag({y}) {o}) / (2 * width) END")


GRADS = CURVES + f""", g1 AS MATERIALIZED (SELECT *, {_grad('y')} AS dy FROM cv), g2 AS MATERIALIZED (SELECT *, {_grad('dy')} AS d2 FROM g1),
tl AS (SELECT feature, greatest((max(y) - min(y)) / (max(at_) - min(at_)) * 1e-3, 1e-9) AS tol FROM g2 GROUP BY feature)"""


def curves(spark, sf):
    return SN.response_curves(modelling(spark, sf), FEATURES, TR.formula_predictor(FORM))


@query("d04_numeric_derivatives", WITH + GRADS + "SELECT feature, step, round(dy, 4) + 0.0 AS dy, round(d2, 3) + 0.0 AS d2y FROM g2")
def numeric_derivatives(spark, sf):
    d1 = SN.gradient(curves(spark, sf), ["feature"], "step", "prediction", F.col("width"), "dy")
    d2 = SN.gradient(d1, ["feature"], "step", "dy", F.col("width"), "d2y")
    return rounded(d2.select("feature", F.col("step").cast("long").alias("step"), "dy", "d2y"), 4, d2y=3)


@query("g10_directional_impact", WITH + GRADS + ", sh AS (SELECT g2.feature, "
       "count(*) FILTER (dy > tol AND d2 > 0) / count(*) * 100 AS accelerating_rise, count(*) FILTER (dy > tol AND d2 <= 0) / count(*) * 100 AS decelerating_rise, "
       "count(*) FILTER (dy < -tol AND d2 < 0) / count(*) * 100 AS accelerating_fall, count(*) FILTER (dy < -tol AND d2 >= 0) / count(*) * 100 AS decelerating_fall, "
       "count(*) FILTER (abs(dy) <= tol) / count(*) * 100 AS flat FROM g2 JOIN tl ON tl.feature = g2.feature GROUP BY g2.feature) "
       "SELECT *, CASE greatest(accelerating_rise, decelerating_rise, accelerating_fall, decelerating_fall, flat) WHEN accelerating_rise THEN 'accelerating_rise' "
       "WHEN decelerating_rise THEN 'decelerating_rise' WHEN accelerating_fall THEN 'accelerating_fall' WHEN decelerating_fall THEN 'decelerating_fall' ELSE 'flat' END AS dominant FROM sh")
def directional_impact(spark, sf):
    return SN.directional_impact(curves(spark, sf))


@query("g12_feature_bounds", WITH + " UNION ALL ".join(
    f" SELECT '{f}' AS feature, round(min({f}), 2) + 0.0 AS low, round(max({f}), 2) + 0.0 AS high, count(*) AS n, "
    f"min({f}) = max({f}) AS constant, count(*) < 20 AS few_rows FROM md" for f in FEATURES))
def feature_bounds(spark, sf):
    return rounded(bounds_table(modelling(spark, sf), FEATURES), 2)


@query("g14_r2_tone", WITH + LOSS + "SELECT complexity, CASE WHEN 1 - loss / spread >= 0.75 THEN 'good' WHEN 1 - loss / spread >= 0.5 "
       "THEN 'fair' ELSE 'bad' END AS tone FROM ls")
def r2_tone(spark, sf):
    return scored(spark, sf).select("complexity", TR.tone(F.col("r2")).alias("tone"))
