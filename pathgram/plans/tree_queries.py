"""Registered queries of the boosted trees: training, grid, importance, attribution, sensitivity, optimum.

The forest of the quick settings (300 rounds, five folds beside it) is fitted once per application and folder and shared
by the queries that ask for it. The stump queries fit a few rounds of depth one over 16 bins, which SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pathgram.operators import boxes as BX
from pathgram.operators import optimum as OP
from pathgram.operators import sensitivity as SN
from pathgram.operators import trees as TR
from pathgram.operators.boosting import COLUMN_STREAM, GRID, ROW_STREAM
from pathgram.plans import sql as S
from pathgram.plans.nonlinear_queries import FEATURES, FORM, MODEL, TARGET, WITH, modelling
from pathgram.plans.registry import query, r, rounded

_fits: dict[tuple[str, str], TR.TreeFit] = {}


def quick_fit(spark, sf) -> TR.TreeFit:
    key = spark.sparkContext.applicationId, sf
    if key not in _fits:
        _fits[key] = TR.train_trees(modelling(spark, sf), FEATURES, TARGET, "case_id", folds=5)
    return _fits[key]


@query("g01_boosted_trees")
def boosted_trees(spark, sf):
    return rounded(quick_fit(spark, sf).predictions, 4)


@query("g02_grid_search")
def grid_search(spark, sf):
    """All 486 points of the default grid on five folds."""
    fit = TR.train_trees(modelling(spark, sf), FEATURES, TARGET, "case_id", GRID, folds=5)
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(fit.params.items())], "parameter string, chosen string")


@query("g03_cross_validation")
def cross_validation(spark, sf):
    return rounded(quick_fit(spark, sf).validation, 4)


@query("g05_gain_importance")
def gain_importance(spark, sf):
    return rounded(quick_fit(spark, sf).importance, 4)


@query("g06_shapley_trees")
def shapley_trees(spark, sf):
    return rounded(BX.tree_shapley(modelling(spark, sf), quick_fit(spark, sf).model, "case_id"), 3)


@query("g09_sobol_trees")
def sobol_trees(spark, sf):
    return rounded(SN.sobol(modelling(spark, sf), FEATURES, quick_fit(spark, sf).predictor(), 13), 5)


@query("g11_response_optimum_trees")
def response_optimum_trees(spark, sf):
    return rounded(OP.response_optimum(modelling(spark, sf), FEATURES, quick_fit(spark, sf).model), 2)


# --- stumps: the same operators at a size that SQL can follow

STUMP = {"max_depth": 1, "learning_rate": 0.5, "n_estimators": 6, "subsample": 0.8, "colsample_bytree": 0.75, "reg_lambda": 5.0}
BINS, FOLDS = 16, 3
P = "2147483647.0"


def stump_parts() -> str:
    shares = "[" + ", ".join(repr(k / BINS) for k in range(1, BINS)) + "]"
    cuts = " UNION ALL ".join(
        f"SELECT {k} AS f, '{f}' AS feature, unnest(list_distinct(quantile_disc({f}, {shares}))) AS cut, min({f}) AS low FROM pt WHERE NOT test"
        for k, f in enumerate(FEATURES))
    return (f"{S.FX}, {MODEL}, pt AS MATERIALIZED (SELECT *, ({S.lane_sql('case_id', '0', 42)}) / {P} < 0.2 AS test, "
            f"({S.lane_sql('case_id', '1', 42)}) % {FOLDS} AS fold FROM md), cu AS MATERIALIZED (SELECT f, feature, cut FROM ({cuts}) WHERE cut > low)")


def stump_rounds(name: str, left_out: int | None, settings: dict) -> str:
    """CTEs of the rounds: ``{name}t`` has the margins, ``{name}s`` the splits."""
    s = {**STUMP, **settings}
    train = "NOT test" + ("" if left_out is None else f" AND fold <> {left_out}")
    l2, rate, rounds = repr(s["reg_lambda"]), repr(s["learning_rate"]), s["n_estimators"]
    out = [f"{name}m0 AS MATERIALIZED (SELECT pt.*, (SELECT avg(revenue) FROM pt WHERE {train}) AS m FROM pt)"]
    x = "CASE f " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(FEATURES)) + " END"
    wide = max(1, int(s["colsample_bytree"] * len(FEATURES)))
    for t in range(rounds):
        out += [
            f"{name}w{t} AS MATERIALIZED (SELECT *, m - revenue AS g FROM {name}m{t} WHERE {train} AND ({S.lane_sql('case_id', str(t), 42 + ROW_STREAM)}) / {P} < {s['subsample']!r})",
            f"{name}o{t} AS (SELECT f FROM (SELECT unnest(range({len(FEATURES)})) AS f) ORDER BY {S.lane_sql('f', str(t), 42 + COLUMN_STREAM)} LIMIT {wide})",
            f"{name}g{t} AS (SELECT f, feature, cut, sum(g) FILTER ({x} < cut) AS gl, count(*) FILTER ({x} < cut) AS hl, sum(g) AS g, count(*) AS h "
            f"FROM cu, {name}w{t} WHERE f IN (SELECT f FROM {name}o{t}) GROUP BY f, feature, cut)",
            f"{name}b{t} AS MATERIALIZED (SELECT {t} AS t, *, gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2}) AS gain, "
            f"-gl / (hl + {l2}) * {rate} AS below, -(g - gl) / (h - hl + {l2}) * {rate} AS above FROM {name}g{t} WHERE hl >= 1 AND h - hl >= 1 ORDER BY gain DESC, f, cut LIMIT 1)",
            f"{name}m{t + 1} AS MATERIALIZED (SELECT {name}m{t}.* REPLACE (m + CASE WHEN {x} < cut THEN below ELSE above END AS m) FROM {name}m{t}, {name}b{t})",
        ]
    out.append(f"{name}t AS (SELECT * FROM {name}m{rounds})")
    out.append(f"{name}s AS ({' UNION ALL '.join(f'SELECT * FROM {name}b{t}' for t in range(rounds))})")
    return ", ".join(out)


def stump_fit(spark, sf, **settings) -> TR.TreeFit:
    return TR.train_trees(modelling(spark, sf), FEATURES, TARGET, "case_id", None, {**STUMP, **settings}, FOLDS, max_bins=BINS)


STUMPS = f"WITH {stump_parts()}, {stump_rounds('z', None, {})}"


@query("g01_boosted_stumps", STUMPS + " SELECT case_id, CASE WHEN test THEN 'test' ELSE 'train' END AS part, round(revenue, 4) + 0.0 AS actual, round(m, 4) + 0.0 AS prediction FROM zt")
def boosted_stumps(spark, sf):
    return rounded(stump_fit(spark, sf).predictions, 4)


def _held(k: int, name: str) -> str:
    return (f"SELECT {k} AS fold, 1 - sum(power(revenue - m, 2)) / (var_pop(revenue) * count(*)) AS r2, sqrt(avg(power(revenue - m, 2))) AS rmse, "
            f"avg(abs(revenue - m)) AS mae FROM {name}t WHERE NOT test AND fold = {k}")


@query("g03_stump_validation", STUMPS + "".join(f", {stump_rounds(f'k{k}', k, {})}" for k in range(FOLDS))
       + f", cv AS ({' UNION ALL '.join(_held(k, f'k{k}') for k in range(FOLDS))}) "
       f"SELECT 'cv' AS part, {r('avg(r2)')} AS r2, {r('avg(rmse)', 3)} AS rmse, {r('avg(mae)', 3)} AS mae FROM cv UNION ALL "
       f"SELECT CASE WHEN test THEN 'test' ELSE 'train' END, {r('1 - sum(power(revenue - m, 2)) / (var_pop(revenue) * count(*))')}, "
       f"{r('sqrt(avg(power(revenue - m, 2)))', 3)}, {r('avg(abs(revenue - m))', 3)} FROM zt GROUP BY test")
def stump_validation(spark, sf):
    return rounded(stump_fit(spark, sf).validation, rmse=3, mae=3)


GRID_SMALL = {"learning_rate": [0.1, 0.5], "n_estimators": [2, 4], "reg_lambda": [0.0, 50.0]}


def _grid_sql() -> str:
    parts, rows = [], []
    for n, (rate, trees, l2) in enumerate((a, b, c) for a in GRID_SMALL["learning_rate"] for b in GRID_SMALL["n_estimators"] for c in GRID_SMALL["reg_lambda"]):
        parts += [stump_rounds(f"p{n}k{k}", k, {"learning_rate": rate, "n_estimators": trees, "reg_lambda": l2}) for k in range(2)]
        held = " UNION ALL ".join(_held(k, f"p{n}k{k}") for k in range(2))
        rows.append(f"SELECT {n} AS point, {rate!r}::DOUBLE AS learning_rate, {trees} AS n_estimators, {l2!r}::DOUBLE AS reg_lambda, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM ({held})")
    return (f"WITH {stump_parts().replace(f'% {FOLDS} AS fold', '% 2 AS fold')}, {', '.join(parts)}, sc AS ({' UNION ALL '.join(rows)}) "
            f"SELECT learning_rate, n_estimators, reg_lambda, {r('r2')} AS r2, {r('rmse', 3)} AS rmse, {r('mae', 3)} AS mae, "
            "row_number() OVER (ORDER BY r2 DESC, point) = 1 AS chosen FROM sc")


@query("g02_stump_grid", _grid_sql())
def stump_grid(spark, sf):
    """Scores of every point of a small grid, and the choice."""
    points = TR.grid_points(GRID_SMALL, STUMP)
    table = TR.modelling_parts(modelling(spark, sf), FEATURES, TARGET, "case_id", 2, 0.2, 42)
    scores = TR.search_grid(table, FEATURES, TARGET, "case_id", points, 2, 42, BINS)
    best = TR.best_point(scores)
    rows = [(p.learning_rate, p.n_estimators, p.reg_lambda, *map(float, s), k == best) for k, (p, s) in enumerate(zip(points, scores))]
    return rounded(spark.createDataFrame(rows, "learning_rate double, n_estimators int, reg_lambda double, r2 double, rmse double, mae double, chosen boolean"), rmse=3, mae=3)


GAINS = STUMPS + (", im AS (SELECT feature, count(*) AS splits, sum(gain) AS gain, avg(gain) AS mean FROM zs GROUP BY feature), "
                  "sh AS (SELECT n.feature, coalesce(splits, 0) AS splits, coalesce(gain, 0.0) AS gain, 100 * coalesce(mean, 0.0) / (SELECT sum(mean) FROM im) AS percent, "
                  "100 * coalesce(gain, 0.0) / (SELECT sum(gain) FROM im) AS percent_total FROM (SELECT DISTINCT feature FROM cu) n LEFT JOIN im USING (feature))")


@query("g05_stump_gains", GAINS + f" SELECT feature, splits, {r('gain / 1e12')} AS gain, {r('percent')} AS percent, {r('percent_total')} AS percent_total FROM sh")
def stump_gains(spark, sf):
    return rounded(stump_fit(spark, sf).importance.withColumn("gain", F.col("gain") / 1e12))


@query("d07_top_features", GAINS + f" SELECT feature, {r('percent')} AS percent FROM sh ORDER BY percent DESC, feature LIMIT 3")
def top_features(spark, sf):
    return rounded(TR.top_features(stump_fit(spark, sf).importance.select("feature", "percent")))


# A stump's attribution: leaf value, less the mean of both leaves by cover.
PHI = STUMPS + (", le AS (SELECT case_id, feature, sum(CASE WHEN x < cut THEN below ELSE above END - (hl * below + (h - hl) * above) / h) AS phi "
                f"FROM (SELECT case_id, b.*, CASE b.feature {' '.join(f'WHEN {chr(39)}{f}{chr(39)} THEN {f}' for f in FEATURES)} END AS x FROM zt, zs b) GROUP BY case_id, feature), "
                f"lo AS ({' UNION ALL '.join(f'SELECT case_id, {chr(39)}{f}{chr(39)} AS feature, {f} AS value, m AS prediction FROM zt' for f in FEATURES)}), "
                "ba AS (SELECT (SELECT avg(revenue) FROM pt WHERE NOT test) + sum((hl * below + (h - hl) * above) / h) AS baseline FROM zs)")


@query("g06_shapley_stumps", PHI + " SELECT lo.case_id, lo.feature, round(value, 3) + 0.0 AS value, round(coalesce(phi, 0), 3) + 0.0 AS phi, round(prediction, 3) + 0.0 AS prediction, "
       "round(baseline, 3) + 0.0 AS baseline FROM lo LEFT JOIN le ON le.case_id = lo.case_id AND le.feature = lo.feature, ba")
def shapley_stumps(spark, sf):
    return rounded(BX.tree_shapley(modelling(spark, sf), stump_fit(spark, sf).model, "case_id"), 3)


@query("g11_stump_optimum", STUMPS + f"""{''.join(f''', v{k} AS (SELECT x AS {f} FROM (SELECT min({f}) AS x, max({f}) AS hi FROM md UNION ALL
       SELECT {'ceil(cut)' if f != 'acctbal' else 'cut'} AS x, (SELECT max({f}) FROM md) AS hi FROM zs WHERE feature = '{f}') WHERE x <= hi)''' for k, f in enumerate(FEATURES))},
       pv AS (SELECT (SELECT avg(revenue) FROM pt WHERE NOT test) + (SELECT sum(CASE WHEN CASE feature {' '.join(f"WHEN '{f}' THEN {f}" for f in FEATURES)} END < cut THEN below ELSE above END) FROM zs) AS y
              FROM {', '.join(f'v{k}' for k in range(len(FEATURES)))})
       SELECT 'min' AS goal, round(min(y), 2) + 0.0 AS value FROM pv UNION ALL SELECT 'max', round(max(y), 2) + 0.0 FROM pv""")
def stump_optimum(spark, sf):
    found = OP.response_optimum(modelling(spark, sf), FEATURES, stump_fit(spark, sf).model)
    return rounded(found.select("goal", "value"), 2)


@query("g13_predictor_switch", STUMPS + f" SELECT case_id, round({FORM}, 2) + 0.0 AS formula, round(m, 2) + 0.0 AS trees FROM zt")
def predictor_switch(spark, sf):
    """The same table by either predictor."""
    table = modelling(spark, sf)
    out = TR.formula_predictor(FORM)(table).withColumnRenamed("prediction", "formula")
    out = stump_fit(spark, sf).predictor()(out).withColumnRenamed("prediction", "trees")
    return rounded(out.select("case_id", "formula", "trees"), 2)


# The formula grows in every feature that it uses: lowest at the low ends and at no balance, highest at the high ends.
LOW = {"n_orders": "lo_n_orders", "n_lines": "lo_n_lines", "qty": "lo_qty", "acctbal": "greatest(lo_acctbal, least(hi_acctbal, 0.0))"}
HIGH = {"n_orders": "hi_n_orders", "n_lines": "hi_n_lines", "qty": "hi_qty", "acctbal": "CASE WHEN abs(lo_acctbal) > abs(hi_acctbal) THEN lo_acctbal ELSE hi_acctbal END"}
BOX = ", bx AS MATERIALIZED (SELECT " + ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FEATURES) + " FROM md)"


@query("g11_response_optimum", WITH + BOX + " UNION ALL ".join(
    f" SELECT '{goal}' AS goal, round({FORM}, 2) + 0.0 AS value, " + ", ".join(f"round({f}, 1) + 0.0 AS {f}" for f in FEATURES)
    + f" FROM (SELECT {', '.join(f'{v} AS {f}' for f, v in at.items())} FROM bx)" for goal, at in (("min", LOW), ("max", HIGH))))
def response_optimum(spark, sf):
    found = OP.response_optimum(modelling(spark, sf), FEATURES, TR.formula_predictor(FORM))
    return rounded(found, 1, value=2)
