"""Registered queries: path-model estimation and result shaping."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pathgram.operators import ipma as ipma_ops
from pathgram.operators import metrics as metric_ops
from pathgram.operators.fit import fit_by, fit_model
from pathgram.operators.moments import moment_table
from pathgram.operators.prepare import coerce, drop_incomplete, prepare, standardise
from pathgram.plans import sql as S
from pathgram.plans.fixtures import SPEC, customer_indicators
from pathgram.plans.registry import query, rounded
from pathgram.session import materialise
from pathgram.spec import Effect, FitSettings, ModelSpec

# Registered runs iterate to 1e-12 so that both engines agree to the last compared digit.
TIGHT = FitSettings(stop=1e-12)
FORMATIVE_SPEC = ModelSpec(SPEC.constructs, SPEC.paths, modes={"Frequency": "formative", "Value": "formative"})
INTERACTION = ModelSpec(SPEC.constructs, SPEC.paths, effects=[
    Effect("interaction", "FxV", "Value", predictor="Frequency", moderator="Volume")])
QUADRATIC = ModelSpec(SPEC.constructs, SPEC.paths, effects=[Effect("quadratic", "F2", "Value", source="Frequency")])


def single(spark, sf, spec=SPEC, settings=TIGHT, **kw):
    return fit_model(customer_indicators(spark, sf), spec, settings, **kw)


def picked(*names):
    def run(spark, sf):
        return rounded(single(spark, sf).metrics().filter(F.col("metric").isin(*names)))

    return run


# All sixteen flat prefixes except d_G, which needs eigenvalues and is checked by unit test.
SQL_FLAT = ["path", "specific", "loading", "weight", "r2", "radj", "f2", "Cronbach alpha", "Composite reliability",
            "AVE", "rho_A", "htmt", "lvcorr", "total", "total_indirect"]

query("e01_pls_fit", S.metric_sql(SQL_FLAT))(picked(*SQL_FLAT))
query("e02_path_scheme", S.metric_sql(["weight"]))(picked("weight"))
query("e05_mode_a_weights", S.metric_sql(["weight", "loading"]))(picked("weight", "loading"))
query("e11_structural_paths", S.metric_sql(["path"]))(picked("path"))
query("e12_r_square", S.metric_sql(["r2", "radj"]))(picked("r2", "radj"))
query("e13_f_square", S.metric_sql(["f2", "f2_excluded"]))(picked("f2", "f2_excluded"))
query("e14_inner_vif", S.metric_sql(["inner_vif"]))(picked("inner_vif"))
query("e15_outer_vif", S.metric_sql(["outer_vif"]))(picked("outer_vif"))
query("e16_outer_loadings", S.metric_sql(["loading"]))(picked("loading"))
query("e17_cross_loadings", S.metric_sql(["cross_loading"]))(picked("cross_loading"))
query("e18_outer_weights", S.metric_sql(["weight"]))(picked("weight"))
query("e19_cronbach_alpha", S.metric_sql(["Cronbach alpha"]))(picked("Cronbach alpha"))
query("e20_composite_reliability", S.metric_sql(["Composite reliability"]))(picked("Composite reliability"))
query("e21_ave", S.metric_sql(["AVE"]))(picked("AVE"))
query("e22_rho_a", S.metric_sql(["rho_A"]))(picked("rho_A"))
query("e23_fornell_larcker", S.metric_sql(["fornell_larcker"]))(picked("fornell_larcker"))
query("e24_htmt", S.metric_sql(["htmt"]))(picked("htmt"))
query("e25_total_effects", S.metric_sql(["total", "total_indirect"]))(picked("total", "total_indirect"))
query("e26_specific_indirect", S.metric_sql(["specific"]))(picked("specific"))


@query("e03_factor_scheme", S.metric_sql(["weight"], scheme="factor"))
def factor_scheme(spark, sf):
    return rounded(single(spark, sf, settings=replace(TIGHT, scheme="factor")).metrics().filter("metric = 'weight'"))


@query("e04_centroid_scheme", S.metric_sql(["weight"], scheme="centroid"))
def centroid_scheme(spark, sf):
    return rounded(single(spark, sf, settings=replace(TIGHT, scheme="centroid")).metrics().filter("metric = 'weight'"))


@query("e06_mode_b_weights", f"WITH {S.FX}, {S.COMPLETE},{S.correlation_ctes(S.SINGLE_SRC)},{S.weight_ctes(16, formative=('Frequency', 'Value'))} "
       "SELECT 'weight' AS metric, i AS source, lv AS target, i || ' <- ' || lv AS label, round(w, 6) + 0.0 AS value FROM w_last")
def mode_b(spark, sf):
    return rounded(single(spark, sf, FORMATIVE_SPEC).metrics().filter("metric = 'weight'"))


SCORE_CTE = f"""
unit AS (SELECT w.i, w.lv, w.w / sqrt(c.v) / mom.sd AS slope, mom.m FROM w_last w
         JOIN c_end c ON c.s = w.lv AND c.t = w.lv JOIN mom ON mom.i = w.i),
sc AS MATERIALIZED (
  SELECT rid AS case_id, sum(CASE WHEN lv = 'Frequency' THEN (x - m) * slope END) AS f,
         sum(CASE WHEN lv = 'Volume' THEN (x - m) * slope END) AS v,
         sum(CASE WHEN lv = 'Value' THEN (x - m) * slope END) AS a
  FROM long JOIN unit USING (i) GROUP BY rid)"""


@query("e07_latent_scores", S.model_sql(
    "SELECT case_id, round(f, 6) + 0.0 AS \"Frequency\", round(v, 6) + 0.0 AS \"Volume\", "
    "round(a, 6) + 0.0 AS \"Value\" FROM sc", extra=SCORE_CTE))
def latent_scores(spark, sf):
    fx = materialise(customer_indicators(spark, sf).select("case_id", *SPEC.indicators), "cases")
    return rounded(fit_model(fx, SPEC, TIGHT).scores(fx, ["case_id"]))


@query("e08_indicator_tables", f"WITH {S.FX}, {S.COMPLETE} SELECT case_id, " + ", ".join(
    f"round((c.{i} - (SELECT avg({i}) FROM complete)) / (SELECT stddev_samp({i}) FROM complete), 6) + 0.0 AS {i}"
    for i in S.ITEMS) + " FROM complete c")
def standardised_indicators(spark, sf):
    fx = materialise(customer_indicators(spark, sf).select("case_id", *SPEC.indicators), "cases")
    table, _ = prepare(fx, SPEC.indicators, keep=["case_id"])
    return rounded(standardise(table, SPEC.indicators, ["case_id"]))


@query("e08_indicator_correlations", S.model_sql(
    "SELECT a.i AS \"left\", b.i AS \"right\", round(r.v, 6) + 0.0 AS correlation FROM r "
    "JOIN blk a ON a.i = r.i JOIN blk b ON b.i = r.j WHERE a.pos <= b.pos"))
def indicator_correlations(spark, sf):
    table, _ = prepare(customer_indicators(spark, sf), SPEC.indicators)
    return rounded(moment_table(table, SPEC.indicators).select("left", "right", "correlation"))


query("e08_latent_correlations", S.metric_sql(["lvcorr"]))(picked("lvcorr"))


def _three(x: str, y: str, z: str, xy: str, xz: str, yz: str, tx: str, ty: str, tz: str) -> str:
    """Coefficients of a three-predictor regression from correlations (Cramer's rule)."""
    det = f"(1 + 2 * {xy} * {xz} * {yz} - {xy} * {xy} - {xz} * {xz} - {yz} * {yz})"
    bx = f"({tx} * (1 - {yz} * {yz}) + {ty} * ({xz} * {yz} - {xy}) + {tz} * ({xy} * {yz} - {xz})) / {det}"
    by = f"({tx} * ({xz} * {yz} - {xy}) + {ty} * (1 - {xz} * {xz}) + {tz} * ({xy} * {xz} - {yz})) / {det}"
    bz = f"({tx} * ({xy} * {yz} - {xz}) + {ty} * ({xy} * {xz} - {yz}) + {tz} * (1 - {xy} * {xy})) / {det}"
    return f"{bx} AS {x}, {by} AS {y}, {bz} AS {z}"


def _effect_sql(product: str, name: str) -> str:
    three = _three("bv", "bf", "bt", "vf", "vt", "ft", "rav", "raf", "rat")
    extra = f"""{SCORE_CTE},
tm AS (SELECT f, v, a, {product} AS t FROM sc),
cr AS (SELECT corr(v, f) AS vf, corr(v, t) AS vt, corr(f, t) AS ft, corr(a, v) AS rav, corr(a, f) AS raf, corr(a, t) AS rat FROM tm),
be AS (SELECT {three}, vf, rav, raf, rat FROM cr)"""
    final = f"""
SELECT 'path' AS metric, 'Frequency' AS source, 'Volume' AS target, round(vf, 6) + 0.0 AS value FROM be
UNION ALL SELECT 'path', 'Volume', 'Value', round(bv, 6) + 0.0 FROM be
UNION ALL SELECT 'path', 'Frequency', 'Value', round(bf, 6) + 0.0 FROM be
UNION ALL SELECT 'path', '{name}', 'Value', round(bt, 6) + 0.0 FROM be
UNION ALL SELECT 'r2', 'Volume', 'Volume', round(vf * vf, 6) + 0.0 FROM be
UNION ALL SELECT 'r2', 'Value', 'Value', round(bv * rav + bf * raf + bt * rat, 6) + 0.0 FROM be"""
    return S.model_sql(final, extra=extra)


def _effect(spec):
    def run(spark, sf):
        fx = materialise(customer_indicators(spark, sf).select("case_id", *SPEC.indicators), "cases")
        found = fit_model(fx, spec, TIGHT).metrics().filter("metric in ('path', 'r2')")
        return rounded(found.select("metric", "source", "target", "value"))

    return run


query("e09_interaction", _effect_sql("f * v", "FxV"))(_effect(INTERACTION))
query("e10_quadratic", _effect_sql("f * f", "F2"))(_effect(QUADRATIC))


@query("e27_effect_pairs", S.model_sql(
    "SELECT source, target, count(*) FILTER (metric = 'total_indirect') > 0 AS mediated, "
    "round(max(value) FILTER (metric = 'total'), 6) + 0.0 AS total FROM metrics "
    "WHERE metric IN ('total', 'total_indirect') GROUP BY source, target"))
def effect_pairs(spark, sf):
    return rounded(metric_ops.effect_pairs(single(spark, sf).metrics()))


FIT_SQL = S.model_sql("SELECT label, round(value, 6) + 0.0 AS value FROM metrics WHERE metric = 'model_fit'{}")


@query("e28_srmr", FIT_SQL.replace("{}", " AND label = 'SRMR'"))
def srmr(spark, sf):
    return rounded(single(spark, sf).metrics().filter("metric = 'model_fit' and label = 'SRMR'").select("label", "value"))


@query("e29_d_uls", FIT_SQL.replace("{}", " AND label = 'd_ULS'"))
def d_uls(spark, sf):
    return rounded(single(spark, sf).metrics().filter("metric = 'model_fit' and label = 'd_ULS'").select("label", "value"))


@query("e30_d_g")
def d_g(spark, sf):
    return rounded(single(spark, sf).metrics().filter("metric = 'model_fit' and label = 'd_G'").select("label", "value"))


@query("e31_sum_scores", S.metric_sql(["path", "r2", "radj"], equal=True))
def sum_scores(spark, sf):
    return rounded(single(spark, sf, sum_scores=True).metrics().filter(F.col("metric").isin("path", "r2", "radj")))


IPMA_INDEX = ", ".join(
    "(" + " + ".join(
        f"(SELECT w FROM w_last WHERE i = '{i}') * (c.{i} - e.lo_{i}) / (e.hi_{i} - e.lo_{i}) * 100" for i in block
    ) + ") / (" + " + ".join(f"(SELECT w FROM w_last WHERE i = '{i}')" for i in block) + f") AS \"{name}\""
    for name, block in SPEC.constructs.items())
IPMA_ENDS = ", ".join(f"min({i}) AS lo_{i}, max({i}) AS hi_{i}" for i in S.ITEMS)
IPMA_CTE = f"""
ends AS (SELECT {IPMA_ENDS} FROM complete),
idx AS MATERIALIZED (SELECT {IPMA_INDEX} FROM complete c, ends e),
perf AS (SELECT 'Frequency' AS construct, avg("Frequency") AS m, stddev_samp("Frequency") AS sd FROM idx
         UNION ALL SELECT 'Volume', avg("Volume"), stddev_samp("Volume") FROM idx
         UNION ALL SELECT 'Value', avg("Value"), stddev_samp("Value") FROM idx)"""


@query("e32_ipma", S.model_sql(
    "SELECT p.construct, round(m.value * t.sd / p.sd, 6) + 0.0 AS importance, round(p.m, 6) + 0.0 AS performance "
    "FROM perf p JOIN metrics m ON m.metric = 'total' AND m.source = p.construct AND m.target = 'Value' "
    "JOIN perf t ON t.construct = 'Value' WHERE abs(m.value) >= 1e-9 AND p.construct <> 'Value'", extra=IPMA_CTE))
def ipma(spark, sf):
    fx = materialise(customer_indicators(spark, sf).select("case_id", *SPEC.indicators), "cases")
    return rounded(ipma_ops.importance_performance(fx, fit_model(fx, SPEC, TIGHT), "Value"))


@query("e32_ipma_lines", S.model_sql(
    "SELECT round(avg(m.value * t.sd / p.sd), 6) + 0.0 AS mean_importance, round(max(t.m), 6) + 0.0 AS mean_performance "
    "FROM perf p JOIN metrics m ON m.metric = 'total' AND m.source = p.construct AND m.target = 'Value' "
    "JOIN perf t ON t.construct = 'Value' WHERE abs(m.value) >= 1e-9 AND p.construct <> 'Value'", extra=IPMA_CTE))
def ipma_lines(spark, sf):
    fx = materialise(customer_indicators(spark, sf).select("case_id", *SPEC.indicators), "cases")
    model = fit_model(fx, SPEC, TIGHT)
    return rounded(ipma_ops.map_centre(ipma_ops.importance_performance(fx, model, "Value"), ipma_ops.performance(fx, model), "Value"))


@query("e33_flat_metrics", S.model_sql(
    "SELECT metric || ':' || label AS metric, round(value, 6) + 0.0 AS value FROM metrics WHERE label <> 'd_G' AND metric IN ("
    + ", ".join(f"'{m}'" for m in [*SQL_FLAT, "model_fit"]) + ")"))
def flat_metrics(spark, sf):
    return rounded(metric_ops.flat(single(spark, sf).metrics()).filter("metric <> 'model_fit:d_G'"))


MOVED = " UNION ALL ".join(f"SELECT {k + 1} AS step, max(abs(a.w - b.w)) AS moved FROM w_{k + 1} a JOIN w_{k} b ON a.i = b.i" for k in range(8))


@query("e34_convergence", f"WITH {S.FX}, {S.COMPLETE},{S.correlation_ctes(S.SINGLE_SRC)},{S.weight_ctes(8)}, mv AS ({MOVED}) "
       "SELECT 'n_observations' AS label, CAST(count(*) AS DOUBLE) AS value FROM complete "
       f"UNION ALL SELECT 'n_indicators', CAST(count(*) AS DOUBLE) FROM blk UNION ALL SELECT 'max_iterations', {FitSettings().max_iterations}.0 "
       f"UNION ALL SELECT 'iterations', CAST(min(step) AS DOUBLE) FROM mv WHERE moved < {FitSettings().stop!r} "
       f"UNION ALL SELECT 'converged', CASE WHEN min(moved) < {FitSettings().stop!r} THEN 1.0 ELSE 0.0 END FROM mv")
def convergence(spark, sf):
    """The report of a run at the usual stop criterion."""
    fx = materialise(customer_indicators(spark, sf).select("case_id", *SPEC.indicators), "cases")
    found = fit_model(fx, SPEC, FitSettings()).metrics().filter("metric = 'run' and label <> 'stop_criterion'")
    return found.select("label", "value")


@query("e35_fit_per_group", S.metric_sql(["path", "r2", "loading", "htmt"], S.GROUP_SRC, "segment"))
def fit_per_group(spark, sf):
    found = fit_by(customer_indicators(spark, sf), SPEC, ["segment"], TIGHT)
    return rounded(found.filter(F.col("metric").isin("path", "r2", "loading", "htmt")))


VERDICT_SQL = """
SELECT metric, label, CASE
  WHEN metric = 'loading' THEN CASE WHEN abs(value) >= 0.7 THEN 'good' ELSE 'bad' END
  WHEN metric = 'AVE' THEN CASE WHEN value >= 0.5 THEN 'good' ELSE 'bad' END
  WHEN metric IN ('Cronbach alpha', 'rho_A', 'Composite reliability') THEN CASE WHEN value >= 0.7 THEN 'good' ELSE 'bad' END
  WHEN metric IN ('inner_vif', 'outer_vif') THEN CASE WHEN value <= 3 THEN 'good' WHEN value >= 5 THEN 'bad' ELSE 'fair' END
  WHEN metric = 'htmt' THEN CASE WHEN value < 0.85 THEN 'good' WHEN value >= 0.9 THEN 'bad' ELSE 'fair' END
END AS verdict
FROM metrics WHERE metric IN ('loading', 'AVE', 'Cronbach alpha', 'rho_A', 'Composite reliability', 'inner_vif', 'outer_vif', 'htmt')"""


@query("e36_quality_verdicts", S.model_sql(VERDICT_SQL))
def quality_verdicts(spark, sf):
    wanted = ("loading", "AVE", "Cronbach alpha", "rho_A", "Composite reliability", "inner_vif", "outer_vif", "htmt")
    found = metric_ops.with_verdict(single(spark, sf).metrics().filter(F.col("metric").isin(*wanted)))
    return found.select("metric", "label", "verdict")


def _pivot_sql(metric: str, row: str, rows_name: str, columns: str) -> str:
    cols = ", ".join(f"round(max(value) FILTER ({columns} = '{c}'), 6) + 0.0 AS \"{c}\"" for c in SPEC.names)
    return S.model_sql(f"SELECT {row} AS {rows_name}, {cols} FROM metrics WHERE metric = '{metric}' GROUP BY {row}")


def _matrix(metric):
    def run(spark, sf):
        return rounded(metric_ops.matrix(single(spark, sf).metrics(), metric, SPEC.names))

    return run


query("h01_loading_matrix", _pivot_sql("loading", "source", "source", "target"))(_matrix("loading"))
query("h01_weight_matrix", _pivot_sql("weight", "source", "source", "target"))(_matrix("weight"))
query("h01_f_square_matrix", _pivot_sql("f2", "source", "source", "target"))(_matrix("f2"))
query("h01_inner_vif_matrix", _pivot_sql("inner_vif", "source", "source", "target"))(_matrix("inner_vif"))


@query("h02_lower_triangle", S.model_sql(
    "SELECT b AS source, a AS target, round(v, 6) + 0.0 AS value FROM ht"))
def lower_triangle(spark, sf):
    table = metric_ops.symmetric(single(spark, sf).metrics(), "htmt", SPEC.names)
    return rounded(metric_ops.lower_triangle(table, SPEC.names, diagonal=False))


@query("h03_htmt_bars", S.model_sql(
    "SELECT b || '_' || a AS label, round(v, 6) + 0.0 AS value, "
    "CASE WHEN v >= 0.9 THEN 'bad' WHEN v < 0.85 THEN 'good' ELSE 'fair' END AS band FROM ht"))
def htmt_bars(spark, sf):
    return rounded(metric_ops.htmt_bars(single(spark, sf).metrics(), SPEC.names))


@query("h04_report_columns", S.model_sql(
    "SELECT source AS construct, "
    "round(max(value) FILTER (metric = 'Cronbach alpha'), 6) + 0.0 AS cronbachs_alpha, "
    "round(max(value) FILTER (metric = 'rho_A'), 6) + 0.0 AS rho_a, "
    "round(max(value) FILTER (metric = 'Composite reliability'), 6) + 0.0 AS composite_reliability, "
    "round(max(value) FILTER (metric = 'AVE'), 6) + 0.0 AS average_variance_extracted, "
    "round(max(value) FILTER (metric = 'r2'), 6) + 0.0 AS r_square, "
    "round(max(value) FILTER (metric = 'radj'), 6) + 0.0 AS r_square_adjusted "
    "FROM metrics WHERE metric IN ('Cronbach alpha', 'rho_A', 'Composite reliability', 'AVE', 'r2', 'radj') GROUP BY source"))
def report_columns(spark, sf):
    return rounded(metric_ops.construct_report(single(spark, sf).metrics()))
