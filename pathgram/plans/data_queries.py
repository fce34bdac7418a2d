"""Registered queries: sources, preparation, profile, screening, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathgram.operators import metrics as metric_ops
from pathgram.operators import prepare as P
from pathgram.operators import profile as PR
from pathgram.operators import screening as SC
from pathgram.operators.moments import moment_table
from pathgram.functions.ordering import number_cases
from pathgram.plans import sql as S
from pathgram.plans.fixtures import SPEC, customer_indicators, likert_items, table, text_numbers
from pathgram.plans.registry import query, r, rounded
from pathgram.session import materialise, scratch_path
from pathgram.sources import readers, writers

COLS = ["acctbal", *SPEC.indicators]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LIKERT = ["f1", "f2", "v1", "v2"]
TEXT = ["t_lines", "t_orders"]


def cases(spark, sf):
    return materialise(customer_indicators(spark, sf), "cases")


def complete(spark, sf):
    """The cases that have every indicator, as in the SQL; customers without orders or lines are left out."""
    return materialise(customer_indicators(spark, sf).dropna(subset=SPEC.indicators), "cases")


def likert(spark, sf):
    return materialise(likert_items(customer_indicators(spark, sf)), "items")


def text_cases(spark, sf):
    return text_numbers(customer_indicators(spark, sf))


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


NUM = ("TRY_CAST(CASE WHEN regexp_full_match(replace(trim({c}), ',', '.'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
       "THEN replace(trim({c}), ',', '.') END AS DOUBLE)")


# ---- A: sources and sinks ------------------------------------------------------
@query("a01_delimited_auto", with_(S.FX) + f"SELECT case_id, segment, {r('revenue', 2)} AS revenue, n_orders FROM fx")
def delimited_auto(spark, sf):
    path = scratch_path(spark, "csv")
    fx = customer_indicators(spark, sf).select("case_id", "segment", "revenue", "n_orders")
    fx.coalesce(8).write.option("header", True).option("sep", ";").csv(path)
    text, _ = readers.read_delimited(spark, path)
    return rounded(text.select(F.col("case_id").cast("long"), "segment",
                               *P.coerce(text, ["revenue", "n_orders"]).columns)
                   .withColumn("revenue", F.col("revenue").try_cast("double"))
                   .withColumn("n_orders", F.col("n_orders").try_cast("double")), revenue=2)


@query("a02_delimited_decimal_comma", with_(S.FX) + f"SELECT CAST(case_id AS DOUBLE) AS case_id, {r('qty', 2)} AS qty, n_lines FROM fx")
def delimited_decimal(spark, sf):
    path = scratch_path(spark, "csv")
    fx = customer_indicators(spark, sf).select(
        "case_id", F.regexp_replace(F.col("qty").cast("string"), r"\.", ",").alias("qty"), "n_lines")
    fx.write.option("header", True).option("sep", "|").csv(path)
    return rounded(readers.read_numbers(spark, path, "|", ","), qty=2)


@query("a03_header_normalisation", "SELECT l_orderkey AS \"key\", l_linenumber AS key_2, l_quantity AS \"Unnamed\", "
       "l_tax AS key_3 FROM lineitem")
def header_normalisation(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    clean, _ = readers.normalise_headers(df.toDF("﻿key", " key ", "  ", "key"))
    return clean


@query("a04_cleaned_export", with_(S.FX, S.RAW) + f"SELECT case_id, {NUM.format(c='t_lines')} AS t_lines, "
       f"{NUM.format(c='t_orders')} AS t_orders FROM raw")
def cleaned_export(spark, sf):
    path = scratch_path(spark, "clean")
    writers.write_cleaned(text_cases(spark, sf), TEXT, path, "parquet", keep=["case_id"])
    return spark.read.parquet(path)


@query("a05_numeric_coercion", with_(S.FX, S.RAW) + f"SELECT case_id, {NUM.format(c='t_lines')} AS t_lines, "
       f"{NUM.format(c='t_orders')} AS t_orders FROM raw")
def numeric_coercion(spark, sf):
    return P.coerce(text_cases(spark, sf), TEXT, ["case_id"])


@query("a05_coercion_losses", with_(S.FX, S.RAW) + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS before, count({NUM.format(c=c)}) AS \"after\", "
    f"count({c}) - count({NUM.format(c=c)}) AS lost FROM raw" for c in TEXT))
def coercion_losses(spark, sf):
    return P.coercion_losses(text_cases(spark, sf), TEXT)


@query("a06_result_sink", S.model_sql(
    "SELECT 'run-1' AS run_id, metric, label, round(value, 6) + 0.0 AS value FROM metrics WHERE metric IN ('path', 'r2', 'loading')"))
def result_sink(spark, sf):
    from pathgram.plans.model_queries import single

    path = scratch_path(spark, "results")
    writers.write_results(metric_ops.reportable(single(spark, sf).metrics()), path, "run-1")
    saved = spark.read.parquet(path).filter("run_id = 'run-1'").filter(F.col("metric").isin("path", "r2", "loading"))
    return rounded(saved.select(F.col("run_id").cast("string"), "metric", "label", "value"))


# ---- B: projection, filter, missing values ---------------------------------------
@query("b01_column_selection", with_(S.FX) + f"SELECT case_id, n_orders, {r('revenue', 2)} AS revenue FROM fx")
def column_selection(spark, sf):
    return rounded(P.select_columns(customer_indicators(spark, sf), [" n_orders ", "﻿revenue"], ["case_id"]), revenue=2)


RAWN = f"rawn AS (SELECT case_id, {NUM.format(c='t_lines')} AS t_lines, {NUM.format(c='t_orders')} AS t_orders FROM raw)"
CASEWISE = with_(S.FX, S.RAW, RAWN) + "SELECT * FROM rawn WHERE t_lines IS NOT NULL AND t_orders IS NOT NULL"


@query("b02_casewise_deletion", CASEWISE)
def casewise(spark, sf):
    return P.prepare(text_cases(spark, sf), TEXT, "casewise", ["case_id"])[0]


@query("b03_mean_imputation", with_(S.FX, S.RAW, RAWN) + "SELECT case_id, "
       + ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM rawn)), 6) + 0.0 AS {c}" for c in TEXT) + " FROM rawn")
def mean_imputation(spark, sf):
    return rounded(P.prepare(text_cases(spark, sf), TEXT, "mean", ["case_id"])[0])


@query("b04_pairwise_as_casewise", CASEWISE)
def pairwise(spark, sf):
    return P.prepare(text_cases(spark, sf), TEXT, "pairwise", ["case_id"])[0]


@query("b05_guards", with_(S.FX, S.COMPLETE) + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) AS n_complete, {r(f'min({c})', 2)} AS low, {r(f'max({c})', 2)} AS high, "
    f"CASE WHEN count(*) = 0 THEN 'no_complete_rows' WHEN min({c}) = max({c}) THEN 'zero_variance' ELSE 'ok' END AS verdict "
    f"FROM complete" for c in SPEC.indicators))
def guards(spark, sf):
    return rounded(P.guard_table(customer_indicators(spark, sf), SPEC.indicators), 2)


@query("b06_standardise", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round((t.{c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem), 6) + 0.0 AS {c}" for c in LINE)
       + " FROM lineitem t")
def standardise(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(P.standardise(df, LINE, ["l_orderkey", "l_linenumber"]))


@query("b07_preview", with_(S.FX) + f"SELECT case_id, n_orders, {r('revenue', 2)} AS revenue FROM fx ORDER BY case_id LIMIT 500")
def preview(spark, sf):
    return rounded(P.preview(customer_indicators(spark, sf).select("case_id", "n_orders", "revenue"), "case_id"), revenue=2)


@query("b08_two_groups", with_(S.FX) + "SELECT case_id, CASE segment WHEN 'BUILDING' THEN 'a' ELSE 'b' END AS side, n_orders "
       "FROM fx WHERE segment IN ('BUILDING', 'MACHINERY')")
def two_groups(spark, sf):
    pair = P.group_pair(customer_indicators(spark, sf), "segment", "BUILDING", "MACHINERY")
    return pair.select("case_id", "side", "n_orders")


FEATURES, TARGET = ["n_orders", "n_lines", "qty", "acctbal"], "revenue"


@query("b09_feature_target", with_(S.FX) + "SELECT case_id, n_orders, n_lines, qty, acctbal, "
       f"{r('revenue', 2)} AS revenue FROM fx WHERE n_orders IS NOT NULL AND n_lines IS NOT NULL AND revenue IS NOT NULL")
def feature_target(spark, sf):
    return rounded(P.feature_target(customer_indicators(spark, sf), FEATURES, TARGET, ["case_id"]), revenue=2, qty=6)


U0 = f"({S.lane_sql('case_id', '0', 42)}) / 2147483647.0"


@query("b10_train_test", f"SELECT c_custkey AS case_id, CASE WHEN ({S.lane_sql('c_custkey', '0', 42)}) / 2147483647.0 < 0.2 "
       "THEN 'test' ELSE 'train' END AS part FROM customer")
def train_test(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    return P.train_test(df, "case_id")


def _range_sql(top: float) -> str:
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round((t.{c} - e.lo_{c}) / (e.hi_{c} - e.lo_{c}) * {top}, 6) + 0.0 AS {c}" for c in LINE
    ) + " FROM lineitem t, (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINE) + " FROM lineitem) e"


@query("b11_rescale_percent", _range_sql(100.0))
def rescale_percent(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(P.rescale_percent(df, LINE, ["l_orderkey", "l_linenumber"]))


@query("b12_normalise_unit", _range_sql(1.0))
def normalise_unit(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(P.normalise_unit(df, LINE, ["l_orderkey", "l_linenumber"]))


# ---- C: moments, profile, screening ------------------------------------------------
def _pairs_sql(source: str, columns, digits: int = 6) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, round(avg({a}), 3) + 0.0 AS mean_left, "
        f"round(avg({b}), 3) + 0.0 AS mean_right, round(stddev_samp({a}), 3) + 0.0 AS sd_left, "
        f"round(stddev_samp({b}), 3) + 0.0 AS sd_right, "
        + (f"1.0" if a == b else f"round(corr({a}, {b}), 6) + 0.0") + f" AS correlation FROM {source}"
        for i, a in enumerate(columns) for b in columns[i:]
    )


@query("c01_moments", _pairs_sql("lineitem", LINE))
def moments_lineitem(spark, sf):
    out = moment_table(table(spark, sf, "lineitem").select(*LINE), LINE).drop("covariance")
    return rounded(out, mean_left=3, mean_right=3, sd_left=3, sd_right=3)


@query("c01_moments_by_group", " UNION ALL ".join(
    f"SELECT l_returnflag, '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, "
    + ("1.0" if a == b else f"round(corr({a}, {b}), 6) + 0.0") + " AS correlation FROM lineitem GROUP BY l_returnflag"
    for i, a in enumerate(LINE) for b in LINE[i:]))
def moments_grouped(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", *LINE)
    return rounded(moment_table(df, LINE, ["l_returnflag"]).select("l_returnflag", "left", "right", "n", "correlation"))


def _stats_cte(source: str, columns, name: str = "st") -> str:
    body = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) AS total, count({c}) AS n, avg({c}) AS mean, "
        f"CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, stddev_samp({c}) AS sd, skewness({c}) AS skew, "
        f"kurtosis({c}) AS kurt, count(DISTINCT {c}) AS d, "
        f"bool_and(abs({c} - round_even({c}, 0)) <= 1e-8 + 1e-5 * abs(round_even({c}, 0))) AS whole, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}" for c in columns)
    return f"{name} AS MATERIALIZED ({body})"


TYPE_SQL = ("CASE WHEN n = 0 THEN 'unknown' WHEN d <= 2 THEN 'binary' WHEN d <= 10 AND whole THEN 'ordinal' ELSE 'metric' END")


@query("c02_profile", with_(_stats_cte("lineitem", LINE)) +
       f"SELECT variable, {TYPE_SQL} AS scale_type, total - n AS missing, (total - n) / CAST(total AS DOUBLE) AS missing_rate, "
       f"{r('mean', 3)} AS mean, {r('med', 3)} AS median, {r('low', 3)} AS low, {r('high', 3)} AS high, {r('sd', 3)} AS sd, "
       f"{r('skew')} AS skew, {r('kurt')} AS kurt, variable = 'l_tax' AS used, (total - n) / CAST(total AS DOUBLE) >= 0.2 AS high_missing, "
       "n > 1 AND low = high AS zero_variance FROM st")
def profile_lineitem(spark, sf):
    out = PR.profile(table(spark, sf, "lineitem"), LINE, used=["l_tax"]).drop("scale_hint")
    return rounded(out, mean=3, median=3, low=3, high=3, sd=3)


@query("c02_profile_text", with_(S.FX, S.RAW, RAWN, _stats_cte("rawn", TEXT)) +
       f"SELECT variable, {TYPE_SQL} AS scale_type, total - n AS missing, {r('mean', 5)} AS mean, {r('med', 5)} AS median, "
       f"{r('sd', 5)} AS sd, {r('skew', 5)} AS skew, {r('kurt', 5)} AS kurt FROM st")
def profile_text(spark, sf):
    out = PR.profile(materialise(text_cases(spark, sf), "text"), TEXT)
    return rounded(out.select("variable", "scale_type", "missing", "mean", "median", "sd", "skew", "kurt"), 5)


@query("c03_scale_type", with_(S.FX, S.LIK, _stats_cte("lik", LIKERT), _stats_cte("lineitem", LINE, "st2")) +
       f"SELECT variable, {TYPE_SQL} AS scale_type FROM st UNION ALL SELECT variable, {TYPE_SQL} FROM st2")
def scale_type(spark, sf):
    one = PR.column_stats(likert(spark, sf), LIKERT, quartiles=False)
    two = PR.column_stats(table(spark, sf, "lineitem"), LINE, quartiles=False)
    return one.unionByName(two).select("variable", PR.scale_type().alias("scale_type"))


@query("c04_scale_hint", with_(S.FX, S.LIK, _stats_cte("lik", LIKERT), _stats_cte("lineitem", LINE, "st2"),
                               "u AS (SELECT * FROM st UNION ALL SELECT * FROM st2)") +
       "SELECT variable, CASE WHEN low >= 1 AND high <= 5 THEN '1-5' WHEN low >= 1 AND high <= 7 THEN '1-7' "
       "WHEN low >= 0 AND high <= 10 THEN '0-10' ELSE printf('%g', low) || '-' || printf('%g', high) END AS scale_hint FROM u")
def scale_hint(spark, sf):
    one = PR.column_stats(likert(spark, sf), LIKERT, quartiles=False)
    two = PR.column_stats(table(spark, sf, "lineitem"), LINE, quartiles=False)
    return one.unionByName(two).select("variable", PR.scale_hint().alias("scale_hint"))


@query("c05_totals", with_(S.FX, S.RAW) + "SELECT count(*) AS rows, CAST(2 AS BIGINT) AS columns, "
       "CAST(count(*) FILTER (t_lines IS NULL) + count(*) FILTER (t_orders IS NULL) AS BIGINT) AS missing_cells FROM raw")
def totals(spark, sf):
    return PR.dataset_totals(text_cases(spark, sf), TEXT)


PCT = "(total - n) / CAST(total AS DOUBLE) * 100"


@query("c06_missing_table", with_(S.FX, S.RAW, RAWN, _stats_cte("rawn", TEXT)) +
       f"SELECT variable, n AS valid, total - n AS missing, {r(PCT, 2)} AS missing_percent, CASE WHEN {PCT} <= 0 THEN 'complete' "
       f"WHEN {PCT} <= 5 THEN 'mean_substitution' WHEN {PCT} <= 10 THEN 'multiple_imputation' "
       "ELSE 'drop_or_multiple_imputation' END AS recommendation FROM st")
def missing_table(spark, sf):
    return rounded(SC.missing_table(PR.column_stats(text_cases(spark, sf), TEXT, quartiles=False)), 2)


@query("c07_descriptives", with_(S.FX, S.LIK, _stats_cte("lik", LIKERT)) + "SELECT variable, n, "
       + ", ".join(f"{r(c, 3)} AS {c}" for c in ("mean", "sd", "low", "high", "skew", "kurt")) + " FROM st")
def descriptives(spark, sf):
    return rounded(SC.descriptives(PR.column_stats(likert(spark, sf), LIKERT, quartiles=False)), 3)


@query("c08_corrected_moments", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {r(f'skewness({c})')} AS skew, {r(f'kurtosis({c})')} AS kurt FROM lineitem" for c in LINE))
def corrected_moments(spark, sf):
    return rounded(PR.basic_stats(table(spark, sf, "lineitem"), LINE).select("variable", "skew", "kurt"))


@query("c10_z_outliers", with_(S.FX, S.COMPLETE, _stats_cte("complete", COLS)) + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, (SELECT count(*) FROM complete, st WHERE variable = '{c}' AND abs({c} - mean) / sd > 3.29) AS z_outliers"
    for c in COLS))
def z_outliers(spark, sf):
    df = complete(spark, sf)
    return SC.outlier_counts(df, PR.column_stats(df, COLS)).select("variable", "z_outliers")


@query("c11_iqr_outliers", with_(S.FX, S.COMPLETE, _stats_cte("complete", COLS)) + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, "
    f"(SELECT count(*) FROM complete, st WHERE variable = '{c}' AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS iqr_mild, "
    f"(SELECT count(*) FROM complete, st WHERE variable = '{c}' AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1))) AS iqr_severe"
    for c in COLS))
def iqr_outliers(spark, sf):
    df = complete(spark, sf)
    return SC.outlier_counts(df, PR.column_stats(df, COLS)).select("variable", "iqr_mild", "iqr_severe")


@query("c12_out_of_scale", with_(S.FX, S.LIK) + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) FILTER ({c} < 1 OR {c} > 5) AS out_of_scale FROM lik" for c in LIKERT))
def out_of_scale(spark, sf):
    df = likert(spark, sf)
    return SC.outlier_counts(df, PR.column_stats(df, LIKERT)).select("variable", "out_of_scale")


FLAG_SQL = with_(S.FX, S.LIK, _stats_cte("lik", LIKERT), "fl AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, case_id, row_number() OVER (ORDER BY case_id) AS k FROM lik, st "
    f"WHERE variable = '{c}' AND (abs({c} - mean) / sd > 3.29 OR {c} < 1 OR {c} > 5)" for c in LIKERT) + ")")


@query("c13_flagged_cases", FLAG_SQL +
       "SELECT variable, count(*) AS flagged, string_agg('Case ' || case_id, ', ' ORDER BY case_id) FILTER (k <= 6) || "
       "CASE WHEN count(*) > 6 THEN ' (+' || (count(*) - 6) || ')' ELSE '' END AS cases FROM fl GROUP BY variable")
def flagged_cases(spark, sf):
    df = likert(spark, sf)
    return SC.flagged_cases(df, "case_id", PR.column_stats(df, LIKERT))


def _note_sql(source: str, columns, scale: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CASE WHEN {f'count(*) FILTER ({c} < 1 OR {c} > 5) > 0' if scale else 'false'} THEN 'entry_error' "
        f"WHEN count(*) FILTER (q3 <> q1 AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1))) > 0 THEN 'extreme_values' "
        f"WHEN count(*) FILTER (abs({c} - mean) / sd > 3.29) > 0 OR count(*) FILTER (q3 <> q1 AND ({c} < q1 - 1.5 * (q3 - q1) "
        f"OR {c} > q3 + 1.5 * (q3 - q1))) > 0 THEN 'mild_outliers' ELSE 'normal' END AS note FROM {source}, st WHERE variable = '{c}'"
        for c in columns)


@query("c13_outlier_notes", with_(S.FX, S.LIK, _stats_cte("lik", LIKERT)) + _note_sql("lik", LIKERT, True))
def outlier_notes(spark, sf):
    df = likert(spark, sf)
    return SC.outlier_counts(df, PR.column_stats(df, LIKERT)).select("variable", "note")


@query("c14_pairwise_correlations", with_(S.FX, S.RAW, RAWN, "j AS (SELECT t_lines, t_orders, acctbal, n_supp FROM rawn JOIN fx USING (case_id))")
       + " UNION ALL ".join(
           f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
           + ("1.0" if a == b else f"round(corr({a}, {b}), 6) + 0.0") + " AS correlation FROM j"
           for i, a in enumerate(["t_lines", "t_orders", "acctbal", "n_supp"])
           for b in ["t_lines", "t_orders", "acctbal", "n_supp"][i:]))
def pairwise_correlations(spark, sf):
    fx = cases(spark, sf)
    joined = text_numbers(fx).drop("segment").join(fx.select("case_id", "acctbal", "n_supp"), "case_id")
    out = PR.correlation_matrix(joined, ["t_lines", "t_orders", "acctbal", "n_supp"])
    return rounded(out.select("left", "right", "n", "correlation"))


@query("c15_strongest_pair", with_(S.FX) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) + 0.0 AS correlation FROM fx"
    for i, a in enumerate(COLS) for b in COLS[i + 1:]) + ") ORDER BY abs(correlation) DESC LIMIT 1")
def strongest_pair(spark, sf):
    return rounded(PR.strongest_pair(cases(spark, sf), COLS))


@query("c16_normality_verdict", with_(S.FX, S.COMPLETE, _stats_cte("complete", SPEC.indicators)) +
       "SELECT variable, test, CASE WHEN p > 0.05 THEN 'normal' WHEN abs(skew) <= 2 AND abs(kurt) <= 7 THEN 'acceptable' ELSE 'review' END AS verdict "
       "FROM st, (SELECT 'passed' AS test, 0.2 AS p UNION ALL SELECT 'edge', 0.05 UNION ALL SELECT 'failed', 0.001 UNION ALL SELECT 'not tested', NULL)")
def normality_verdict(spark, sf):
    """The rule for every outcome of the test, which has its own query."""
    stats = PR.column_stats(complete(spark, sf), SPEC.indicators, quartiles=False)
    outcomes = F.array(*[F.struct(F.lit(n).alias("test"), F.lit(p).cast("double").alias("p")) for n, p in (
        ("passed", 0.2), ("edge", 0.05), ("failed", 0.001), ("not tested", None))])
    stats = stats.withColumn("o", F.explode(outcomes))
    return stats.select("variable", "o.test", SC.normality_verdict(F.col("skew"), F.col("kurt"), F.col("o.p")).alias("verdict"))


@query("c16_normality_table")
def normality_table(spark, sf):
    df = cases(spark, sf)
    return SC.normality_table(df, PR.column_stats(df, COLS, quartiles=False))


@query("c17_shapiro_wilk")
def shapiro(spark, sf):
    df = cases(spark, sf)
    return rounded(SC.shapiro_table(df, PR.column_stats(df, COLS, quartiles=False)))


# The normal distribution function by Simpson's rule over 100 panels, and the limit law of the distance (60,000 cases).
PHI = ("0.5 + z / 300 / sqrt(2 * pi()) * list_sum(list_transform(range(101), lambda k: "
       "(CASE WHEN k = 0 OR k = 100 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(z * k / 100, 2) / 2)))")
KS_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c}::DOUBLE AS v, count(*) AS c FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}" for c in LINE)


@query("c18_kolmogorov_smirnov", with_(_stats_cte("lineitem", LINE)) + f"""SELECT variable, {r('d')} AS d,
       {r('least(1, greatest(0, list_sum(list_transform(range(1, 60), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * n * d * d)))))')} AS p
  FROM (SELECT variable, any_value(n) AS n, max(greatest(upto / n - f, f - (upto - c) / n)) AS d FROM (
    SELECT variable, c, n, sum(c) OVER (PARTITION BY variable ORDER BY z) AS upto, {PHI} AS f FROM (
      SELECT x.variable, x.c, st.n::DOUBLE AS n, (x.v - st.mean) / st.sd AS z FROM ({KS_CELLS}) x JOIN st ON st.variable = x.variable)) GROUP BY variable)""")
def kolmogorov(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(SC.ks_table(df, PR.column_stats(df, LINE, quartiles=False)))


@query("c19_screening_summary", with_(S.FX, S.LIK, _stats_cte("lik", LIKERT), f"nt AS ({_note_sql('lik', LIKERT, True)})") +
       "SELECT max(total) AS rows, count(*) AS variables, CAST(sum(total - n) AS BIGINT) AS missing_cells, "
       f"max({r(PCT, 2)}) AS max_missing_percent, count(*) FILTER (total > n) AS variables_with_missing, "
       f"{r('min(mean)')} AS mean_low, {r('max(mean)')} AS mean_high, {r('min(sd)')} AS sd_low, {r('max(sd)')} AS sd_high, "
       "(SELECT count(*) FROM nt WHERE note <> 'normal') AS outlier_variables, "
       "(SELECT count(*) FROM nt WHERE note = 'entry_error') AS entry_error_variables, "
       "count(*) FILTER (NOT (abs(skew) <= 2 AND abs(kurt) <= 7)) AS non_normal, "
       "coalesce(string_agg(variable, ', ' ORDER BY variable) FILTER (NOT (abs(skew) <= 2 AND abs(kurt) <= 7)), '') AS non_normal_variables FROM st")
def screening_summary(spark, sf):
    df = likert(spark, sf)
    stats = PR.column_stats(df, LIKERT)
    return rounded(SC.summary(df, stats, SC.normality_table(df, stats)))


@query("c20_grouping_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), '|') AS groups FROM lineitem "
    f"HAVING count(DISTINCT CAST({c} AS VARCHAR)) BETWEEN 2 AND 20"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_discount")))
def grouping_columns(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_discount")
    out = PR.grouping_columns(df, df.columns)
    return out.select("variable", F.concat_ws("|", "groups").alias("groups"))


# ---- D: order, limits ---------------------------------------------------------------
@query("d01_extreme_values", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, '{side}' AS side, row_number() OVER (ORDER BY {c} {d}, l_orderkey * 10 + l_linenumber {d}) AS rank, "
    f"round({c}, 2) + 0.0 AS value, l_orderkey * 10 + l_linenumber AS case_id FROM lineitem"
    for c in LINE for side, d in (("low", "ASC"), ("high", "DESC"))) + ") WHERE rank <= 5")
def extreme_values(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("case_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(PR.extremes(df, "case_id", LINE).withColumn("rank", F.col("rank").cast("long")), 2)


@query("d02_case_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS case_number FROM orders")
def case_numbers(spark, sf):
    return number_cases(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("d03_result_sort", S.metric_sql(["loading"]))
def result_sort(spark, sf):
    from pathgram.plans.model_queries import single

    found = single(spark, sf).metrics().filter("metric = 'loading'")
    return metric_ops.sorted_table(rounded(found), "value", descending=True)
