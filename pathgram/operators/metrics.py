"""Shaping of the long metric table: flat keys, verdicts, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sixteen reportable metric prefixes and the report section of each.
SECTIONS = {
    "path": "path_coefficients",
    "total_indirect": "total_indirect",
    "specific": "specific",
    "total": "total",
    "loading": "outer_loadings",
    "weight": "outer_weights",
    "r2": "r2",
    "radj": "radj",
    "f2": "f2",
    "AVE": "ave",
    "Composite reliability": "cr",
    "rho_A": "rho_a",
    "Cronbach alpha": "cronbach",
    "htmt": "htmt",
    "lvcorr": "lvcorr",
    "model_fit": "model_fit",
}

# Quality thresholds.
LOADING_MIN, DIAGRAM_LOADING_MIN = 0.7, 0.708
AVE_MIN, RELIABILITY_MIN = 0.5, 0.7
VIF_GOOD, VIF_BAD = 3.0, 5.0
HTMT_GOOD, HTMT_BAD = 0.85, 0.90
SIGNIFICANT, T_CRITICAL = 0.05, 1.96


def reportable(metrics: DataFrame) -> DataFrame:
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return metrics.filter(F.col("metric").isin(*SECTIONS) & finite)


def flat(metrics: DataFrame) -> DataFrame:
    """(metric, value) with metric = ``prefix:label``; only finite values of the sixteen prefixes."""
    return reportable(metrics).select(F.concat_ws(":", "metric", "label").alias("metric"), "value")


def _pass(test: Column) -> Column:
    return F.when(test, "good").otherwise("bad")


def htmt_band(value: Column) -> Column:
    return F.when(value < HTMT_GOOD, "good").when(value >= HTMT_BAD, "bad").otherwise("fair")


def vif_band(value: Column) -> Column:
    return F.when(value <= VIF_GOOD, "good").when(value >= VIF_BAD, "bad").otherwise("fair")


def with_verdict(metrics: DataFrame) -> DataFrame:
    """Adds ``verdict`` (good, fair, bad; NULL where no rule applies)."""
    m, v = F.col("metric"), F.col("value")
    verdict = (
        F.when(v.isNull() | F.isnan(v), None)
        .when(m.isin("loading", "cross_loading"), _pass(F.abs(v) >= LOADING_MIN))
        .when(m == "diagram_loading", _pass(F.abs(v) >= DIAGRAM_LOADING_MIN))
        .when(m == "AVE", _pass(v >= AVE_MIN))
        .when(m.isin("Cronbach alpha", "rho_A", "Composite reliability"), _pass(v >= RELIABILITY_MIN))
        .when(m.isin("inner_vif", "outer_vif"), vif_band(v))
        .when(m == "htmt", htmt_band(v))
        .when(m.isin("q2_predict", "q2_cv"), _pass(v >= 0))
        .when(m.isin("rmse_difference", "mae_difference"), _pass(v < 0))
        .when(m == "p_mga", F.when((v < SIGNIFICANT) | (v > 1 - SIGNIFICANT), "good"))
        .when(m == "p_value", _pass(v < SIGNIFICANT))
        .when(m == "t_statistic", _pass(F.abs(v) >= T_CRITICAL))
    )
    return metrics.withColumn("verdict", verdict)


def matrix(metrics: DataFrame, metric: str, columns: Sequence[str]) -> DataFrame:
    """Source by target in model order; empty cells stay NULL."""
    return metrics.filter(F.col("metric") == metric).groupBy("source").pivot("target", list(columns)).agg(F.first("value"))


def symmetric(metrics: DataFrame, metric: str, names: Sequence[str]) -> DataFrame:
    """Both orders of a symmetric pair metric as (source, target, value)."""
    one = metrics.filter(F.col("metric") == metric).select("source", "target", "value")
    return one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "value"))


def _position(column: str, names: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))


def lower_triangle(table: DataFrame, names: Sequence[str], diagonal: bool) -> DataFrame:
    a, b = _position("source", names), _position("target", names)
    return table.filter(b <= a if diagonal else b < a)


def htmt_bars(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    low = lower_triangle(symmetric(metrics, "htmt", names), names, diagonal=False).filter(F.col("value").isNotNull())
    return low.select(F.concat_ws("_", "source", "target").alias("label"), "value", htmt_band(F.col("value")).alias("band"))


def construct_report(metrics: DataFrame) -> DataFrame:
    names = {
        "Cronbach alpha": "cronbachs_alpha",
        "rho_A": "rho_a",
        "Composite reliability": "composite_reliability",
        "AVE": "average_variance_extracted",
        "r2": "r_square",
        "radj": "r_square_adjusted",
    }
    wide = (
        metrics.filter(F.col("metric").isin(*names))
        .groupBy(F.col("source").alias("construct")).pivot("metric", list(names)).agg(F.first("value"))
    )
    return wide.select("construct", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def effect_pairs(metrics: DataFrame) -> DataFrame:
    """(source, target, mediated, total): which pairs are connected, and how strongly."""
    return (
        metrics.filter(F.col("metric").isin("total", "total_indirect"))
        .groupBy("source", "target")
        .agg(
            F.bool_or(F.col("metric") == "total_indirect").alias("mediated"),
            F.max(F.when(F.col("metric") == "total", F.col("value"))).alias("total"),
        )
    )


def sorted_table(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Numbers by value, text without regard to case, missing last."""
    key = F.lower(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())
