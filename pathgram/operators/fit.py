"""Path-model estimation: one scan for the moments, then one small fit per model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import col
from pathgram.functions.layout import small_side
from pathgram.operators.algebra import (
    Weights, equal_weights, estimate_weights, measurement_rows, structural_rows,
)
from pathgram.operators.moments import Moments, from_rows, merge_by, moment_parts, moments, unpack
from pathgram.operators.prepare import prepare
from pathgram.spec import FitSettings, ModelError, ModelSpec

METRIC_FIELDS = [
    T.StructField("metric", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("value", T.DoubleType()),
]
METRIC_SCHEMA = T.StructType(METRIC_FIELDS)


def guard(m: Moments, spec: ModelSpec) -> None:
    if not m.n >= 2:
        raise ModelError("no complete rows left")
    flat = [i for i, lo, hi in zip(spec.indicators, m.low, m.high) if lo == hi]
    if flat:
        raise ModelError("zero variance: " + ", ".join(flat))


def unfit(m: Moments) -> str:
    """Why a group or replicate cannot be fitted; empty if it can.

    An indicator is constant when its smallest and largest value agree, or when all its spread is
    rounding: replicates share the table's smallest and largest values.
    """
    if not m.n >= 2:
        return "fewer than two complete rows"
    if not np.all(np.isfinite(m.scatter)):
        return "values out of range"
    rounding = m.n * (1e-13 * np.abs(m.mean)) ** 2
    constant = np.diag(m.scatter) <= rounding
    if m.low is not None and m.high is not None:
        constant = constant | (np.asarray(m.low) == np.asarray(m.high))
    return f"{int(constant.sum())} constant indicators" if constant.any() else ""


def usable(m: Moments) -> bool:
    return not unfit(m)


def skipped(m: Moments) -> list[tuple]:
    """The row that stands for a group without a model."""
    return [("run", "skipped", "skipped", unfit(m), 1.0)]


def model_rows(m: Moments, spec: ModelSpec, settings: FitSettings, weights: Weights | None = None,
               layer: Moments | None = None) -> list[tuple]:
    """All metric rows of one model. ``layer`` holds the moments of scores and product terms."""
    r = m.correlation()
    w = weights or estimate_weights(r, spec, settings)
    score_corr = layer.correlation() if layer is not None else w.unit.T @ r @ w.unit
    run = {
        "iterations": float(w.iterations),
        "converged": float(w.converged),
        "n_observations": m.n,
        "n_indicators": float(len(r)),
        "max_iterations": float(settings.max_iterations),
        "stop_criterion": settings.stop,
    }
    return (
        structural_rows(score_corr, m.n, spec)
        + measurement_rows(r, w, spec)
        + [("run", k, k, k, v) for k, v in run.items()]
    )


def rows_frame(rows: list[tuple], **extra) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[f.name for f in METRIC_FIELDS])
    out["value"] = out["value"].astype(float)
    for at, (k, v) in enumerate(extra.items()):
        out.insert(at, k, v)
    return out


# --------------------------------------------------------------------------
# One model
# --------------------------------------------------------------------------
@dataclass
class PathModel:
    """A fitted model: p x p numbers on the driver, rows stay in Spark."""

    spec: ModelSpec
    settings: FitSettings
    moments: Moments
    weights: Weights
    layer: Moments | None
    warnings: list[str]
    spark: SparkSession

    def metrics(self) -> DataFrame:
        rows = model_rows(self.moments, self.spec, self.settings, self.weights, self.layer)
        clean = [(a, b, c, d, None if v is None or np.isnan(v) else float(v)) for a, b, c, d, v in rows]
        return self.spark.createDataFrame(clean, METRIC_SCHEMA)

    def score_columns(self) -> dict[str, Column]:
        """Standardised construct scores as linear expressions of the raw indicators."""
        mean, sd = self.moments.mean, self.moments.sd()
        out = {}
        for lv, (name, block) in enumerate(zip(self.spec.names, self.spec.blocks())):
            terms = [
                (col(self.spec.indicators[i]) - F.lit(float(mean[i]))) * F.lit(float(self.weights.unit[i, lv] / sd[i]))
                for i in block
            ]
            expr = terms[0]
            for t in terms[1:]:
                expr = expr + t
            out[name] = expr
        return out

    def scores(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Construct and product-term scores per row; a projection, no shuffle."""
        table, _ = prepare(df, self.spec.indicators, self.settings.missing, keep)
        table = table.select(*[col(k) for k in keep], *[e.alias(n) for n, e in self.score_columns().items()])
        for k, e in enumerate(self.spec.usable_effects(), start=len(self.spec.names)):
            a, b = e.factors
            term = (col(a) * col(b) - F.lit(float(self.layer.mean[k]))) / F.lit(float(self.layer.sd()[k]))
            table = table.withColumn(e.name, term)
        return table


def fit_model(df: DataFrame, spec: ModelSpec, settings: FitSettings = FitSettings(),
              sum_scores: bool = False) -> PathModel:
    notes = spec.check(df.columns)
    table, more = prepare(df, spec.indicators, settings.missing)
    m = collect_moments(table, spec.indicators)
    if m is None:
        raise ModelError("no complete rows left")
    guard(m, spec)
    r = m.correlation()
    w = equal_weights(r, spec) if sum_scores else estimate_weights(r, spec, settings)
    model = PathModel(spec, settings, m, w, None, notes + more, df.sparkSession)
    if spec.usable_effects() and not sum_scores:
        scored = table.select(*[e.alias(n) for n, e in model.score_columns().items()])
        for e in spec.usable_effects():
            a, b = e.factors
            scored = scored.withColumn(e.name, col(a) * col(b))
        model.layer = collect_moments(scored, spec.analysis_names())
    return model


def collect_moments(table: DataFrame, columns: Sequence[str]) -> Moments | None:
    """Merge in Spark, bring one p x p row to the driver."""
    found = moments(table, columns).collect()  # one row, or none without complete cases
    if not found:
        return None
    row = found[0]
    p = len(columns)
    return Moments(row["n"], np.array(row["mean"]), unpack(np.array(row["scatter"]), p),
                   np.array(row["low"]), np.array(row["high"]))


# --------------------------------------------------------------------------
# One model per key
# --------------------------------------------------------------------------
def fit_by(df: DataFrame, spec: ModelSpec, keys: Sequence[str], settings: FitSettings = FitSettings(),
           sum_scores: bool = False) -> DataFrame:
    """A model per key value. Lazy: scan, per-task moments, one small shuffle, one fit per key."""
    spec.check(df.columns)
    keys = list(keys)
    table, _ = prepare(df, spec.indicators, settings.missing, keys=keys)
    parts = moment_parts(table, spec.indicators, keys)
    key_fields = [table.schema[k] for k in keys]
    schema = T.StructType(key_fields + METRIC_FIELDS)

    def fit(key, pdf):
        m = from_rows(pdf)
        if not usable(m):
            return rows_frame(skipped(m), **dict(zip(keys, key)))
        w = equal_weights(m.correlation(), spec) if sum_scores else None
        return rows_frame(model_rows(m, spec, settings, w), **dict(zip(keys, key)))

    if not spec.usable_effects() or sum_scores:
        return merge_by(parts, keys, fit, schema)

    # Product terms: score the rows with their group's weights, then a second moment pass.
    p, names = len(spec.indicators), spec.names
    weight_schema = T.StructType(key_fields + [T.StructField("offset", T.ArrayType(T.DoubleType())),
                                               T.StructField("slope", T.ArrayType(T.DoubleType()))])

    def stage_one(key, pdf):
        m = from_rows(pdf)
        if not usable(m):
            return pd.DataFrame(columns=[f.name for f in weight_schema])
        slope = estimate_weights(m.correlation(), spec, settings).unit / m.sd()[:, None]
        return pd.DataFrame([{**dict(zip(keys, key)), "offset": -(m.mean @ slope), "slope": slope.ravel()}])

    scored = table.join(small_side(merge_by(parts, keys, stage_one, weight_schema)), keys)
    size = len(names)
    columns = []
    for lv, (name, block) in enumerate(zip(names, spec.blocks())):
        expr = F.element_at("offset", lv + 1)
        for i in block:
            expr = expr + F.element_at("slope", i * size + lv + 1) * col(spec.indicators[i])
        columns.append(expr.alias(name))
    scored = scored.select(*[col(k) for k in keys], *columns)
    for e in spec.usable_effects():
        a, b = e.factors
        scored = scored.withColumn(e.name, col(a) * col(b))
    layer_parts = moment_parts(scored, spec.analysis_names(), keys)

    def both(key, first, second):
        m = from_rows(first)
        if not usable(m) or second.empty:
            return rows_frame(skipped(m), **dict(zip(keys, key)))
        return rows_frame(model_rows(m, spec, settings, None, from_rows(second)), **dict(zip(keys, key)))

    return parts.groupBy(*keys).cogroup(layer_parts.groupBy(*keys)).applyInPandas(both, schema)
