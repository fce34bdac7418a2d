"""Resampled path models: bootstrap samples, summaries and reports."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import col
from pathgram.functions.distributions import student_tail
from pathgram.functions.draws import BLOCK_CASES, deal, exact_counts
from pathgram.functions.hashing import poisson_array
from pathgram.functions.layout import small_side
from pathgram.functions.ordering import number_cases
from pathgram.operators.algebra import equal_weights, estimate_weights
from pathgram.operators.fit import METRIC_FIELDS, model_rows, rows_frame, usable
from pathgram.operators.metrics import SECTIONS, flat, reportable
from pathgram.operators.moments import Weigher, from_rows, merge_by, replicated_parts
from pathgram.operators.prepare import prepare
from pathgram.session import materialise
from pathgram.spec import FitSettings, ModelSpec

BINS = 24
SAMPLE_SCHEMA = T.StructType([T.StructField("replicate", T.LongType())] + METRIC_FIELDS)


def replicate_metrics(df: DataFrame, spec: ModelSpec, case_id: str, replicates: int, weigher: Weigher | str,
                      settings: FitSettings, wanted: tuple[str, ...] | None = None,
                      sum_scores: bool = False) -> DataFrame:
    """(replicate, metric, source, target, label, value) for every weighting of the same rows.

    ``df`` holds complete cases. Replicates that cannot be fitted are left out.
    """
    items = spec.indicators
    parts = replicated_parts(df, case_id, items, replicates, weigher)
    keep = set(wanted or SECTIONS)

    def rows(key, m, layer=None):
        w = equal_weights(m.correlation(), spec) if sum_scores else None
        found = [r for r in model_rows(m, spec, settings, w, layer) if r[0] in keep and np.isfinite(r[4])]
        return rows_frame(found, replicate=key[0])

    if not spec.usable_effects() or sum_scores:

        def fit(key, pdf):
            m = from_rows(pdf)
            return rows(key, m) if usable(m) else rows_frame([], replicate=key[0])

        return merge_by(parts, ["replicate"], fit, SAMPLE_SCHEMA, replicates)

    # Product terms depend on each replicate's weights, so scores need a second scan. The
    # broadcast table has one row of p x constructs numbers per replicate, whatever the row count.
    parts = materialise(parts, "replicates")
    first_schema = "replicate long, offset array<double>, slope array<double>"

    def stage_one(key, pdf):
        m = from_rows(pdf)
        if not usable(m):
            return pd.DataFrame(columns=["replicate", "offset", "slope"])
        slope = estimate_weights(m.correlation(), spec, settings).unit / m.sd()[:, None]
        return pd.DataFrame([{"replicate": key[0], "offset": -(m.mean @ slope), "slope": slope.ravel()}])

    found = merge_by(parts, ["replicate"], stage_one, first_schema, replicates).collect()
    linear = {r["replicate"]: (np.array(r["offset"]), np.array(r["slope"]).reshape(len(items), -1)) for r in found}
    shared = df.sparkSession.sparkContext.broadcast(linear)
    at = {c: k for k, c in enumerate(spec.names)}
    pairs = [(at[e.factors[0]], at[e.factors[1]]) for e in spec.usable_effects()]
    width = len(spec.analysis_names())

    def derive(x: np.ndarray, number: int) -> np.ndarray:
        if number not in shared.value:
            return np.zeros((len(x), width))
        offset, slope = shared.value[number]
        scores = x @ slope + offset
        return np.column_stack([scores] + [scores[:, a] * scores[:, b] for a, b in pairs])

    layer = replicated_parts(df, case_id, items, replicates, weigher, derive, width)
    both = parts.withColumn("stage", F.lit(1)).unionByName(layer.withColumn("stage", F.lit(2)))

    def fit_both(key, pdf):
        m = from_rows(pdf[pdf["stage"] == 1])
        if not usable(m):
            return rows_frame([], replicate=key[0])
        return rows(key, m, from_rows(pdf[pdf["stage"] == 2]))

    return merge_by(both, ["replicate"], fit_both, SAMPLE_SCHEMA, replicates)


def bootstrap_samples(df: DataFrame, spec: ModelSpec, case_id: str, replicates: int = 500,
                      settings: FitSettings = FitSettings(), wanted: tuple[str, ...] | None = None,
                      sum_scores: bool = False, exact: bool = False) -> DataFrame:
    """Bootstrap distribution of every reportable metric.

    Each case gets a Poisson(1) weight per replicate, drawn from (case, replicate,
    seed), so no replicate needs to know the others' rows and nothing is gathered.
    With ``exact`` every replicate has as many draws as there are cases: cases are numbered in the
    order of their key (unique), and draw i takes case hash(i, replicate) mod the number of cases.
    """
    spec.check(df.columns)
    table, _ = prepare(df, spec.indicators, settings.missing, keep=[case_id])
    seed = settings.seed
    if exact:
        table = materialise(number_cases(table, case_id), "numbered")
        n = table.count()
        weigher = lambda ids, numbers: exact_counts(ids - 1, numbers, n, seed)
        if n > BLOCK_CASES:
            table, weigher = materialise(deal(table, "case_number", n, replicates, seed, "drawn"), "drawn"), "drawn"
        return replicate_metrics(table, spec, "case_number", replicates, weigher, settings, wanted, sum_scores)
    return replicate_metrics(
        table, spec, case_id, replicates, lambda ids, numbers: poisson_array(ids, numbers, seed),
        settings, wanted, sum_scores,
    )


# --------------------------------------------------------------------------
# Summaries
# --------------------------------------------------------------------------
def _bias_corrected(alpha: float) -> Callable:
    """Adjusted lower and upper probability from the share of samples below the original."""
    std = NormalDist()
    ends = (std.inv_cdf(alpha / 2), std.inv_cdf(1 - alpha / 2))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shares(below: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for b, k in zip(below, n):
            if k < 2 or not np.isfinite(b):
                out.append([None, None])
                continue
            z0 = std.inv_cdf(min(max(float(b), 0.5 / k), 1 - 0.5 / k))
            out.append([std.cdf(2 * z0 + z) for z in ends])
        return pd.Series(out)

    return shares


def _interpolated(values: Column, share: Column) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    place = share * (F.size(values) - 1)
    low = F.floor(place)
    a = F.element_at(values, low.cast("int") + 1)
    b = F.element_at(values, F.least(low + 2, F.size(values)).cast("int"))
    return a + (b - a) * (place - low)


def bootstrap_summary(samples: DataFrame, original: DataFrame, confidence: float = 0.95,
                      one_tailed: bool = False) -> DataFrame:
    """One row per flat metric; a group holds one value per replicate, never rows.

    ``samples`` is (replicate, metric, value) and ``original`` (metric, value), both flat.
    """
    alpha = 1 - confidence
    joined = original.withColumnRenamed("value", "original").join(samples, "metric", "left")
    v, o = F.col("value"), F.col("original")
    stats = joined.groupBy("metric", "original").agg(
        F.count(v).alias("valid"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("stdev"),
        F.percentile(v, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ci"),
        F.avg(F.when(v.isNotNull(), (v < o).cast("double"))).alias("below"),
        F.sort_array(F.collect_list(v)).alias("sorted"),
    )
    enough = F.col("valid") >= 2
    t = F.when(enough & (F.col("stdev") > 0), F.abs(o) / F.col("stdev"))
    tail = student_tail(F.col("t_statistic"), F.greatest(F.col("valid") - 1, F.lit(1)).cast("double"))
    shares = _bias_corrected(alpha)(F.col("below"), F.col("valid"))
    return (
        stats.withColumn("t_statistic", t)
        .withColumn("tail", tail)
        .withColumn("share", shares)
        .select(
            "metric", "original",
            F.when(enough, F.col("mean")).alias("mean"),
            F.when(enough, F.col("stdev")).alias("stdev"),
            F.when(enough, F.col("mean") - o).alias("bias"),
            "t_statistic",
            F.when(~F.isnan("tail"), F.col("tail") * (1.0 if one_tailed else 2.0)).alias("p_value"),
            F.when(enough, F.col("ci")[0]).alias("ci_low"),
            F.when(enough, F.col("ci")[1]).alias("ci_high"),
            F.when(enough, _interpolated(F.col("sorted"), F.col("share")[0])).alias("bc_low"),
            F.when(enough, _interpolated(F.col("sorted"), F.col("share")[1])).alias("bc_high"),
            "valid",
        )
    )


def samples_matrix(samples: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """One row per replicate, one column per label of a metric."""
    return (
        samples.filter(F.col("metric") == metric).groupBy("replicate").pivot("label", labels).agg(F.first("value"))
    )


def bootstrap_report(summary: DataFrame) -> DataFrame:
    """Summary rows with their report section and label, in three table shapes stacked by ``shape``."""
    prefix = F.substring_index("metric", ":", 1)
    label = F.expr("substring(metric, length(substring_index(metric, ':', 1)) + 2)")
    section = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])[prefix]
    base = summary.select(section.alias("section"), label.alias("label"), *summary.columns[1:])
    none = F.lit(None).cast("double")

    def shape(name, low, high, t, p):
        return base.select("section", "label", F.lit(name).alias("shape"), "original", "mean", "stdev", "bias",
                           t.alias("t_statistic"), p.alias("p_value"), low.alias("low"), high.alias("high"))

    return (
        shape("stats", none, none, F.col("t_statistic"), F.col("p_value"))
        .unionByName(shape("ci", F.col("ci_low"), F.col("ci_high"), none, none))
        .unionByName(shape("ci_bc", F.col("bc_low"), F.col("bc_high"), none, none))
    )


def histogram(samples: DataFrame, keys: list[str], value: str = "value", bins: int = BINS) -> DataFrame:
    """(keys, bin, low, high, count): equal bins over the observed range, the maximum in the last bin."""
    ends = samples.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_top"))
    ends = ends.withColumn("_hi", F.when(F.col("_top") > F.col("_lo"), F.col("_top")).otherwise(F.col("_lo") + 1e-6))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor((col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return (
        samples.join(small_side(ends), keys).withColumn("bin", place)
        .groupBy(*keys, "bin").agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.count(F.lit(1)).alias("count"))
        .select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"),
                (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "count")
    )


def bootstrap_histograms(samples: DataFrame) -> DataFrame:
    """Samples are written first: their sums may differ in the last digit when computed again, and the ends of the
    bins must belong to the very values that are counted."""
    wanted = materialise(samples.filter(F.col("metric").isin("path", "specific", "total_indirect", "total")), "samples")
    return histogram(wanted, ["metric", "label"])


__all__ = ["bootstrap_samples", "bootstrap_summary", "bootstrap_report", "bootstrap_histograms", "histogram",
           "replicate_metrics", "samples_matrix", "flat", "reportable"]
