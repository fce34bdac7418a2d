"""Importance-performance map: one aggregation over weighted 0-100 indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathgram.functions.columns import col
from pathgram.operators.algebra import path_matrix, total_effects
from pathgram.operators.fit import PathModel
from pathgram.operators.prepare import prepare, scaled
from pathgram.spec import ModelError

NEGLIGIBLE = 1e-9


def index_columns(model: PathModel) -> dict:
    """Weighted 0-100 index per construct; ranges come from the fit's own scan."""
    spec, m = model.spec, model.moments
    out = {}
    for lv, (name, block) in enumerate(zip(spec.names, spec.blocks())):
        w = [float(model.weights.raw[i, lv]) for i in block]
        if not any(w):
            w = [1.0] * len(block)
        total = sum(w) or 1.0
        expr = F.lit(0.0)
        for i, share in zip(block, w):
            expr = expr + scaled(col(spec.indicators[i]), m.low[i], m.high[i], 100.0, 50.0) * F.lit(share / total)
        out[name] = expr
    return out


def performance(df: DataFrame, model: PathModel) -> DataFrame:
    """(construct, performance, spread) of the indices."""
    table, _ = prepare(df, model.spec.indicators, model.settings.missing)
    index = table.select(*[e.alias(n) for n, e in index_columns(model).items()])
    return (
        index.unpivot([], [col(n) for n in model.spec.names], "construct", "index")
        .groupBy("construct").agg(F.avg("index").alias("performance"), F.stddev_samp("index").alias("spread"))
    )


def importance_performance(df: DataFrame, model: PathModel, target: str) -> DataFrame:
    """(construct, importance, performance) of every construct that affects ``target``."""
    spec = model.spec
    if target not in spec.constructs:
        raise ModelError(f"unknown target construct '{target}'")
    corr = model.layer.correlation() if model.layer else model.weights.unit.T @ model.moments.correlation() @ model.weights.unit
    effects = total_effects(path_matrix(corr, spec)[0])
    t = spec.analysis_names().index(target)
    rows = [(c, float(effects[k, t])) for k, c in enumerate(spec.names) if c != target and abs(effects[k, t]) >= NEGLIGIBLE]
    effect = df.sparkSession.createDataFrame(rows, "construct string, effect double")
    perf = performance(df, model)
    top = perf.filter(F.col("construct") == target).select(F.col("spread").alias("target_spread"), F.lit(1).alias("one"))
    joined = perf.join(F.broadcast(effect), "construct").withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    scale = F.when(F.col("spread") > 0, F.col("target_spread") / F.col("spread")).otherwise(1.0)
    return joined.select("construct", (F.col("effect") * scale).alias("importance"), "performance")


def map_centre(table: DataFrame, perf: DataFrame, target: str) -> DataFrame:
    """The two mean lines of the map: mean importance, and the target's performance."""
    one = table.agg(F.coalesce(F.avg("importance"), F.lit(0.0)).alias("mean_importance")).withColumn("one", F.lit(1))
    two = perf.filter(F.col("construct") == target).select(F.col("performance").alias("mean_performance"), F.lit(1).alias("one"))
    return one.join(F.broadcast(two), "one").drop("one")
