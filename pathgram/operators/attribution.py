"""Shapley attribution as a scoring job over any predictor."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathgram.functions.columns import col
from pathgram.functions.hashing import lane_array
from pathgram.functions.ordering import bucket_of, exact_quantiles
from pathgram.operators.trees import Predictor

#: Features up to which all coalitions are listed; beyond, orders are drawn. Trees need neither: see ``boxes.tree_shapley``.
MOST_EXACT = 12


def coalition_design(d: int, permutations: int | None = None, seed: int = 42) -> dict[int, list[float]]:
    """mask -> coefficient per feature, so that phi = sum over masks of coefficient x value.

    Exact over all 2^d coalitions; with ``permutations``, an estimate from the prefixes of that many hashed orders.
    """
    design: dict[int, list[float]] = {}
    if permutations is None:
        if d > MOST_EXACT:
            raise ValueError(f"{d} features have too many coalitions; give the number of permutations")
        for size in range(d + 1):
            for members in combinations(range(d), size):
                mask = sum(1 << i for i in members)
                design[mask] = [
                    factorial(size - 1) * factorial(d - size) / factorial(d) if i in members
                    else -factorial(size) * factorial(d - size - 1) / factorial(d)
                    for i in range(d)
                ]
        return design
    import numpy as np

    order = np.argsort(lane_array(np.arange(d), np.arange(permutations), seed), axis=0)
    for k in range(permutations):
        mask = 0
        for i in order[:, k]:
            for m, sign in ((mask, -1.0), (mask | 1 << int(i), 1.0)):
                design.setdefault(m, [0.0] * d)[int(i)] += sign / permutations
            mask |= 1 << int(i)
    return design


def background_rows(df: DataFrame, features: Sequence[str], case_id: str, size: int, seed: int = 42) -> list[list[float]]:
    """A small fixed reference sample: the cases with the smallest hash."""
    from pathgram.functions.hashing import lane

    rows = df.select(*[col(f).cast("double").alias(f) for f in features], lane(col(case_id), 2, seed).alias("_h"), col(case_id).alias("_k"))
    return [list(r[: len(features)]) for r in rows.orderBy("_h", "_k").limit(size).collect()]


def shapley(df: DataFrame, features: Sequence[str], predictor: Predictor, case_id: str,
            background: int = 16, permutations: int | None = None, seed: int = 42) -> DataFrame:
    """(case_id, feature, value, phi, prediction, baseline); phi sums to prediction - baseline.

    Rows are expanded to coalitions in place and scored by one transform; the sums per
    case are map-side aggregated, so one row per case is shuffled.
    """
    features = list(features)
    design = coalition_design(len(features), permutations, seed)
    masks = sorted(design)
    rows = background_rows(df, features, case_id, background, seed)
    size = len(rows)
    base = F.array(*[F.struct(*[F.lit(float(v)).alias(f"b{k}") for k, v in enumerate(r)]) for r in rows])
    wide = (
        df.select(col(case_id).alias("case_id"), *[col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)])
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
        .withColumn("base", F.explode(base))
    )
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("slot") + 1)
    mixed = wide.select(
        "case_id", "slot", *[f"_x{k}" for k in range(len(features))],
        *[F.when(mask.bitwiseAND(1 << k) != 0, F.col(f"_x{k}")).otherwise(F.col(f"base.b{k}")).alias(f)
          for k, f in enumerate(features)],
    )
    full, empty = masks.index((1 << len(features)) - 1), masks.index(0)
    scored = predictor(mixed)
    value = F.col("prediction") / size

    def weighted(k: int):
        table = F.array(*[F.lit(design[m][k]) for m in masks])
        return F.sum(F.element_at(table, F.col("slot") + 1) * value)

    sums = scored.groupBy("case_id").agg(
        *[weighted(k).alias(f"phi{k}") for k in range(len(features))],
        *[F.first(f"_x{k}").alias(f"_x{k}") for k in range(len(features))],
        F.sum(F.when(F.col("slot") == full, value)).alias("prediction"),
        F.sum(F.when(F.col("slot") == empty, value)).alias("baseline"),
    )
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"_x{k}").alias("value"), F.col(f"phi{k}").alias("phi"))
        for k, f in enumerate(features)
    ])
    return sums.select("case_id", "prediction", "baseline", F.inline(cells))


def attribution_importance(phi: DataFrame) -> DataFrame:
    """(feature, percent): 100 x mean |phi| over its total."""
    mean = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("strength"))
    total = mean.agg(F.sum("strength").alias("total")).withColumn("_one", F.lit(1))
    share = F.when(F.col("total") > 0, 100 * F.col("strength") / F.col("total")).otherwise(0.0)
    return mean.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("feature", share.alias("percent"))


def dependence_curve(phi: DataFrame, feature: str, bins: int = 20) -> DataFrame:
    """(bin, n, value, phi): means within equal-share ranges of the feature, cut at exact quantiles."""
    one = phi.filter(F.col("feature") == feature).select("value", "phi")
    cuts = exact_quantiles(one, ["value"], [k / bins for k in range(1, bins)])["value"]
    edges = sorted({c for c in cuts if c is not None})
    return one.groupBy(bucket_of(F.col("value"), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"), F.avg("phi").alias("phi"))


__all__ = ["attribution_importance", "coalition_design", "dependence_curve", "shapley"]
