"""Comparison of two groups: multi-group analysis and permutation test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathgram.functions.columns import col
from pathgram.functions.cuts import at_or_below, rank_cuts
from pathgram.functions.distributions import student_tail
from pathgram.functions.hashing import lane_array, poisson_array
from pathgram.operators.fit import fit_by
from pathgram.operators.prepare import check_group_sizes, group_pair, prepare
from pathgram.operators.resample import replicate_metrics
from pathgram.session import materialise
from pathgram.spec import FitSettings, ModelError, ModelSpec

PATHS = ("path",)


def group_samples(pair: DataFrame, spec: ModelSpec, case_id: str, replicates: int, settings: FitSettings) -> DataFrame:
    """(side, replicate, label, value): bootstrap paths of both sides, seeds s and s + 1."""
    out = None
    for offset, side in enumerate(("a", "b")):
        rows, _ = prepare(pair.filter(F.col("side") == side), spec.indicators, settings.missing, keep=[case_id])
        seed = settings.seed + offset
        part = replicate_metrics(rows, spec, case_id, replicates,
                                 lambda ids, numbers, seed=seed: poisson_array(ids, numbers, seed), settings, PATHS)
        part = part.select(F.lit(side).alias("side"), "replicate", "label", "value")
        out = part if out is None else out.unionByName(part)
    return out


def share_a_not_above_b(samples: DataFrame) -> DataFrame:
    """(label, p_mga): share of (a, b) pairs with a <= b, by a running count instead of pairing."""
    order = W.partitionBy("label").orderBy(F.col("value"), F.col("side")).rowsBetween(W.unboundedPreceding, 0)
    is_a = (F.col("side") == "a").cast("long")
    ranked = samples.withColumn("a_upto", F.sum(is_a).over(order))
    return ranked.groupBy("label").agg(
        (F.avg(F.when(F.col("side") == "b", F.col("a_upto"))) / F.sum(is_a)).alias("p_mga")
    )


def observed_paths(pair: DataFrame, spec: ModelSpec, settings: FitSettings) -> DataFrame:
    """(label, beta_a, beta_b, n_a, n_b)."""
    found = fit_by(pair, spec, ["side"], settings)
    sizes = found.filter((F.col("metric") == "run") & (F.col("label") == "n_observations")).select(
        "side", F.col("value").alias("n"))
    paths = found.filter(F.col("metric") == "path").join(sizes, "side")

    def pick(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return paths.groupBy("label").agg(pick("a", "value").alias("beta_a"), pick("b", "value").alias("beta_b"),
                                      pick("a", "n").alias("n_a"), pick("b", "n").alias("n_b"))


def two_tailed(t: Column, df: Column) -> Column:
    tail = student_tail(F.abs(t), df) * 2
    return F.when(~F.isnan(tail), tail)


def difference_tests(observed: DataFrame, spread: DataFrame) -> DataFrame:
    """Pooled-variance and Welch tests from path estimates and bootstrap standard errors."""
    table = observed.join(spread, "label", "left")
    sa, sb, na, nb = (F.col(c) for c in ("se_a", "se_b", "n_a", "n_b"))
    diff = F.col("beta_a") - F.col("beta_b")
    both = na + nb - 2
    pooled = F.sqrt((na - 1) * (na - 1) / both * sa * sa + (nb - 1) * (nb - 1) / both * sb * sb) * F.sqrt(1 / na + 1 / nb)
    joint = sa * sa + sb * sb
    welch_df = joint * joint / (F.pow(sa, F.lit(4.0)) / (na - 1) + F.pow(sb, F.lit(4.0)) / (nb - 1))
    usable = (sa > 0) & (sb > 0)
    return (
        table.withColumn("difference", diff)
        .withColumn("t_parametric", F.when(usable, diff / pooled)).withColumn("df_parametric", both)
        .withColumn("t_welch", F.when(usable, diff / F.sqrt(joint))).withColumn("df_welch", F.when(usable, welch_df))
        .withColumn("p_parametric", two_tailed(F.col("t_parametric"), F.col("df_parametric")))
        .withColumn("p_welch", two_tailed(F.col("t_welch"), F.col("df_welch")))
    )


def _pair(df: DataFrame, spec: ModelSpec, case_id: str, group: str, first: str, second: str) -> DataFrame:
    """Both groups as one written table, as several passes read it."""
    pair = group_pair(df, group, first, second)
    return materialise(pair.select("side", *[col(c) for c in dict.fromkeys([case_id, *spec.indicators])]), "groups-pair")


def multi_group(df: DataFrame, spec: ModelSpec, case_id: str, group: str, first: str, second: str,
                replicates: int = 300, settings: FitSettings = FitSettings()) -> DataFrame:
    """One row per path: estimates of both groups, difference and three p values."""
    spec.check(df.columns)
    if not spec.paths:
        raise ModelError("a group comparison needs a structural model")
    pair = _pair(df, spec, case_id, group, first, second)
    check_group_sizes(pair)
    samples = materialise(group_samples(pair, spec, case_id, replicates, settings), "groups-samples")  # each replicate is fitted once
    spread = samples.groupBy("label").agg(
        F.stddev_samp(F.when(F.col("side") == "a", F.col("value"))).alias("se_a"),
        F.stddev_samp(F.when(F.col("side") == "b", F.col("value"))).alias("se_b"),
    )
    tested = difference_tests(observed_paths(pair, spec, settings), spread)
    return tested.join(share_a_not_above_b(samples), "label", "left")


def permutation_samples(df: DataFrame, spec: ModelSpec, case_id: str, group: str, first: str, second: str,
                        permutations: int, settings: FitSettings) -> tuple[DataFrame, DataFrame]:
    """(replicate, label, difference) and the observed paths."""
    spec.check(df.columns)
    pair = _pair(df, spec, case_id, group, first, second)
    check_group_sizes(pair)
    table, _ = prepare(pair, spec.indicators, settings.missing, keep=[case_id], keys=["side"])
    sizes = {r["side"]: r["count"] for r in table.groupBy("side").count().collect()}
    if min(sizes.get("a", 0), sizes.get("b", 0)) == 0:
        raise ModelError("no complete rows left in one group")
    cuts = rank_cuts(table, case_id, sum(sizes.values()), permutations, [sizes["a"]], settings.seed)[:, 0]
    seed = settings.seed

    def sides(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Replicate 2k is side a of permutation k, 2k + 1 its side b."""
        which, place = np.unique(numbers // 2, return_inverse=True)
        in_a = at_or_below(lane_array(ids, which, seed), ids, cuts[which])
        return np.where(numbers % 2 == 0, in_a[:, place], ~in_a[:, place]).astype(float)

    fitted = replicate_metrics(table, spec, case_id, 2 * permutations, sides, settings, PATHS)
    half = fitted.withColumn("permutation", F.floor(F.col("replicate") / 2)).groupBy("permutation", "label").agg(
        F.max(F.when(F.col("replicate") % 2 == 0, F.col("value"))).alias("a"),
        F.max(F.when(F.col("replicate") % 2 == 1, F.col("value"))).alias("b"),
    )
    return half.select("permutation", "label", (F.col("a") - F.col("b")).alias("difference")), observed_paths(pair, spec, settings)


def permutation_test(df: DataFrame, spec: ModelSpec, case_id: str, group: str, first: str, second: str,
                     permutations: int = 300, settings: FitSettings = FitSettings()) -> DataFrame:
    """One row per path; p is the share of permutations at least as far apart as observed."""
    samples, observed = permutation_samples(df, spec, case_id, group, first, second, permutations, settings)
    seen = observed.withColumn("difference", F.col("beta_a") - F.col("beta_b"))
    joined = samples.withColumnRenamed("difference", "permuted").join(seen, "label")
    reached = (F.abs("permuted") >= F.abs("difference")).cast("double")
    return joined.groupBy("label", "beta_a", "beta_b", "difference").agg(
        F.avg(reached).alias("p_permutation"), F.count("permuted").alias("permutations"))
