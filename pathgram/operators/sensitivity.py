"""Variance-based sensitivity and directional impact of a predictor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathgram.functions.columns import col
from pathgram.functions.hashing import poisson_weight
from pathgram.functions.sobol import sobol_column
from pathgram.operators.profile import whole_number
from pathgram.operators.trees import Predictor

POWERS = (5, 7, 9, 11, 13)
GRID_POINTS = 100
CONFIDENCE_Z = 1.959963984540054
RESAMPLES = 100
WIDTH = 1e-6  # of the box in a constant feature


def box(df: DataFrame, features: Sequence[str]) -> list[tuple[float, float, bool]]:
    """Observed (low, high, whole-numbered) per feature; one scan."""
    row = df.agg(*[f.alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (
        ("l", F.min(col(c))), ("h", F.max(col(c))), ("w", F.bool_and(whole_number(col(c)))))]).first()
    return [(float(row[f"l{k}"]), float(row[f"h{k}"]), bool(row[f"w{k}"])) for k in range(len(features))]


def alphas(dimensions: int) -> list[float]:
    """Steps of the additive recurrence: powers of the generalised golden ratio."""
    phi = 2.0
    for _ in range(60):
        phi = (1.0 + phi) ** (1.0 / (dimensions + 1))
    return [(1.0 / phi) ** (k + 1) % 1.0 for k in range(dimensions)]


def low_discrepancy(index: Column, alpha: float) -> Column:
    x = F.lit(0.5) + (index + 1).cast("double") * F.lit(alpha)
    return x - F.floor(x)


def sobol(df: DataFrame, features: Sequence[str], predictor: Predictor, max_power: int = 13,
          resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(power, feature, s1, st, interaction, s1_conf, st_conf) at N = 2^5 ... 2^max_power.

    The smaller designs are prefixes of the largest, so the predictor scores one design.
    """
    features = list(features)
    d = len(features)
    ends = [(lo, hi if hi > lo else lo + WIDTH) for lo, hi, _ in box(df, features)]
    powers = [p for p in POWERS if p <= max_power] or [max_power]
    spark = df.sparkSession
    # Column k of A and of B are dimensions k and d + k of one Sobol sequence.
    points = spark.range(2 ** max(powers)).select(
        "id", *[sobol_column(F.col("id"), k, max(powers)).alias(f"a{k}") for k in range(d)],
        *[sobol_column(F.col("id"), d + k, max(powers)).alias(f"b{k}") for k in range(d)],
        F.explode(F.sequence(F.lit(-2), F.lit(d - 1))).alias("which"),  # -2: A, -1: B, k: A with column k of B
    )
    unit = [F.when((F.col("which") == -1) | (F.col("which") == k), F.col(f"b{k}")).otherwise(F.col(f"a{k}")) for k in range(d)]
    design = points.select("id", "which", *[
        (F.lit(lo) + u * F.lit(hi - lo)).alias(f) for f, u, (lo, hi) in zip(features, unit, ends)])
    scored = predictor(design)
    wide = scored.groupBy("id").agg(
        *[F.max(F.when(F.col("which") == k, F.col("prediction"))).alias(f"y{k + 2}") for k in range(-2, d)])
    sized = wide.withColumn("power", F.explode(F.array(*[F.lit(p) for p in powers]))).filter(
        F.col("id") < F.pow(F.lit(2.0), F.col("power").cast("double")))
    # Differences do not depend on the mean; centring B keeps the first-order estimate stable.
    centre = sized.groupBy("power").agg(((F.avg("y0") + F.avg("y1")) / 2).alias("centre"))
    sized = sized.join(F.broadcast(centre), "power")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"y{k + 2}").alias("ab")) for k, f in enumerate(features)])
    long = sized.select("power", "id", "y0", "y1", "centre", F.inline(cells))

    def indices(weight: Column):
        total = F.sum(weight)
        mean = F.sum(weight * (F.col("y0") + F.col("y1"))) / (2 * total)
        square = F.sum(weight * (F.pow(F.col("y0") - F.col("centre"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("centre"), F.lit(2.0)))) / (2 * total)
        spread = square - F.pow(mean - F.first("centre"), F.lit(2.0))
        first = F.sum(weight * (F.col("y1") - F.col("centre")) * (F.col("ab") - F.col("y0"))) / total
        whole = F.sum(weight * F.pow(F.col("y0") - F.col("ab"), F.lit(2.0))) / (2 * total)
        return F.when(spread > 0, first / spread).otherwise(0.0).alias("s1"), F.when(spread > 0, whole / spread).otherwise(0.0).alias("st")

    point = long.groupBy("power", "feature").agg(*indices(F.lit(1.0)))
    drawn = (
        long.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .withColumn("w", poisson_weight(F.col("id"), F.col("draw").cast("long"), seed))
        .groupBy("power", "feature", "draw").agg(*indices(F.col("w")))
        .groupBy("power", "feature")
        .agg((F.stddev_samp("s1") * CONFIDENCE_Z).alias("s1_conf"), (F.stddev_samp("st") * CONFIDENCE_Z).alias("st_conf"))
    )
    return point.join(drawn, ["power", "feature"]).select(
        "power", "feature", "s1", "st", (F.col("st") - F.col("s1")).alias("interaction"), "s1_conf", "st_conf")


def most_sensitive(table: DataFrame) -> DataFrame:
    """(feature, st, total_interaction) of the largest design."""
    last = table.groupBy("power").agg(
        F.max_by("feature", "st").alias("feature"), F.max("st").alias("st"), F.sum("interaction").alias("total_interaction"))
    return last.orderBy(F.col("power").desc()).limit(1).drop("power")


def gradient(curve: DataFrame, keys: Sequence[str], step: str, value: str, width: Column, out: str) -> DataFrame:
    """Central differences along a grid, one-sided at its ends."""
    order = W.partitionBy(*keys).orderBy(step)
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    here = F.col(value)
    slope = F.when(before.isNull(), (after - here) / width).when(after.isNull(), (here - before) / width).otherwise(
        (after - before) / (2 * width))
    return curve.withColumn(out, slope)


def response_curves(df: DataFrame, features: Sequence[str], predictor: Predictor, points: int = GRID_POINTS) -> DataFrame:
    """(feature, step, at, width, prediction): each feature over its range, the others at mid-range."""
    features = list(features)
    ends = box(df, features)
    spark = df.sparkSession
    rows = [(f, lo, hi, points if hi > lo else 2) for f, (lo, hi, _) in zip(features, ends)]
    grid = spark.createDataFrame(rows, "feature string, low double, high double, points int").withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.col("points") - 1)))
    width = (F.col("high") - F.col("low")) / (F.col("points") - 1)
    grid = grid.withColumn("width", width).withColumn("at", F.col("low") + F.col("step") * F.col("width"))
    design = grid.select("feature", "step", "at", "width", *[
        F.when(F.col("feature") == f, F.col("at")).otherwise(F.lit((lo + hi) / 2)).alias(f) for f, (lo, hi, _) in zip(features, ends)])
    return predictor(design).select("feature", "step", "at", "width", "prediction")


CLASSES = ("accelerating_rise", "decelerating_rise", "accelerating_fall", "decelerating_fall", "flat")


def directional_impact(curves: DataFrame) -> DataFrame:
    """(feature, dominant, share of each slope class in %); a constant feature is flat throughout."""
    varying = curves.filter(F.col("width") > 0)
    d1 = gradient(varying, ["feature"], "step", "prediction", F.col("width"), "dy")
    d2 = gradient(d1, ["feature"], "step", "dy", F.col("width"), "d2y")
    whole = W.partitionBy("feature")
    reach = (F.max("prediction").over(whole) - F.min("prediction").over(whole)) / (F.max("at").over(whole) - F.min("at").over(whole))
    tol = F.greatest(reach * 1e-3, F.lit(1e-9))
    dy, curve = F.col("dy"), F.col("d2y")
    tests = ((dy > F.col("tol")) & (curve > 0), (dy > F.col("tol")) & (curve <= 0),
             (dy < -F.col("tol")) & (curve < 0), (dy < -F.col("tol")) & (curve >= 0), F.abs(dy) <= F.col("tol"))
    shares = d2.withColumn("tol", tol).groupBy("feature").agg(
        *[(F.count_if(t) / F.count(F.lit(1)) * 100).alias(c) for c, t in zip(CLASSES, tests)])
    fixed = curves.filter(F.col("width") <= 0).select("feature").distinct().select(
        "feature", *[F.lit(100.0 if c == "flat" else 0.0).alias(c) for c in CLASSES])
    table = shares.unionByName(fixed)
    top = F.greatest(*CLASSES)
    dominant = F.lit(None).cast("string")
    for c in reversed(CLASSES):  # the first of equal shares wins
        dominant = F.when(F.col(c) == top, F.lit(c)).otherwise(dominant)
    return table.select("feature", dominant.alias("dominant"), *CLASSES)
