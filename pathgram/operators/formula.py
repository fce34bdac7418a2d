"""Scoring of candidate formulas and their complexity/loss front."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathgram.functions.columns import col

# The unary operators of the formula language, as SQL bodies.
UNARY = {
    "square": "x * x",
    "cube": "x * x * x",
    "sqrt_abs": "sqrt(abs(x))",
    "log_abs": "ln(abs(x) + 1e-8)",
}


def register_unary(spark: SparkSession) -> None:
    """Make the unary operators usable in formula texts; Catalyst inlines them."""
    for name, body in UNARY.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE) RETURNS DOUBLE RETURN {body}")


def score_formulas(df: DataFrame, target: str, candidates: Sequence[tuple[int, str]]) -> DataFrame:
    """(complexity, equation, loss, r2, score): all losses in one aggregation over the table.

    score = -d ln(loss) / d complexity against the next simpler candidate.
    """
    register_unary(df.sparkSession)
    y = col(target)
    sums = df.agg(
        F.var_pop(y).alias("spread"),
        *[F.avg(F.pow(y - F.expr(text).cast("double"), F.lit(2.0))).alias(f"l{k}") for k, (_, text) in enumerate(candidates)],
    )
    rows = F.array(*[
        F.struct(F.lit(int(c)).alias("complexity"), F.lit(text).alias("equation"), F.col(f"l{k}").alias("loss"), F.col("spread"))
        for k, (c, text) in enumerate(candidates)
    ])
    order = W.orderBy("complexity", "equation")  # one row per candidate
    before, simpler = F.lag("loss").over(order), F.lag("complexity").over(order)
    gain = F.when((F.col("loss") > 0) & (before > 0) & (F.col("complexity") > simpler),
                  -(F.ln("loss") - F.ln(before)) / (F.col("complexity") - simpler))
    return sums.select(F.inline(rows)).select(
        "complexity", "equation", "loss",
        F.when(F.col("spread") > 0, 1 - F.col("loss") / F.col("spread")).alias("r2"), gain.alias("score"))


def pareto_front(scored: DataFrame) -> DataFrame:
    """Candidates whose loss beats every simpler one."""
    simpler = W.orderBy("complexity", "loss").rowsBetween(W.unboundedPreceding, -1)
    best = F.min("loss").over(simpler)
    return scored.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col("loss") < F.col("_best"))).drop("_best")
