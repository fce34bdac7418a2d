"""Column profile, scale types, correlations and grouping columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import col, long_form, numeric
from pathgram.functions.layout import spread
from pathgram.operators.moments import pairwise_correlations
from pathgram.operators.prepare import coerce
from pathgram.operators.summary import column_summaries, moment_values, quantiles

# An estimate above this proves more than 21 distinct values: d values fill at most d of
# the sketch's registers, so its estimate for 21 values cannot exceed 22.
FEW_ESTIMATE = 50
HIGH_MISSING = 0.2

STATS_SCHEMA = T.StructType([
    T.StructField("variable", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("total", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("sd", T.DoubleType()),
    T.StructField("skew", T.DoubleType()),
    T.StructField("kurt", T.DoubleType()),
    T.StructField("whole", T.BooleanType()),
    T.StructField("few", T.LongType()),  # distinct values when few, NULL when many
    T.StructField("q1", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
])


def whole_number(v: Column) -> Column:
    """Equal to an integer within 1e-8 absolute plus 1e-5 relative."""
    return F.abs(v - F.rint(v)) <= 1e-8 + 1e-5 * F.abs(F.rint(v))


def corrected_skew(g1: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def basic_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column from one scan with map-side aggregation."""
    v = F.col("value")
    flat = F.col("low") == F.col("high")
    return (
        long_form(spread(df.select(*[col(c) for c in columns])), list(columns)).groupBy("variable")
        .agg(
            F.count(F.lit(1)).alias("total"), F.count(v).alias("n"), F.avg(v).alias("mean"),
            F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("sd"),
            F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"),
            F.bool_and(whole_number(v)).alias("whole"), F.approx_count_distinct(v).alias("estimate"),
        )
        .select(
            "variable", "total", "n", "mean", "low", "high", "sd",
            F.when(flat & (F.col("n") > 2), 0.0).otherwise(corrected_skew(F.col("g1"), F.col("n"))).alias("skew"),
            F.when(flat & (F.col("n") > 3), 0.0).otherwise(corrected_kurtosis(F.col("g2"), F.col("n"))).alias("kurt"),
            "whole", "estimate",
        )
    )


def column_stats(df: DataFrame, columns: Sequence[str], quartiles: bool = True) -> DataFrame:
    """Everything the report tables need: one small row per column, from one scan (two with quartiles)."""
    columns = list(columns)
    found = column_summaries(df, columns)
    cuts = quantiles(df, columns, found, [0.25, 0.5, 0.75]) if quartiles else [[None] * 3] * len(columns)
    rows = []
    for k, (c, s) in enumerate(zip(columns, found)):
        mean, sd, skew, kurt = moment_values(s)
        low, high, whole = (s.low, s.high, s.whole) if s.n else (None, None, None)
        few = None if s.many else len(s.given)
        rows.append((c, k, s.total, s.n, mean, low, high, sd, skew, kurt, whole, few, *cuts[k]))
    return df.sparkSession.createDataFrame(rows, STATS_SCHEMA)


def scale_type() -> Column:
    few, n = F.col("few"), F.col("n")
    return (
        F.when(n == 0, "unknown").when(few <= 2, "binary")
        .when((few <= 10) & F.col("whole"), "ordinal").otherwise("metric")
    )


def scale_hint() -> Column:
    low, high = F.col("low"), F.col("high")

    def short(v: Column) -> Column:
        """Six significant digits without trailing zeros, as in %g for everyday sizes."""
        digits = F.when(F.abs(v) >= 1, F.floor(F.log10(F.abs(v))) + 1).otherwise(1).cast("int")
        text = F.format_string("%.6f", v)
        for d in range(1, 7):
            text = F.when(digits == d, F.format_string(f"%.{6 - d}f", v)).otherwise(text)
        plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        power = F.floor(F.log10(F.abs(v))).cast("int")
        mantissa = F.format_string("%.5f", v / F.pow(F.lit(10.0), power.cast("double")))
        mantissa = F.regexp_replace(F.regexp_replace(mantissa, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(F.abs(v) >= 1e6, F.concat(mantissa, F.lit("e+"), F.lpad(power.cast("string"), 2, "0"))).otherwise(plain)

    return (
        F.when(F.col("n") == 0, "")
        .when((low >= 1) & (high <= 5), "1-5").when((low >= 1) & (high <= 7), "1-7")
        .when((low >= 0) & (high <= 10), "0-10")
        .otherwise(F.concat(short(low), F.lit("-"), short(high)))
    )


def profile(df: DataFrame, columns: Sequence[str], used: Sequence[str] = ()) -> DataFrame:
    share = (F.col("total") - F.col("n")) / F.col("total")
    return column_stats(df, columns).select(
        "variable",
        scale_type().alias("scale_type"),
        (F.col("total") - F.col("n")).alias("missing"),
        share.alias("missing_rate"),
        "mean", "median", "low", "high", "sd", "skew", "kurt",
        scale_hint().alias("scale_hint"),
        F.col("variable").isin(*used).alias("used") if used else F.lit(False).alias("used"),
        (share >= HIGH_MISSING).alias("high_missing"),
        ((F.col("n") > 1) & (F.col("low") == F.col("high"))).alias("zero_variance"),
    )


def dataset_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, columns, missing_cells) of the table as it is, before coercion."""
    missing = F.lit(0).cast("long")
    for c in columns:
        gone = col(c).isNull()
        if df.schema[c].dataType in (T.DoubleType(), T.FloatType()):
            gone = gone | F.isnan(col(c))
        missing = missing + F.when(gone, 1).otherwise(0)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells")).select(
        "rows", F.lit(len(columns)).cast("long").alias("columns"), "missing_cells"
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return pairwise_correlations(coerce(df, columns), columns)


def strongest_pair(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = correlation_matrix(df, columns).filter(
        (F.col("left_position") < F.col("right_position")) & F.col("correlation").isNotNull()
    )
    order = [F.abs("correlation").desc(), F.col("left_position"), F.col("right_position")]
    return pairs.orderBy(*order).limit(1).select("left", "right", "correlation")


def grouping_columns(df: DataFrame, columns: Sequence[str], least: int = 2, most: int = 20) -> DataFrame:
    """(variable, groups): columns with 2 to 20 distinct present values, compared as text."""
    columns = list(columns)
    estimates = df.agg(*[F.approx_count_distinct(col(c).cast("string")).alias(f"e{k}") for k, c in enumerate(columns)]).first()
    near = [c for c, e in zip(columns, estimates) if e <= FEW_ESTIMATE]
    if not near:
        return df.sparkSession.createDataFrame([], "variable string, groups array<string>")
    text = df.select(*[col(c).cast("string").alias(c) for c in near])
    return (
        text.unpivot([], [col(c) for c in near], "variable", "value").filter(F.col("value").isNotNull())
        .groupBy("variable", "value").agg(F.lit(1).alias("_"))
        .groupBy("variable").agg(F.array_sort(F.collect_set("value")).alias("groups"))
        .filter(F.size("groups").between(least, most))
    )


def extremes(df: DataFrame, case_id: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k lowest and highest values per column with their cases.

    One scan: every task keeps k rows a column and side, only those are sorted. Equal values go by case, as in the
    ranking itself, so what a task drops is never among the first k.
    """
    columns = list(columns)
    source = df.select(col(case_id).alias("case_id"), *[numeric(df, c).alias(f"c{n}") for n, c in enumerate(columns)])
    kind = source.schema["case_id"].dataType
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("side", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("case_id", kind)])

    def first(table: pa.Table, side: str) -> pa.Table:
        if table.num_rows <= k:
            return table
        order = "ascending" if side == "low" else "descending"
        given = table.append_column("given", pc.is_valid(table["case_id"]).cast(pa.int8()))  # no case comes before all cases
        return table.take(pc.select_k_unstable(given, k, [("value", order), ("given", order), ("case_id", order)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], pa.Table] = {}
        for batch in batches:
            for n in range(len(columns)):
                value = batch.column(1 + n)
                there = pa.table({"value": value, "case_id": batch.column(0)}).filter(pc.is_valid(value))
                for side in ("low", "high"):
                    x = there
                    if x.num_rows > k:  # what lies beyond the k-th value of this batch cannot be among the first k
                        values = x["value"].to_numpy()
                        if side == "low":
                            x = x.filter(pa.array(values <= np.partition(values, k - 1)[k - 1]))
                        else:
                            x = x.filter(pa.array(values >= np.partition(values, len(values) - k)[len(values) - k]))
                    seen = held.get((n, side))
                    held[n, side] = first(x if seen is None else pa.concat_tables([seen, x]), side)
        for (n, side), t in held.items():
            if t.num_rows:
                t = t.combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([n] * t.num_rows, pa.int32()), pa.array([side] * t.num_rows), *[t[c].chunk(0) for c in ("value", "case_id")]],
                                                 names=["position", "side", "value", "case_id"])

    near = source.mapInArrow(run, schema)
    up, down = (F.when(F.col("side") == side, F.struct("value", "case_id")) for side in ("low", "high"))
    place = W.partitionBy("position", "side").orderBy(up.asc(), down.desc())
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("position") + 1)
    return near.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(name.alias("variable"), "side", "rank", "value", "case_id")
