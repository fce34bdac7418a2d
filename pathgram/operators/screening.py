"""Missing values, outliers, out-of-scale entries and normality verdicts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import col, long_form, numeric
from pathgram.functions.distributions import kolmogorov_tail, normal_cdf, shapiro_wilk
from pathgram.functions.ordering import ROWS_PER_BUCKET, running_total
from pathgram.operators.profile import column_stats

# Screening thresholds.
SKEW_LIMIT, KURTOSIS_LIMIT = 2.0, 7.0
Z_LIMIT = 3.29
MEAN_SUBSTITUTION_MAX, IMPUTATION_MAX = 5.0, 10.0
MILD, SEVERE = 1.5, 3.0
SHAPIRO_MIN, SHAPIRO_MAX = 3, 5000
MAX_SCALE_VALUES = 11
CASE_LABELS = 6


def missing_table(stats: DataFrame) -> DataFrame:
    gone = F.col("total") - F.col("n")
    percent = gone / F.col("total") * 100
    advice = (
        F.when(percent <= 0, "complete").when(percent <= MEAN_SUBSTITUTION_MAX, "mean_substitution")
        .when(percent <= IMPUTATION_MAX, "multiple_imputation").otherwise("drop_or_multiple_imputation")
    )
    return stats.select("variable", F.col("n").alias("valid"), gone.alias("missing"),
                        F.round(percent, 2).alias("missing_percent"), advice.alias("recommendation"))


def descriptives(stats: DataFrame) -> DataFrame:
    return stats.select("variable", "n", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "low", "high", "skew", "kurt")])


def scale_bounds(row) -> tuple[float, float] | None:
    """The intended item range of an integer-like column with few values; 0 is legal only on 0-10."""
    if not row["n"] or not row["whole"] or row["few"] is None or row["few"] > MAX_SCALE_VALUES:
        return None
    for top in (5.0, 7.0):
        if row["high"] <= top:
            return 1.0, top
    if row["high"] <= 10:
        return (0.0 if row["low"] < 1 else 1.0), 10.0
    return None


def _tests(row, value: Column) -> dict[str, Column]:
    """Outlier tests of one column with its moments and quartiles as constants."""
    no = F.lit(False)
    out = {"z": no, "mild": no, "severe": no, "scale": no}
    if row["n"] > 1 and row["sd"]:
        out["z"] = F.abs((value - F.lit(row["mean"])) / F.lit(row["sd"])) > Z_LIMIT
    if row["n"] >= 4 and row["q1"] is not None and row["q3"] != row["q1"]:
        iqr = row["q3"] - row["q1"]
        for name, reach in (("mild", MILD), ("severe", SEVERE)):
            out[name] = (value < row["q1"] - reach * iqr) | (value > row["q3"] + reach * iqr)
    bounds = scale_bounds(row)
    if bounds:
        out["scale"] = (value < bounds[0]) | (value > bounds[1])
    return out


def outlier_counts(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(variable, out_of_scale, z_outliers, iqr_mild, iqr_severe, note): one scan, constants per column."""
    rows = stats.collect()
    names = {"scale": "out_of_scale", "z": "z_outliers", "mild": "iqr_mild", "severe": "iqr_severe"}
    counts, structs = [], []
    for k, row in enumerate(rows):
        tests = _tests(row, numeric(df, row["variable"]))
        counts += [F.count_if(t).alias(f"{n}{k}") for n, t in tests.items()]
        structs.append(F.struct(F.lit(row["variable"]).alias("variable"),
                                *[F.col(f"{n}{k}").alias(full) for n, full in names.items()]))
    note = (
        F.when(F.col("out_of_scale") > 0, "entry_error").when(F.col("iqr_severe") > 0, "extreme_values")
        .when((F.col("z_outliers") > 0) | (F.col("iqr_mild") > 0), "mild_outliers").otherwise("normal")
    )
    return df.agg(*counts).select(F.inline(F.array(*structs))).withColumn("note", note)


def flagged_cases(df: DataFrame, case_id: str, stats: DataFrame) -> DataFrame:
    """(variable, flagged, cases): union of z and out-of-scale cases, the first six labelled."""
    marks = []
    for row in stats.collect():
        tests = _tests(row, numeric(df, row["variable"]))
        marks.append(F.when(tests["z"] | tests["scale"], F.lit(row["variable"])))
    hits = df.select(col(case_id).alias("case_id"), F.explode(F.array_compact(F.array(*marks))).alias("variable"))
    first = W.partitionBy("variable").orderBy("case_id")
    shown = (
        hits.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= CASE_LABELS)
        .groupBy("variable").agg(F.array_sort(F.collect_list("case_id")).alias("ids"))
    )
    counted = hits.groupBy("variable").agg(F.count(F.lit(1)).alias("flagged"))
    labels = F.concat_ws(", ", F.transform("ids", lambda c: F.concat(F.lit("Case "), c.cast("string"))))
    more = F.when(F.col("flagged") > CASE_LABELS,
                  F.concat(labels, F.lit(" (+"), (F.col("flagged") - CASE_LABELS).cast("string"), F.lit(")")))
    return shown.join(counted, "variable").select("variable", "flagged", F.coalesce(more, labels).alias("cases"))


def shapiro_table(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(variable, w, p) of columns with 3 to 5000 values; the rule itself bounds each group."""
    rows = [r for r in stats.collect() if SHAPIRO_MIN <= r["n"] <= SHAPIRO_MAX and r["low"] != r["high"]]
    schema = "variable string, w double, p double"
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    cells = long_form(df, [r["variable"] for r in rows]).filter(F.col("value").isNotNull())

    def test(key, pdf):
        w, p = shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame([{"variable": key[0], "w": w, "p": p}])

    return cells.groupBy("variable").applyInPandas(test, schema)


@F.pandas_udf(T.DoubleType())
def _cdf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(z.to_numpy()))


def ks_distance(df: DataFrame, column: str, mean: float, sd: float, n: int) -> DataFrame:
    """Largest gap between the empirical and the standard normal distribution.

    Equal values are counted before the sort, and the running count is taken range by
    range, so neither a hot value nor a long column lands in one task.
    """
    values = (
        df.select(numeric(df, column).alias("v")).filter(F.col("v").isNotNull()).groupBy("v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    ranked = running_total(values, "v", "c", n, "upto")
    f = _cdf((F.col("v") - F.lit(mean)) / F.lit(sd))
    high, low = F.col("upto") / F.lit(float(n)), (F.col("upto") - F.col("c")) / F.lit(float(n))
    return ranked.select(f.alias("f"), high.alias("hi"), low.alias("lo")).agg(
        F.max(F.greatest(F.col("hi") - F.col("f"), F.col("f") - F.col("lo"))).alias("d")
    )


def ks_distances(df: DataFrame, rows) -> dict[str, float]:
    """Distances of several columns: one job while a column fits a single value range, else one job per column."""
    short = [r for r in rows if r["n"] <= ROWS_PER_BUCKET]
    out = {r["variable"]: ks_distance(df, r["variable"], r["mean"], r["sd"], r["n"]).first()["d"]
           for r in rows if r["n"] > ROWS_PER_BUCKET}
    if short:
        names = [r["variable"] for r in short]
        moments = df.sparkSession.createDataFrame(
            [(r["variable"], r["mean"], r["sd"], float(r["n"])) for r in short], "variable string, mean double, sd double, size double")
        cells = long_form(df, names).filter(F.col("value").isNotNull()).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("c"))
        upto = W.partitionBy("variable").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
        ranked = cells.withColumn("upto", F.sum("c").over(upto)).join(F.broadcast(moments), "variable")
        f = _cdf((F.col("value") - F.col("mean")) / F.col("sd"))
        placed = ranked.select("variable", f.alias("f"), (F.col("upto") / F.col("size")).alias("hi"),
                               ((F.col("upto") - F.col("c")) / F.col("size")).alias("lo"))
        found = placed.groupBy("variable").agg(F.max(F.greatest(F.col("hi") - F.col("f"), F.col("f") - F.col("lo"))).alias("d"))
        out |= {r["variable"]: r["d"] for r in found.collect()}
    return out


def ks_table(df: DataFrame, stats: DataFrame) -> DataFrame:
    rows = [r for r in stats.collect() if r["n"] >= 3 and r["sd"]]
    d = ks_distances(df, rows)
    table = [(r["variable"], float(d[r["variable"]]), kolmogorov_tail(float(d[r["variable"]]), r["n"])) for r in rows]
    return df.sparkSession.createDataFrame(table, "variable string, d double, p double")


def normality_verdict(skew: Column, kurt: Column, p: Column) -> Column:
    return (
        F.when(p > 0.05, "normal")
        .when((F.abs(skew) <= SKEW_LIMIT) & (F.abs(kurt) <= KURTOSIS_LIMIT), "acceptable").otherwise("review")
    )


def normality_table(df: DataFrame, stats: DataFrame) -> DataFrame:
    sw = shapiro_table(df, stats).select("variable", F.col("w").alias("sw"), F.col("p").alias("sw_p"))
    ks = ks_table(df, stats).select("variable", F.col("d").alias("ks"), F.col("p").alias("ks_p"))
    joined = stats.join(sw, "variable", "left").join(ks, "variable", "left")
    verdict = normality_verdict(F.col("skew"), F.col("kurt"), F.col("sw_p"))
    return joined.select("variable", *[F.round(c, 3).alias(c) for c in ("skew", "kurt", "sw", "sw_p", "ks", "ks_p")],
                         verdict.alias("verdict"))


def summary(df: DataFrame, stats: DataFrame, normality: DataFrame) -> DataFrame:
    """One row: the numbers behind a screening report."""
    miss = missing_table(stats).agg(
        F.max(F.col("valid") + F.col("missing")).alias("rows"),
        F.count(F.lit(1)).alias("variables"),
        F.sum("missing").alias("missing_cells"),
        F.max("missing_percent").alias("max_missing_percent"),
        F.count_if(F.col("missing_percent") > 0).alias("variables_with_missing"),
    )
    span = stats.agg(F.min("mean").alias("mean_low"), F.max("mean").alias("mean_high"),
                     F.min("sd").alias("sd_low"), F.max("sd").alias("sd_high"))
    out = outlier_counts(df, stats).agg(
        F.count_if(F.col("note") != "normal").alias("outlier_variables"),
        F.count_if(F.col("out_of_scale") > 0).alias("entry_error_variables"),
    )
    odd = normality.filter(F.col("verdict") == "review").agg(
        F.count(F.lit(1)).alias("non_normal"),
        F.concat_ws(", ", F.array_sort(F.collect_list("variable"))).alias("non_normal_variables"),
    )
    one = [t.withColumn("_one", F.lit(1)) for t in (miss, span, out, odd)]  # four one-row tables
    joined = one[0]
    for t in one[1:]:
        joined = joined.join(F.broadcast(t), "_one")
    return joined.drop("_one")


def screen(df: DataFrame, case_id: str, columns: Sequence[str]) -> dict[str, DataFrame]:
    """All screening tables of a table; ``df`` is best a written or cached indicator table."""
    stats = column_stats(df, columns)
    normality = normality_table(df, stats)
    return {
        "missing": missing_table(stats),
        "descriptives": descriptives(stats),
        "outliers": outlier_counts(df, stats),
        "flagged": flagged_cases(df, case_id, stats),
        "normality": normality,
        "summary": summary(df, stats, normality),
    }
