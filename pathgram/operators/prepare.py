"""Selection, missing values, scaling and splits (rows in, rows out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathgram.functions.columns import col, is_numeric, numeric, resolve
from pathgram.functions.hashing import uniform
from pathgram.functions.layout import small_side
from pathgram.spec import ModelError

MIN_GROUP = 10


def select_columns(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    found = resolve(df, names)
    return df.select(*[col(k) for k in keep], *[col(a).alias(n) for n, a in found.items()])


def coerce(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), decimal: str = ",") -> DataFrame:
    return df.select(*[col(k) for k in keep], *[numeric(df, c, decimal) for c in columns])


def coercion_losses(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, before, after, lost): values that were present but are not numbers. One scan."""
    counts = df.agg(
        *[F.count(col(c)).alias(f"b{k}") for k, c in enumerate(columns)],
        *[F.count(numeric(df, c)).alias(f"a{k}") for k, c in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"b{k}").alias("before"), F.col(f"a{k}").alias("after"))
        for k, c in enumerate(columns)
    ])
    lost = F.col("before") - F.col("after")
    return counts.select(F.inline(rows)).withColumn("lost", lost)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(columns))


def impute_means(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Column mean of the present values (within ``keys`` when given)."""
    columns, keys = list(columns), list(keys)
    if not keys:
        means = df.agg(*[F.avg(col(c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
        fill = {c: m for c, m in zip(columns, means) if m is not None}
        return drop_incomplete(df.fillna(fill), columns)
    means = df.groupBy(*keys).agg(*[F.avg(col(c)).alias(f"_m{k}") for k, c in enumerate(columns)])
    filled = df.join(small_side(means), keys).select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(col(c), F.col(f"_m{k}")).alias(c) for k, c in enumerate(columns)],
    )
    return drop_incomplete(filled, columns)


def prepare(df: DataFrame, columns: Sequence[str], missing: str = "casewise", keep: Sequence[str] = (),
            keys: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The analysis table of a model and its warnings."""
    keep = list(dict.fromkeys([*keys, *keep]))
    table = select_columns(df, columns, keep)
    if missing != "mean":
        for c in columns:  # implied by the deletion below, but plain enough to reach the scan
            table = table.filter(col(c).isNotNull())
    table = coerce(table, list(columns), keep)
    if missing == "mean":
        return impute_means(table, columns, keys), []
    notes = ["pairwise_as_casewise"] if missing == "pairwise" else []
    return drop_incomplete(table, columns), notes


def guard_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_complete, low, high, verdict) over complete rows; one scan, one row per column."""
    complete = drop_incomplete(coerce(df, columns), columns)
    stats = complete.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(col(c)).alias(f"l{k}") for k, c in enumerate(columns)],
        *[F.max(col(c)).alias(f"h{k}") for k, c in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col("n").alias("n_complete"),
                 F.col(f"l{k}").alias("low"), F.col(f"h{k}").alias("high"))
        for k, c in enumerate(columns)
    ])
    verdict = (
        F.when(F.col("n_complete") == 0, "no_complete_rows")
        .when(F.col("low") == F.col("high"), "zero_variance")
        .otherwise("ok")
    )
    return stats.select(F.inline(rows)).withColumn("verdict", verdict)


def standardise(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Mean 0, sd 1 (ddof 1). A constant column leaves no finite row, as in the row filter."""
    columns = list(columns)
    stats = df.agg(
        *[F.avg(col(c)).alias(f"m{k}") for k, c in enumerate(columns)],
        *[F.stddev_samp(col(c)).alias(f"s{k}") for k, c in enumerate(columns)],
    ).first()
    mean, sd = stats[: len(columns)], stats[len(columns):]
    out = df.select(
        *[col(k) for k in keep],
        *[((col(c) - F.lit(m)) / F.lit(s)).alias(c) if s else F.lit(None).cast("double").alias(c)
          for c, m, s in zip(columns, mean, sd)],
    )
    return drop_incomplete(out, columns)


def _ranged(df: DataFrame, columns: Sequence[str], keep: Sequence[str], top: float, flat: float) -> DataFrame:
    columns = list(columns)
    ends = df.agg(
        *[F.min(col(c)).alias(f"l{k}") for k, c in enumerate(columns)],
        *[F.max(col(c)).alias(f"h{k}") for k, c in enumerate(columns)],
    ).first()
    low, high = ends[: len(columns)], ends[len(columns):]
    return df.select(
        *[col(k) for k in keep],
        *[scaled(col(c), lo, hi, top, flat).alias(c) for c, lo, hi in zip(columns, low, high)],
    )


def scaled(value: Column, low: float, high: float, top: float, flat: float) -> Column:
    if low is None or not high > low:
        return F.lit(flat)
    return (value - F.lit(float(low))) / F.lit(float(high) - float(low)) * F.lit(top)


def rescale_percent(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """0 to 100 by observed range; a constant column sits at 50."""
    return _ranged(df, columns, keep, 100.0, 50.0)


def normalise_unit(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """0 to 1 by observed range; a constant column sits at 0.5."""
    return _ranged(df, columns, keep, 1.0, 0.5)


def preview(df: DataFrame, case_id: str, rows: int = 500) -> DataFrame:
    return df.orderBy(col(case_id)).limit(rows)


def group_pair(df: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """Rows of two groups, compared as text, with the side as a column; nothing is split physically."""
    text = col(group).cast("string")
    return df.filter(text.isin(str(first), str(second))).withColumn(
        "side", F.when(text == str(first), "a").otherwise("b")
    )


def check_group_sizes(pair: DataFrame) -> dict[str, int]:
    sizes = {r["side"]: r["count"] for r in pair.groupBy("side").count().collect()}
    if min(sizes.get("a", 0), sizes.get("b", 0)) < MIN_GROUP:
        raise ModelError(f"each group needs {MIN_GROUP} rows, found {sizes}")
    return sizes


def feature_target(df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    columns = [*features, target]
    return drop_incomplete(coerce(df, columns, keep), columns)


def train_test(df: DataFrame, case_id: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part`` = train / test; depends on the case key only."""
    u = uniform(col(case_id), 0, seed)
    return df.withColumn("part", F.when(u < test_share, "test").otherwise("train"))


def bounds_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, low, high, n, constant, few_rows)."""
    features = list(features)
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(col(c)).alias(f"l{k}") for k, c in enumerate(features)],
        *[F.max(col(c)).alias(f"h{k}") for k, c in enumerate(features)],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"l{k}").alias("low"), F.col(f"h{k}").alias("high"), F.col("n"))
        for k, c in enumerate(features)
    ])
    return stats.select(F.inline(rows)).select(
        "feature", "low", "high", "n",
        (F.col("low") == F.col("high")).alias("constant"),
        (F.col("n") < 20).alias("few_rows"),
    )
