"""Exact positions and quantiles without ever sorting a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import col
from pathgram.functions.layout import spread
from pathgram.session import materialise

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 10_000
BRACKET_ROWS = 200_000


def bucket_edges(df: DataFrame, column: str, rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Splitters of near-equal ranges, from a mergeable sketch. Only balance depends on the sketch."""
    count = min(MAX_BUCKETS, rows // rows_per_bucket + 1)
    if count < 2:
        return []
    shares = F.array(*[F.lit(k / count) for k in range(1, count)])
    edges = df.agg(F.percentile_approx(col(column).cast("double"), shares, max(10_000, 10 * count))).first()[0]
    return sorted(set(edges or []))


def bucket_of(value: Column, edges: Sequence[float]) -> Column:
    if not edges:
        return F.lit(0)
    table = np.array(edges)

    @F.pandas_udf(T.IntegerType())
    def locate(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table, v.to_numpy(dtype=float), side="right").astype(np.int32))

    return locate(value.cast("double"))


def running_total(df: DataFrame, column: str, amount: str, rows: int, out: str,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds the inclusive running sum of ``amount`` in the order of ``column``.

    Rows are cut into value ranges; a small table of exact range totals gives each
    range its offset, so no window spans more than one range.
    """
    edges = bucket_edges(df, column, rows, rows_per_bucket)
    cut = df.withColumn("_bucket", bucket_of(col(column), edges))
    order = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("_bucket").agg(F.sum(amount).alias("_total"))
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(order), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_bucket").orderBy(col(column)).rowsBetween(W.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(offsets), "_bucket")  # at most MAX_BUCKETS rows
    return joined.withColumn(out, F.col("_offset") + F.sum(amount).over(inside)).drop("_bucket", "_offset")


def number_cases(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Adds ``case_number`` = 1, 2, ... in the order of a unique key of any orderable type.

    Rows are cut into key ranges and sorted there; a range's offset is the number of rows before it.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(count, col(key)).sortWithinPartitions(col(key))
    placed = materialise(placed.withColumn("_place", F.monotonically_increasing_id()), "case-order")
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    order = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.join(F.broadcast(offsets), "_range")  # one row per range
    return joined.withColumn("case_number", F.col("_offset") + inside + 1).drop("_place", "_range", "_offset")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    bracket_rows: int = BRACKET_ROWS) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several double columns, exact at any table size.

    A sketch proposes a narrow bracket around each wanted rank, an exact count says
    which side of it the rank is on, and the bracket shrinks until it is small enough
    for the exact aggregate. Every pass is one column-wise aggregation; the state
    held per task is bounded by ``bracket_rows``.
    """
    columns = list(columns)
    if not columns:
        return {}
    df = spread(df.select(*[col(c) for c in columns]))
    first = df.agg(*[f(col(c)).alias(f"{n}{k}") for k, c in enumerate(columns)
                     for n, f in (("n", F.count), ("l", F.min), ("h", F.max))]).first()
    sizes = {c: first[f"n{k}"] for k, c in enumerate(columns)}
    small = [c for c in columns if 0 < sizes[c] <= bracket_rows]
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if small:
        shares = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(col(c), shares).alias(f"q{k}") for k, c in enumerate(small)]).first()
        out.update({c: list(row[k]) for k, c in enumerate(small)})
    wanted: dict[tuple[str, int], list] = {}
    for k, c in enumerate(columns):
        if sizes[c] > bracket_rows:
            for p in probabilities:
                # low, high, values below, values inside
                wanted[c, math.floor((sizes[c] - 1) * p)] = [first[f"l{k}"], first[f"h{k}"], 0, sizes[c]]
    found: dict[tuple[str, int], float] = {}

    def inside(c, low, high):
        return F.when((col(c) >= low) & (col(c) <= high), col(c))

    while True:
        for key, (low, high, _, _) in wanted.items():
            if low == high:
                found[key] = low
        open_keys = [k for k in wanted if k not in found and wanted[k][3] > bracket_rows]
        if not open_keys:
            break
        proposals = df.agg(*[
            F.percentile_approx(
                inside(c, wanted[c, rank][0], wanted[c, rank][1]),
                F.array(*[F.lit(min(max((rank - wanted[c, rank][2] + 0.5) / wanted[c, rank][3] + d, 0.0), 1.0))
                          for d in (-3e-4, 3e-4)]),
                10_000,
            ).alias(f"e{k}") for k, (c, rank) in enumerate(open_keys)
        ]).first()
        counts = df.agg(*[
            expr.alias(f"{n}{k}")
            for k, (c, rank) in enumerate(open_keys)
            for n, expr in (
                ("b", F.count_if(inside(c, wanted[c, rank][0], wanted[c, rank][1]) < proposals[k][0])),
                ("i", F.count_if((col(c) >= proposals[k][0]) & (col(c) <= proposals[k][1]))),
                ("p", F.max(F.when(inside(c, wanted[c, rank][0], wanted[c, rank][1]) < proposals[k][0], col(c)))),
                ("s", F.min(F.when(inside(c, wanted[c, rank][0], wanted[c, rank][1]) > proposals[k][1], col(c)))),
            )
        ]).first()
        for k, key in enumerate(open_keys):
            low, high, below, size = wanted[key]
            left, mid = counts[f"b{k}"], counts[f"i{k}"]
            place = key[1] - below
            if place < left:
                wanted[key] = [low, counts[f"p{k}"], below, left]
            elif place < left + mid:
                a, b = proposals[k]
                wanted[key] = [a, b, below + left, mid] if mid < size else _halve(df, key, wanted[key])
            else:
                wanted[key] = [counts[f"s{k}"], high, below + left + mid, size - left - mid]
    rest = [k for k in wanted if k not in found]
    if rest:
        row = df.agg(*[
            F.percentile(inside(c, wanted[c, rank][0], wanted[c, rank][1]),
                         F.lit((rank - wanted[c, rank][2]) / max(wanted[c, rank][3] - 1, 1))).alias(f"v{k}")
            for k, (c, rank) in enumerate(rest)
        ]).first()
        found.update({key: row[k] for k, key in enumerate(rest)})
    if found:
        # The neighbour above each found value, for interpolation.
        keys = list(found)
        row = df.agg(*[e.alias(f"{n}{k}") for k, (c, rank) in enumerate(keys) for n, e in (
            ("u", F.count_if(col(c) <= found[c, rank])), ("s", F.min(F.when(col(c) > found[c, rank], col(c)))))]).first()
        after = {key: found[key] if row[f"u{k}"] > key[1] + 1 else row[f"s{k}"] for k, key in enumerate(keys)}
        for c in columns:
            if sizes[c] > bracket_rows:
                for at, p in enumerate(probabilities):
                    h = (sizes[c] - 1) * p
                    a, share = found[c, math.floor(h)], h - math.floor(h)
                    out[c][at] = a + (after[c, math.floor(h)] - a) * share if share else a
    return out


def _halve(df: DataFrame, key: tuple[str, int], state: list) -> list:
    """The sketch could not split the bracket: split it at its middle value instead."""
    c, rank = key
    low, high, below, size = state
    middle = low + (high - low) / 2
    held = (col(c) >= low) & (col(c) <= high)
    row = df.agg(F.count_if(held & (col(c) <= middle)), F.max(F.when(held & (col(c) <= middle), col(c))),
                 F.min(F.when(held & (col(c) > middle), col(c)))).first()
    if rank - below < row[0]:
        return [low, row[1], below, row[0]]
    return [row[2], high, below + row[0], size - row[0]]
