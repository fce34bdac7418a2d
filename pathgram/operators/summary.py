"""Statistics of all columns from one scan: a mergeable summary per column.

A summary holds the number of rows and values, the mean and three central moments, the ends, whether all values are
whole, the distinct values with their counts while they are few, and weighted points of the distribution. Tasks keep one
per column and merge pairwise; partial rows are merged once more by column. Quartiles of columns with many values take a
second scan for all of them: the points propose a bracket, the scan counts what lies below and collects what lies inside,
so the result is exact; a bracket that misses or holds too much is left to the general routine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathgram.functions.columns import numeric
from pathgram.functions.layout import spread, tasks
from pathgram.functions.ordering import exact_quantiles

#: Distinct values counted exactly; points kept per column; points taken from a batch.
VALUES, POINTS, BATCH_POINTS = 1024, 2048, 512
#: Half-width of a bracket as a share of the values, and the values it may hold.
SLACK, INSIDE = 0.01, 200_000
#: Partial rows merged in one level.
MERGE = 256
SCHEMA = ("position int, total long, n long, mean double, m2 double, m3 double, m4 double, low double, high double, whole boolean, "
          "many boolean, points array<double>, weights array<double>, given array<double>, times array<long>")
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


@dataclass
class Summary:
    total: int = 0
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    m4: float = 0.0
    low: float = math.inf
    high: float = -math.inf
    whole: bool = True
    many: bool = False  # more than VALUES distinct values
    points: np.ndarray = None
    weights: np.ndarray = None
    given: np.ndarray = None
    times: np.ndarray = None

    def __post_init__(self):
        none = np.zeros(0)
        self.points, self.weights, self.given = (none if v is None else np.asarray(v, float) for v in (self.points, self.weights, self.given))
        self.times = np.zeros(0, np.int64) if self.times is None else np.asarray(self.times, np.int64)


def summarise(x: np.ndarray) -> Summary:
    """Of one batch of a column; NaN stands for missing."""
    total, x = len(x), np.sort(x[~np.isnan(x)])
    n = len(x)
    if not n:
        return Summary(total)
    mean = float(x.mean())
    d = x - mean
    square = d * d
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    many = len(starts) > VALUES
    step = -(-n // BATCH_POINTS)
    points = x[step // 2 :: step]
    rounded = np.rint(x)
    return Summary(
        total, n, mean, float(square.sum()), float((square * d).sum()), float((square * square).sum()), float(x[0]), float(x[-1]),
        bool((np.abs(x - rounded) <= 1e-8 + 1e-5 * np.abs(rounded)).all()), many, points, np.full(len(points), n / len(points)),
        None if many else x[starts], None if many else np.diff(starts, append=n))


def combined(parts: Sequence[Summary]) -> Summary:
    """The summary of all rows of some summaries."""
    out = Summary(sum(p.total for p in parts))
    parts = [p for p in parts if p.n]
    if not parts:
        return out
    for p in parts:
        n, d = out.n + p.n, p.mean - out.mean
        a, b = out.n / n, p.n / n
        m2 = out.m2 + p.m2 + d * d * out.n * b
        m3 = out.m3 + p.m3 + d**3 * out.n * b * (a - b) + 3 * d * (a * p.m2 - b * out.m2)
        m4 = (out.m4 + p.m4 + d**4 * out.n * b * (a * a - a * b + b * b) + 6 * d * d * (a * a * p.m2 + b * b * out.m2) + 4 * d * (a * p.m3 - b * out.m3))
        out.mean, out.n, out.m2, out.m3, out.m4 = out.mean + d * b, n, m2, m3, m4
    out.low, out.high = min(p.low for p in parts), max(p.high for p in parts)
    out.whole, out.many = all(p.whole for p in parts), any(p.many for p in parts)
    if not out.many:
        out.given, place = np.unique(np.concatenate([p.given for p in parts]), return_inverse=True)
        out.times = np.bincount(place, np.concatenate([p.times for p in parts])).astype(np.int64)
        if len(out.given) > VALUES:
            out.many, out.given, out.times = True, np.zeros(0), np.zeros(0, np.int64)
    points, weights = (np.concatenate([getattr(p, f) for p in parts]) for f in ("points", "weights"))
    order = np.argsort(points, kind="stable")
    out.points, out.weights = points[order], weights[order]
    if len(points) > 2 * POINTS:
        ends = np.cumsum(out.weights)
        at = np.searchsorted(ends, (np.arange(POINTS) + 0.5) * ends[-1] / POINTS)
        out.points, out.weights = out.points[np.minimum(at, len(points) - 1)], np.full(POINTS, ends[-1] / POINTS)
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES)


def _row(position: int, s: Summary) -> tuple:
    return (position, s.total, s.n, s.mean, s.m2, s.m3, s.m4, s.low, s.high, s.whole, s.many, s.points.tolist(), s.weights.tolist(), s.given.tolist(), s.times.tolist())


def column_summaries(df: DataFrame, columns: Sequence[str]) -> list[Summary]:
    """One summary per column, from one scan."""
    columns = list(columns)
    source = spread(df.select(*[numeric(df, c).alias(f"c{k}") for k, c in enumerate(columns)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Summary() for _ in columns]
        for batch in batches:
            if batch.num_rows:
                held = [combined([s, summarise(batch.column(k).to_numpy(zero_copy_only=False).astype(float))]) for k, s in enumerate(held)]
        if any(s.total for s in held):
            types = [pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 6, pa.bool_(), pa.bool_(), *[pa.list_(pa.float64())] * 3, pa.list_(pa.int64())]
            rows = list(zip(*[_row(k, s) for k, s in enumerate(held)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=NAMES)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [Summary(*r[1:]) for r in pdf[NAMES].itertuples(index=False)]
        return _frame([_row(int(pdf["position"].iloc[0]), combined(parts))])

    parts = source.mapInArrow(run, SCHEMA)
    found = tasks(source)
    if found is None or found > MERGE:
        parts = parts.withColumn("few", F.floor(F.spark_partition_id() / MERGE).cast("int")).groupBy("position", "few").applyInPandas(merge, SCHEMA)
    out = [Summary() for _ in columns]
    for r in parts.groupBy("position").applyInPandas(merge, SCHEMA).collect():
        out[r["position"]] = Summary(*r[1:])
    return out


def moment_values(s: Summary) -> tuple[float | None, float | None, float | None, float | None]:
    """(mean, sd, skewness, excess kurtosis), the last two corrected for the number of values."""
    n = s.n
    if not n:
        return None, None, None, None
    if s.low == s.high:
        return s.low, 0.0 if n > 1 else None, 0.0 if n > 2 else None, 0.0 if n > 3 else None
    sd = math.sqrt(s.m2 / (n - 1))
    skew = math.sqrt(n) * s.m3 / s.m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * s.m4 / s.m2**2 - 3) + 6) if n > 3 else None
    return s.mean, sd, skew, kurt


def _counted(s: Summary, share: float) -> float:
    ends = np.cumsum(s.times)
    place = (s.n - 1) * share
    low = int(place)
    a, b = (float(s.given[np.searchsorted(ends, k, side="right")]) for k in (low, min(low + 1, s.n - 1)))
    return a + (b - a) * (place - low)


def quantiles(df: DataFrame, columns: Sequence[str], summaries: Sequence[Summary], shares: Sequence[float]) -> list[list[float | None]]:
    """Linear-interpolated quantiles of each column, exact; at most one more scan for all columns with many values."""
    columns = list(columns)
    out: list[list[float | None]] = [[None] * len(shares) for _ in columns]
    asked = []  # (column, share, low, high, rank)
    for k, s in enumerate(summaries):
        if s.n and not s.many:
            out[k] = [_counted(s, q) for q in shares]
        elif s.n:
            ends = np.cumsum(s.weights)
            for j, q in enumerate(shares):
                rank = int((s.n - 1) * q)
                near = [np.searchsorted(ends, ends[-1] / s.n * r) for r in (rank - SLACK * s.n - 2, rank + SLACK * s.n + 3)]
                low = s.low if near[0] == 0 else s.points[near[0] - 1]
                high = s.high if near[1] >= len(ends) - 1 else s.points[near[1] + 1]
                asked.append((k, j, float(low), float(high), rank))
    if not asked:
        return out
    used = sorted({a[0] for a in asked})
    at = {k: i for i, k in enumerate(used)}
    source = spread(df.select(*[numeric(df, columns[k]).alias(f"c{k}") for k in used]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, inside, size = [0] * len(asked), [[] for _ in asked], [0] * len(asked)
        for batch in batches:
            cells = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(used))]
            for a, (k, _, low, high, _) in enumerate(asked):
                x = cells[at[k]]
                below[a] += int((x < low).sum())
                held = x[(x >= low) & (x <= high)]
                size[a] += len(held)
                if size[a] <= INSIDE:
                    inside[a].append(held)
                else:
                    inside[a] = []
        lists = [np.concatenate([np.zeros(0), *v]).tolist() for v in inside]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(asked)), pa.int32()), pa.array(below, pa.int64()), pa.array(size, pa.int64()), pa.array(lists, pa.list_(pa.float64()))],
                                         names=["ask", "below", "size", "inside"])

    ranks = [a[4] for a in asked]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, below, size = int(pdf["ask"].iloc[0]), int(pdf["below"].sum()), int(pdf["size"].sum())
        place = ranks[ask] - below
        if size > INSIDE or place < 0 or place + 1 >= size:
            return pd.DataFrame({"ask": [ask], "first": [None], "second": [None]})
        x = np.partition(np.concatenate(list(pdf["inside"])), [place, place + 1])
        return pd.DataFrame({"ask": [ask], "first": [x[place]], "second": [x[place + 1]]})

    missed = set()
    for r in source.mapInArrow(run, "ask int, below long, size long, inside array<double>").groupBy("ask").applyInPandas(pick, "ask int, first double, second double").collect():
        k, j, *_, rank = asked[r["ask"]]
        if r["first"] is None:
            missed.add(k)
        else:
            out[k][j] = r["first"] + (r["second"] - r["first"]) * ((summaries[k].n - 1) * shares[j] - rank)
    if missed:
        names = [f"c{k}" for k in sorted(missed)]
        rest = exact_quantiles(df.select(*[numeric(df, columns[k]).alias(f"c{k}") for k in sorted(missed)]), names, shares)
        for k in missed:
            out[k] = rest[f"c{k}"]
    return out


__all__ = ["Summary", "column_summaries", "combined", "moment_values", "quantiles", "summarise"]
