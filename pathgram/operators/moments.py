"""Keyed first and second moments of indicator columns: one scan, one small shuffle.

Everything the path model reports is a function of these moments, so rows are
read once and never travel. Each task reduces its rows to one packed matrix per
key (``mapInArrow``); only those matrices are shuffled. Partial matrices are kept
centred and combined with the pairwise update, so large means cost no digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.layout import spread, tasks

CELLS_PER_STEP = 4_000_000  # rows x replicates worked on at once inside a task
MERGE = 256  # partial rows of a key that one task merges at first
CELLS_PER_TASK = 32_000_000  # accumulator cells (256 MB) a task may hold

MOMENT_FIELDS = [
    T.StructField("n", T.DoubleType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())),
    T.StructField("scatter", T.ArrayType(T.DoubleType())),  # packed upper triangle of centred cross-products
    T.StructField("low", T.ArrayType(T.DoubleType())),
    T.StructField("high", T.ArrayType(T.DoubleType())),
]


@dataclass
class Moments:
    n: float
    mean: np.ndarray
    scatter: np.ndarray  # full matrix
    low: np.ndarray
    high: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.scatter / (self.n - 1.0)

    def sd(self) -> np.ndarray:
        return np.sqrt(np.diag(self.scatter) / (self.n - 1.0))

    def correlation(self) -> np.ndarray:
        scale = np.sqrt(np.diag(self.scatter))
        scale = np.where(scale > 0, scale, 1.0)
        r = self.scatter / np.outer(scale, scale)
        np.fill_diagonal(r, 1.0)
        return r


def pack(full: np.ndarray) -> np.ndarray:
    rows, cols = np.triu_indices(full.shape[-1])
    return full[..., rows, cols]


def unpack(flat: np.ndarray, p: int) -> np.ndarray:
    rows, cols = np.triu_indices(p)
    full = np.zeros(flat.shape[:-1] + (p, p))
    full[..., rows, cols] = flat
    full[..., cols, rows] = flat
    return full


def combine(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray, low=None, high=None) -> Moments:
    """Pairwise update over any number of parts (stacked along axis 0)."""
    total = float(n.sum())
    centre = (n @ mean) / total if total > 0 else np.full(mean.shape[1], np.nan)
    shift = (mean - centre) * np.sqrt(n)[:, None]
    return Moments(
        total,
        centre,
        scatter.sum(axis=0) + shift.T @ shift,
        low.min(axis=0) if low is not None else centre,
        high.max(axis=0) if high is not None else centre,
    )


def from_rows(pdf: pd.DataFrame) -> Moments:
    """Merge the partial rows of one key. One row per task, so small at any table size."""
    mean = np.stack(pdf["mean"].to_numpy())
    return combine(
        pdf["n"].to_numpy(dtype=float),
        mean,
        unpack(np.stack(pdf["scatter"].to_numpy()), mean.shape[1]),
        np.stack(pdf["low"].to_numpy()),
        np.stack(pdf["high"].to_numpy()),
    )


def _matrix(batch: pa.RecordBatch, start: int, width: int) -> np.ndarray:
    return np.column_stack([batch.column(start + k).to_numpy(zero_copy_only=False) for k in range(width)])


def _double(name: str):
    return F.col(f"`{name}`").cast("double").alias(name)


def moment_parts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Partial moments per (task, key). Rows with a missing value must be gone already."""
    keys, columns = list(keys), list(columns)
    p = len(columns)
    source = df.select(*[F.col(f"`{k}`") for k in keys], *[_double(c) for c in columns])
    schema = T.StructType([df.schema[k] for k in keys] + MOMENT_FIELDS)
    flush_at = max(1, CELLS_PER_TASK // (p * (p + 7)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        target = None

        def emit():
            rows = [
                [*key, m.n, m.mean.tolist(), pack(m.scatter).tolist(), m.low.tolist(), m.high.tolist()]
                for key, m in held.items()
            ]
            columns_out = [pa.array([r[k] for r in rows], type=target.field(k).type) for k in range(len(target))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns_out, schema=target)

        for batch in batches:
            if target is None:
                number, numbers = pa.float64(), pa.list_(pa.float64())
                types = [number, numbers, numbers, numbers, numbers]
                target = pa.schema(
                    [batch.schema.field(k) for k in range(len(keys))]
                    + [pa.field(f.name, t) for f, t in zip(MOMENT_FIELDS, types)]
                )
            if batch.num_rows == 0:
                continue
            x = _matrix(batch, len(keys), p)
            if keys:
                frame = batch.select(keys).to_pandas()
                groups = frame.groupby(keys, dropna=False, sort=False).indices.items()
            else:
                groups = [((), slice(None))]
            for key, rows in groups:
                key = key if isinstance(key, tuple) else (key,)
                part = x[rows]
                centre = part.mean(axis=0)
                part_centred = part - centre
                fresh = Moments(
                    float(len(part)), centre, part_centred.T @ part_centred, part.min(axis=0), part.max(axis=0)
                )
                old = held.get(key)
                held[key] = fresh if old is None else combine(
                    np.array([old.n, fresh.n]),
                    np.stack([old.mean, fresh.mean]),
                    np.stack([old.scatter, fresh.scatter]),
                    np.stack([old.low, fresh.low]),
                    np.stack([old.high, fresh.high]),
                )
            if len(held) > flush_at:
                yield emit()
        if held:
            yield emit()

    return premerge(source.mapInArrow(run, schema), keys, schema, source)


def premerge(parts: DataFrame, keys: Sequence[str], schema: T.StructType, source: DataFrame) -> DataFrame:
    """Partial rows of ``MERGE`` tasks at a time made one row per key, where the source has more tasks than that or does not say.

    So what finally meets in one task is a few hundred small matrices, also over a scan of a million tasks.
    """
    found = tasks(source)
    if found is not None and found <= MERGE:
        return parts

    def merge(key, pdf):
        m = from_rows(pdf)
        return pd.DataFrame([{
            **dict(zip(keys, key)), "n": m.n, "mean": m.mean, "scatter": pack(m.scatter), "low": m.low, "high": m.high,
        }])

    few = F.floor(F.spark_partition_id() / MERGE).cast("int")
    return parts.withColumn("_few", few).groupBy(*[F.col(f"`{k}`") for k in keys], "_few").applyInPandas(merge, schema)


def merge_by(parts: DataFrame, keys: Sequence[str], fn, schema, models: int | None = None) -> DataFrame:
    """Bring the partial matrices of a key together and apply ``fn(key, pdf)``.

    ``models`` is the expected number of keys; the explicit partition count keeps
    many small fits from being packed into one task.
    """
    spark = parts.sparkSession
    keys = list(keys)
    if not keys:
        parts, keys = parts.withColumn("_model", F.lit(0)), ["_model"]
    elif models is not None:
        width = min(models, 4 * spark.sparkContext.defaultParallelism)
        parts = parts.repartition(max(1, width), *keys)
    return parts.groupBy(*keys).applyInPandas(fn, schema)


def moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: n, mean, scatter, low, high."""
    keys = list(keys)
    schema = T.StructType([df.schema[k] for k in keys] + MOMENT_FIELDS)

    def merge(key, pdf):
        m = from_rows(pdf)
        values = dict(zip(keys, key)) if keys else {}
        return pd.DataFrame([{
            **values, "n": m.n, "mean": m.mean, "scatter": pack(m.scatter), "low": m.low, "high": m.high,
        }])

    return merge_by(moment_parts(df, columns, keys), keys, merge, schema)


def moment_table(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per (key, left, right) with n, means, sds, covariance and correlation."""
    keys, columns = list(keys), list(columns)
    p = len(columns)
    m = moments(df, columns, keys)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    name = F.array(*[F.lit(c) for c in columns])
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    diagonal = F.array(*[F.lit(pairs.index((i, i))) for i in range(p)])
    dof = F.col("n") - 1

    def at(array, pos):
        return F.element_at(array, pos + 1)

    i, j = F.col("s.i"), F.col("s.j")
    ss_i = at(F.col("scatter"), at(diagonal, i))
    ss_j = at(F.col("scatter"), at(diagonal, j))
    cross = at(F.col("scatter"), F.col("pos"))
    return m.select(*keys, "n", "mean", "scatter", F.posexplode(spots).alias("pos", "s")).select(
        *keys,
        at(name, i).alias("left"),
        at(name, j).alias("right"),
        F.col("n").cast("long").alias("n"),
        at(F.col("mean"), i).alias("mean_left"),
        at(F.col("mean"), j).alias("mean_right"),
        F.sqrt(ss_i / dof).alias("sd_left"),
        F.sqrt(ss_j / dof).alias("sd_right"),
        (cross / dof).alias("covariance"),
        F.when(i == j, F.lit(1.0)).otherwise(cross / F.sqrt(ss_i * ss_j)).alias("correlation"),
    )


# --------------------------------------------------------------------------
# Replicated moments: many weightings of the same rows in one scan
# --------------------------------------------------------------------------
Weigher = Callable[[np.ndarray, np.ndarray], np.ndarray]
REPLICATE_FIELDS = [T.StructField("replicate", T.LongType())] + MOMENT_FIELDS


def replicated_parts(
    df: DataFrame,
    case_id: str,
    columns: Sequence[str],
    replicates: int,
    weigher: Weigher | str,
    derive: Callable[[np.ndarray, int], np.ndarray] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Partial weighted moments per (task, replicate).

    ``weigher(ids, replicate numbers)`` gives the weight matrix of a batch; it may also name a
    binary column of 32-bit counts by replicate. All
    replicates of a batch come from one matrix product with the packed row
    products, so a row is read once however many replicates there are.
    ``derive`` maps (rows, replicate) to replicate-specific columns instead.
    """
    columns = list(columns)
    p = width or len(columns)
    cells = p * (p + 1) // 2
    per_scan = max(1, CELLS_PER_TASK // (cells + p + 1))
    if replicates > per_scan:
        slices = [(s, min(s + per_scan, replicates)) for s in range(0, replicates, per_scan)]
    else:
        slices = [(0, replicates)]
    counted = isinstance(weigher, str)
    given = [F.col(f"`{weigher}`")] if counted else []
    source = spread(df.select(F.col(f"`{case_id}`").cast("long").alias("case_id"), *[_double(c) for c in columns], *given))
    schema = T.StructType(REPLICATE_FIELDS)

    def job(first: int, last: int):
        numbers = np.arange(first, last, dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows_i, cols_i = np.triu_indices(p)
            s0 = np.zeros(len(numbers))
            s1 = np.zeros((len(numbers), p))
            s2 = np.zeros((len(numbers), cells))
            shift = None
            low, high = np.full(p, np.inf), np.full(p, -np.inf)
            step = max(1, CELLS_PER_STEP // len(numbers))
            for batch in batches:
                ids_all = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x_all = _matrix(batch, 1, len(columns))
                for at in range(0, len(ids_all), step):
                    ids, x = ids_all[at:at + step], x_all[at:at + step]
                    if counted:
                        drawn = batch.column(1 + len(columns)).slice(at, len(ids))
                        w = np.stack([np.frombuffer(c.as_buffer(), np.uint32)[first:last] for c in drawn]).astype(float)
                    else:
                        w = weigher(ids, numbers)
                    if derive is None:
                        if shift is None:
                            shift = x.mean(axis=0)
                        low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
                        y = x - shift
                        s0 += w.sum(axis=0)
                        s1 += w.T @ y
                        s2 += w.T @ (y[:, rows_i] * y[:, cols_i])
                    else:
                        shift = np.zeros(p)
                        low, high = np.zeros(p), np.ones(p)
                        s0 += w.sum(axis=0)
                        for k, number in enumerate(numbers):
                            y = derive(x, int(number))
                            wy = w[:, k:k + 1] * y
                            s1[k] += wy.sum(axis=0)
                            s2[k] += pack(wy.T @ y)
            used = np.flatnonzero(s0 > 0)
            if shift is None or not len(used):
                return
            s0, s1, s2 = s0[used], s1[used], s2[used]
            mean = s1 / s0[:, None]
            scatter = s2 - s0[:, None] * mean[:, rows_i] * mean[:, cols_i]
            count = len(used)

            def lists(values):
                flat = pa.array(np.ascontiguousarray(values).ravel())
                offsets = np.arange(0, (count + 1) * values.shape[1], values.shape[1], dtype=np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), flat)

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers[used]), pa.array(s0), lists(mean + shift), lists(scatter),
                    lists(np.tile(low, (count, 1))), lists(np.tile(high, (count, 1))),
                ],
                names=["replicate", "n", "mean", "scatter", "low", "high"],
            )

        return run

    parts = [premerge(source.mapInArrow(job(a, b), schema), ["replicate"], schema, source) for a, b in slices]
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


# --------------------------------------------------------------------------
# Pairwise-complete correlations
# --------------------------------------------------------------------------
def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present.

    Per task: four p x p matrices of masked sums around provisional centres,
    exploded to pairs and summed in the JVM.
    """
    columns = list(columns)
    p = len(columns)
    numeric = df.select(*[_double(c) for c in columns])
    centres = numeric.agg(*[F.avg(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    shift = np.array([v if v is not None else 0.0 for v in centres], dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((p, p))
        sx, sxx, sxy = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
        for batch in batches:
            x = _matrix(batch, 0, p) - shift
            seen = np.isfinite(x).astype(float)
            x = np.where(seen > 0, x, 0.0)
            n += seen.T @ seen
            sx += x.T @ seen
            sxx += (x * x).T @ seen
            sxy += x.T @ x
        i, j = np.triu_indices(p)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))]
            + [pa.array(np.ascontiguousarray(v)) for v in
               (n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j])],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = (
        numeric.mapInArrow(run, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    )
    name = F.array(*[F.lit(c) for c in columns])
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return sums.select(
        F.element_at(name, F.col("i") + 1).alias("left"),
        F.element_at(name, F.col("j") + 1).alias("right"),
        F.col("n").cast("long").alias("n"),
        F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("correlation"),
        F.col("i").alias("left_position"),
        F.col("j").alias("right_position"),
    )
