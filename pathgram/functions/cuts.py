"""Exact order statistics of the per-replicate hash order, without a global sort.

Random labels (permutation sides, folds) are defined by the rank of a case in the
order of (hash, case). Only the cases within a few standard errors of a cut can
decide it: everything below the bracket is counted, the bracket alone is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathgram.functions.hashing import PRIME, lane_array
from pathgram.functions.layout import spread

STANDARD_ERRORS = 8.0
CELLS_PER_STEP = 4_000_000  # cases x replicates worked on at once inside a task


def rank_cuts(df: DataFrame, case_id: str, rows: int, replicates: int, ranks: Sequence[int], seed: int) -> np.ndarray:
    """Array [replicate, rank, (hash, case)] of the ``rank``-th smallest (hash, case) per replicate."""
    source = spread(df.select(F.col(f"`{case_id}`").cast("long").alias("case_id")))
    targets = [int(k) for k in ranks]
    found = np.full((replicates, len(targets), 2), -1, dtype=np.int64)
    reach = STANDARD_ERRORS
    while (found[:, :, 0] < 0).any():
        brackets = []
        for k in targets:
            share = k / rows
            half = reach * math.sqrt(max(share * (1 - share), 1.0 / rows) / rows)
            brackets.append((math.floor((share - half) * PRIME), math.ceil((share + half) * PRIME)))

        def run(batches: Iterator[pa.RecordBatch], brackets=tuple(brackets)) -> Iterator[pa.RecordBatch]:
            numbers = np.arange(replicates, dtype=np.int64)
            below = np.zeros((len(brackets), replicates), dtype=np.int64)

            def rows_out(replicate, target, lane, case, amount):
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(v, dtype=np.int64)) for v in (replicate, target, lane, case, amount)],
                    names=["replicate", "target", "lane", "case", "amount"],
                )

            step = max(1, CELLS_PER_STEP // replicates)
            for batch in batches:
                ids_all = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for at in range(0, len(ids_all), step):
                    ids = ids_all[at:at + step]
                    lanes = lane_array(ids, numbers, seed)
                    for t, (low, high) in enumerate(brackets):
                        below[t] += (lanes < low).sum(axis=0)
                        i, b = np.nonzero((lanes >= low) & (lanes <= high))
                        if len(i):
                            yield rows_out(b, np.full(len(i), t), lanes[i, b], ids[i], np.ones(len(i)))
            for t in range(len(brackets)):
                yield rows_out(numbers, np.full(replicates, t), np.full(replicates, -1), np.full(replicates, -1), below[t])

        near = source.mapInArrow(run, "replicate long, target long, lane long, case long, amount long")
        upto = W.partitionBy("replicate", "target").orderBy("lane", "case").rowsBetween(W.unboundedPreceding, 0)
        want = F.element_at(F.array(*[F.lit(k) for k in targets]), F.col("target").cast("int") + 1)
        hits = near.withColumn("place", F.sum("amount").over(upto)).filter((F.col("lane") >= 0) & (F.col("place") == want))
        for r in hits.collect():  # replicates x ranks rows
            found[r["replicate"], r["target"]] = (r["lane"], r["case"])
        reach *= 4
    return found


def at_or_below(lanes: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Cases whose (hash, case) is not beyond the cut; one column per replicate."""
    lane, case = cut[:, 0][None, :], cut[:, 1][None, :]
    return (lanes < lane) | ((lanes == lane) & (ids[:, None] <= case))


def fold_sizes(rows: int, folds: int) -> list[int]:
    return [rows // folds + (1 if k < rows % folds else 0) for k in range(folds)]


def fold_numbers(lanes: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Zero-based fold per (case, repetition)."""
    out = np.zeros(lanes.shape, dtype=np.int64)
    for k in range(cuts.shape[1]):
        out += ~at_or_below(lanes, ids, cuts[:, k])
    return out
