"""Resampling counts of exactly n draws from n cases.

Draw i of a replicate takes the case at position hash(i, replicate) mod n, the same for any partitioning, and SQL can
repeat it. A table of one block needs no shuffle: every task hashes all draws (``exact_counts``). In larger ones the draws
are hashed in parts and meet their cases block by block of neighbouring positions (``deal``), so no task sees all draws.

``exact_counts`` with several blocks is another law with the same distribution, without a shuffle: the counts are split
down a binary tree over the blocks, a node's draws fall left by a binomial draw with the share of cases on its left, and
every node has a random stream of its own, named by (seed, replicate, node).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.hashing import lane_array

#: Cases of a block; its draws are dealt to them at once.
BLOCK_CASES = 4096
#: Added to the seed for the draws of a block.
DRAW_STREAM = 307
#: Draws (cases x replicates) that a task hashes at a time, and counts that meet in one block.
DRAWS_PER_STEP, COUNTS_PER_BLOCK = 2_000_000, 4_000_000


def _stream(seed: int, replicate: int, node: int) -> np.random.Generator:
    key = np.array([seed, replicate], np.uint64)
    return np.random.Generator(np.random.Philox(key=key, counter=np.array([0, 0, 0, node], np.uint64)))


def exact_counts(positions: np.ndarray, replicates: np.ndarray, n: int, seed: int, block: int = BLOCK_CASES) -> np.ndarray:
    """cases x replicates: how often each of the given positions (0 to n - 1) is drawn in n draws from n."""
    out = np.zeros((len(positions), len(replicates)))
    home = positions // block
    order = np.argsort(home, kind="stable")
    blocks, starts = np.unique(home[order], return_index=True)
    rows_of = {int(b): rows for b, rows in zip(blocks, np.split(order, starts[1:]))}
    last = -(-n // block)

    def cases(low: int, high: int) -> int:
        return min(high * block, n) - low * block

    for k, replicate in enumerate(replicates.tolist()):
        todo = [(1, 0, last, n, blocks)]
        while todo:
            node, low, high, count, wanted = todo.pop()
            if high - low == 1:
                size = cases(low, high)
                rows = rows_of[low]
                draws = (int(low) << 31) + np.arange(count, dtype=np.int64)
                fallen = lane_array(draws, np.array([replicate]), seed + DRAW_STREAM)[:, 0] % size
                out[rows, k] = np.bincount(fallen, minlength=size)[positions[rows] - low * block]
                continue
            middle = (low + high) // 2
            left = int(_stream(seed, replicate, node).binomial(count, cases(low, middle) / cases(low, high)))
            cut = int(np.searchsorted(wanted, middle))
            for side, a, b, c, w in ((2 * node, low, middle, left, wanted[:cut]), (2 * node + 1, middle, high, count - left, wanted[cut:])):
                if len(w) and c:
                    todo.append((side, a, b, c, w))
    return out


def deal(table: DataFrame, number: str, n: int, replicates: int, seed: int, weights: str, block: int | None = None) -> DataFrame:
    """Adds ``weights``: how often each case is drawn, a binary of 32-bit counts by replicate.

    ``number`` numbers the n cases from 1. Draws travel as four bytes each, to the block of their case.
    """
    block = block or max(1, min(BLOCK_CASES, COUNTS_PER_BLOCK // replicates))
    spark = table.sparkSession
    numbers = np.arange(replicates, dtype=np.int64)
    step = max(1, DRAWS_PER_STEP // replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), step):
                place = lane_array(ids[at : at + step], numbers, seed + DRAW_STREAM) % n
                home = place // block
                code = ((place - home * block) * replicates + numbers[None, :]).astype(np.uint32).ravel()
                home = home.ravel()
                order = np.argsort(home, kind="stable")
                blocks, starts = np.unique(home[order], return_index=True)
                cells = [c.tobytes() for c in np.split(code[order], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int64)), pa.array(cells, pa.binary())], names=["_block", "draws"])

    tasks = max(spark.sparkContext.defaultParallelism, n * replicates // (8 * DRAWS_PER_STEP))
    draws = spark.range(0, n, 1, tasks).mapInArrow(run, "_block long, draws binary")
    cases = table.withColumn("_block", F.floor((F.col(number) - 1) / block))
    schema = T.StructType([*table.schema.fields, T.StructField(weights, T.BinaryType())])
    names = table.columns

    def meet(cases_of: pa.Table, draws_of: pa.Table) -> pa.Table:
        if not cases_of.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(schema, [*(cases_of.schema.field(c).type for c in names), pa.binary()])})
        drawn = np.frombuffer(b"".join(v.as_py() for v in draws_of["draws"]), np.uint32)
        counts = np.bincount(drawn, minlength=block * replicates).astype(np.uint32)
        counts = counts.reshape(block, replicates)
        place = (cases_of[number].to_numpy() - 1) % block
        return cases_of.select(names).append_column(weights, pa.array([counts[p].tobytes() for p in place], pa.binary()))

    return cases.groupBy("_block").cogroup(draws.groupBy("_block")).applyInArrow(meet, schema)
