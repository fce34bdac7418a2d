"""Partition-independent random numbers.

A value depends only on (case, replicate, seed), so retries, repartitioning and
other engines give the same draw. Small-integer arithmetic modulo a Mersenne
prime: every product stays inside a 64-bit integer.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647  # 2**31 - 1
CASE_STEP = 48271
REPLICATE_STEP = 69621
MIX_STEP = 1013904223
LAST_STEP = 7919
HIGH_STEP = 39373

# Poisson(1) distribution function at 0, 1, 2, ...; beyond the last entry the mass is below 1e-12.
POISSON_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(14)])


def lane(case_id: Column, replicate: Column | int, seed: int) -> Column:
    """Pseudo-random integer in [0, PRIME) as a Column."""
    rep = replicate if isinstance(replicate, Column) else F.lit(int(replicate)).cast("long")
    p = F.lit(PRIME).cast("long")
    case = case_id.cast("long")
    low = F.pmod(case, p)
    high = F.call_function("div", case - low, p)
    first = F.pmod(low * F.lit(CASE_STEP) + high * F.lit(HIGH_STEP) + rep * F.lit(REPLICATE_STEP) + F.lit(int(seed)), p)
    second = F.pmod(first * first + F.lit(MIX_STEP) + high * (rep + F.lit(1)), p)
    return F.pmod(second * second + F.lit(LAST_STEP), p)


def uniform(case_id: Column, replicate: Column | int, seed: int) -> Column:
    return lane(case_id, replicate, seed) / F.lit(float(PRIME))


def lane_start(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray | None]:
    """What ``lanes`` needs of each case, for those who ask for replicates one by one."""
    low, high = ids % PRIME, ids // PRIME
    return low * CASE_STEP + high * HIGH_STEP + seed, high if high.any() else None


def lanes(start: np.ndarray, high: np.ndarray | None, replicates: np.ndarray) -> np.ndarray:
    state = (start[:, None] + (replicates * REPLICATE_STEP)[None, :]) % PRIME
    np.multiply(state, state, out=state)
    state += MIX_STEP
    if high is not None:
        state += high[:, None] * (replicates + 1)[None, :]
    state %= PRIME
    np.multiply(state, state, out=state)
    state += LAST_STEP
    state %= PRIME
    return state


def lane_array(ids: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """The same integers for a batch: one row per case, one column per replicate."""
    return lanes(*lane_start(ids, seed), replicates)


def poisson_array(ids: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) resampling weights by inversion."""
    u = lane_array(ids, replicates, seed) / float(PRIME)
    weights = np.zeros(u.shape)
    for bound in POISSON_CDF:
        hit = u >= bound
        if not hit.any():
            break
        weights += hit
    return weights


def poisson_weight(case_id: Column, replicate: Column | int, seed: int) -> Column:
    u = uniform(case_id, replicate, seed)
    total = F.lit(0.0)
    for bound in POISSON_CDF:
        total = total + F.when(u >= F.lit(float(bound)), 1.0).otherwise(0.0)
    return total
