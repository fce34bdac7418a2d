"""Sobol sequences: every point from its index alone, as a Column, in SQL and in numpy.

A coordinate is the exclusive or of the direction numbers at the bits of the index's Gray code, so points can be made
in any task. Direction numbers follow from a primitive polynomial over GF(2) and odd starting values by the usual recurrence.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 30
# Starting values of the published direction numbers for dimensions 2 to 21, each with its polynomial's
# degree and inner coefficients. Later dimensions take further primitive polynomials and hashed odd numbers.
PUBLISHED = [
    (1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]),
    (5, 2, [1, 1, 5, 5, 17]), (5, 4, [1, 1, 5, 5, 5]), (5, 7, [1, 1, 7, 11, 19]), (5, 11, [1, 1, 5, 1, 1]),
    (5, 13, [1, 1, 1, 3, 11]), (5, 14, [1, 3, 5, 5, 31]), (6, 1, [1, 3, 3, 9, 7, 49]), (6, 13, [1, 1, 1, 15, 21, 21]),
    (6, 16, [1, 3, 1, 13, 27, 49]), (6, 19, [1, 1, 1, 15, 7, 5]), (6, 22, [1, 3, 1, 15, 13, 25]), (6, 25, [1, 1, 5, 5, 19, 61]),
    (7, 1, [1, 3, 7, 11, 23, 15, 103]), (7, 4, [1, 3, 7, 13, 13, 15, 69]),
]


def _primitive(poly: int, degree: int) -> bool:
    """Whether x generates all non-zero remainders modulo ``poly``."""
    order, value = 2**degree - 1, 1
    for k in range(1, order + 1):
        value <<= 1
        if value >> degree & 1:
            value ^= poly
        if value == 1:
            return k == order
    return False


def _further(count: int) -> list[tuple[int, int, list[int]]]:
    out, degree, inner, state = [], 7, PUBLISHED[-1][1] + 1, 1
    while len(out) < count:
        if inner >= 1 << (degree - 1):
            degree, inner = degree + 1, 0
            continue
        if _primitive((1 << degree) | (inner << 1) | 1, degree):
            start = []
            for k in range(degree):
                state = state * 48271 % 2147483647
                start.append((state % (1 << k)) * 2 + 1 if k else 1)
            out.append((degree, inner, start))
        inner += 1
    return out


@lru_cache(maxsize=None)
def directions(dimension: int) -> tuple[int, ...]:
    """Direction numbers of a dimension (from 0), scaled to ``BITS`` bits; the first belongs to the lowest bit."""
    if dimension == 0:
        return tuple(1 << (BITS - 1 - k) for k in range(BITS))
    rules = PUBLISHED if dimension <= len(PUBLISHED) else [*PUBLISHED, *_further(dimension - len(PUBLISHED))]
    degree, inner, m = rules[dimension - 1]
    v = [m[k] << (BITS - 1 - k) for k in range(degree)]
    for k in range(degree, BITS):
        new = v[k - degree] ^ (v[k - degree] >> degree)
        for j in range(1, degree):
            if inner >> (degree - 1 - j) & 1:
                new ^= v[k - j]
        v.append(new)
    return tuple(v)


def sobol_points(index: np.ndarray, dimension: int) -> np.ndarray:
    gray, out = index ^ (index >> 1), np.zeros(len(index), np.int64)
    for k, v in enumerate(directions(dimension)):
        out ^= np.where(gray >> k & 1, v, 0)
    return out / float(1 << BITS)


def sobol_column(index: Column, dimension: int, power: int) -> Column:
    """The coordinate of the first 2 ** power points, in [0, 1)."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    out = F.lit(0).cast("long")
    for k in range(power):
        out = out.bitwiseXOR(F.shiftright(gray, k).bitwiseAND(F.lit(1)) * F.lit(directions(dimension)[k]).cast("long"))
    return out.cast("double") / F.lit(float(1 << BITS))


def sobol_sql(index: str, dimension: int, power: int) -> str:
    gray, out = f"xor({index}, {index} >> 1)", "0::BIGINT"
    for k in range(power):
        out = f"xor({out}, (({gray}) >> {k} & 1) * {directions(dimension)[k]}::BIGINT)"
    return f"({out}::DOUBLE / {1 << BITS}.0)"
