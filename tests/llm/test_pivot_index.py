"""Pivot-distance search against products with every vector."""

import math
import random

import numpy as np
import pytest

from pathgram.llm import pivot_index
from pathgram.llm.pivot_index import Block, distances, spread_pivots, top_products

SCHEMA = "vec_id long, embedding array<float>, score string, row int, pivot int, name string"
EXTRA = ("x", 1, 2, "y")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, k=20):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(64 * float(np.float32(x))) for x in v]
            if sum(x * x for x in whole) < 2**62:
                good.append((i, whole))
    out = []
    for a, (i, q) in enumerate(good):
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, c)), j is None, j or 0) for b, (j, c) in enumerate(good) if a != b)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def got(df, **more):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in top_products(df, **more).collect()), key=str)


def awkward(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(6)]
    rows = [(k, [c + rng.gauss(0, 0.02) for c in centres[k % 6]]) for k in range(n)]
    rows += [(n + k, centres[0]) for k in range(n // 2)]  # copies of one vector: ties everywhere
    rows += [(None, centres[1]), (40, centres[2]), (40, centres[2]), (10**15, [x * 50 for x in centres[3]]), (20 * 10**14, [0.0] * width)]
    rows += [(100_000, None), (100_020, [None] * width), (100_040, [float("nan")] * width), (100_060, [float("inf")] * width),
             (100_080, [1e30] * width), (100_100, []), (100_120, [0.5])]
    return rows


@pytest.mark.parametrize("annulus,queries", [(2048, 512), (16, 4)])
def test_every_rank_and_score(spark, annulus, queries):
    rows = awkward(300, 12, 1)
    assert got(table(spark, rows), annulus=annulus, queries=queries) == brute(rows)


def test_many_cells_and_pages(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "PAGE", 8)
    monkeypatch.setattr(pivot_index, "CELL", 3)
    rows = awkward(500, 6, 2)
    assert got(table(spark, rows), annulus=10, queries=8) == brute(rows)


def test_large_components(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 6]) for _ in range(5)]) for k in range(120)]
    assert got(table(spark, rows)) == brute(rows)


def test_few_and_none(spark):
    assert got(table(spark, [])) == []
    assert got(table(spark, [(0, [1.0])])) == []
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [-1.0, 0.0])]
    assert got(table(spark, rows)) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for scale in (3, 300, 30_000):
        c = (rng.normal(size=(400, 8)) * scale).astype(np.int64)
        pivots = spread_pivots(c[:50], 7)
        away = distances(c, pivots)
        block = Block({"m": pivot_index._pack(c[:60]), "n": 60, "rows": np.arange(60).tobytes()}, pivots)
        norm = np.sqrt((c.astype(float) ** 2).sum(1))
        for p in range(len(pivots)):
            order = np.argsort(away[:, p])
            for ring in np.array_split(order, 20):
                ends = [np.array([x]) for x in (p, away[ring, p].min(), away[ring, p].max(), norm[ring].max())]
                most, _ = block.bounds(*ends)
                assert (c[:60] @ c[ring].T <= most).all()


def test_close_queries_leave_annuli_out(spark, monkeypatch):
    """With separate clusters the search visits few of the annuli."""
    rng = random.Random(9)
    rows = [(k, [10.0 * (k % 8 == j) + rng.gauss(0, 0.01) for j in range(8)]) for k in range(2400)]
    seen = []
    plain = pivot_index._streamed
    monkeypatch.setattr(pivot_index, "_streamed", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    assert got(table(spark, rows), annulus=64, queries=16) == brute(rows)
    blocks, rings = 120 / 16, 2400 / 64
    assert sum(seen) < blocks * rings / 2
