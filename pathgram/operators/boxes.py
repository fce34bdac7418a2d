"""A forest as leaf boxes: for each leaf an interval of every feature on its path, and the share of rows that pass."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import col
from pathgram.operators.boosting import Forest

#: Numbers that one step of the attribution holds at a time.
STEP_CELLS = 4_000_000
#: Cells of a tree, and numbers of all tables, up to which attributions are looked up.
TREE_CELLS, TABLE_NUMBERS = 4096, 8_000_000
#: Rows x trees x numbers that one step of the look-up holds; they stay in the cache.
LOOK_UP = 400_000


@dataclass
class Boxes:
    """Leaves of all trees in a row. A slot is one feature of a leaf's path; unused slots let everything pass."""

    base: float
    tree: np.ndarray  # leaves
    value: np.ndarray
    feature: np.ndarray  # leaves x slots
    low: np.ndarray  # values from low
    high: np.ndarray  # to below high
    share: np.ndarray  # product of the cover ratios of the feature's splits on the path

    @property
    def starts(self) -> np.ndarray:
        """The first leaf of each tree."""
        return np.flatnonzero(np.diff(self.tree, prepend=-1))

    def of(self, leaves: np.ndarray) -> Boxes:
        return replace(self, **{n: getattr(self, n)[leaves] for n in ("tree", "value", "feature", "low", "high", "share")})

    @property
    def expected(self) -> float:
        """Prediction with no feature known."""
        return self.base + float((self.value * self.share.prod(axis=1)).sum())


def leaf_boxes(forest: Forest) -> Boxes:
    leaves: list[tuple[int, float, dict[int, tuple[float, float, float]]]] = []

    def walk(t: int, node: int, path: dict[int, tuple[float, float, float]]) -> None:
        f = int(forest.feature[t, node])
        if f < 0:
            leaves.append((t, float(forest.value[t, node]), path))
            return
        cut, cover = float(forest.cut[t, node]), forest.cover[t, node]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        left, right = 2 * node + 1, 2 * node + 2
        walk(t, left, {**path, f: (low, min(high, cut), share * forest.cover[t, left] / cover)})
        walk(t, right, {**path, f: (max(low, cut), high, share * forest.cover[t, right] / cover)})

    for t in range(len(forest.feature)):
        walk(t, 0, {})
    slots = max([len(p) for *_, p in leaves], default=0) or 1
    shape = (len(leaves), slots)
    feature, low, high, share = np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
    for k, (_, _, path) in enumerate(leaves):
        for s, (f, (a, b, z)) in enumerate(path.items()):
            feature[k, s], low[k, s], high[k, s], share[k, s] = f, a, b, z
    return Boxes(forest.base, np.array([t for t, *_ in leaves], np.int64), np.array([v for _, v, _ in leaves]), feature, low, high, share)


def attributions(boxes: Boxes, x: np.ndarray, features: int) -> np.ndarray:
    """rows x features: path-dependent Shapley values.

    A leaf's game is v * prod(o_k if k is known, else z_k), with o_k whether the row passes feature k and z_k its share.
    Its Shapley value for j is v (o_j - z_j) * integral over t in [0, 1] of prod_{k != j} (t o_k + (1 - t) z_k): a
    polynomial of degree slots - 1, so half as many quadrature nodes as slots give it exactly. No coalition is listed.
    """
    leaves, slots = boxes.feature.shape
    nodes, weights = np.polynomial.legendre.leggauss(-(-slots // 2))
    t, w = (nodes + 1) / 2, weights / 2
    out = np.zeros((len(x), features))
    if not leaves:
        return out
    to_feature = np.zeros((leaves * slots, features))
    to_feature[np.arange(leaves * slots), boxes.feature.ravel()] = 1.0
    step = max(1, STEP_CELLS // (leaves * slots * len(t)))
    for at in range(0, len(x), step):
        v = x[at : at + step][:, boxes.feature]
        passed = ((v >= boxes.low) & (v < boxes.high)).astype(float)
        factors = passed[..., None] * t + (boxes.share[..., None] * (1 - t))
        others = np.ones(factors.shape)
        ahead = np.ones((*factors.shape[:2], len(t)))
        behind = ahead.copy()
        for s in range(slots):  # products of the slots before and after each
            others[:, :, s] *= ahead
            ahead *= factors[:, :, s]
            others[:, :, slots - 1 - s] *= behind
            behind *= factors[:, :, slots - 1 - s]
        phi = boxes.value[:, None] * (passed - boxes.share) * (others @ w)
        out[at : at + step] = phi.reshape(len(phi), -1) @ to_feature
    return out


@dataclass
class Cells:
    """What ``attributions`` gives, worked out once per tree for every cell between that tree's cuts."""

    cuts: list[np.ndarray]  # of each feature, over all trees
    place: list[np.ndarray]  # of each feature: places between its cuts x trees, what it adds to the place in the table
    table: np.ndarray  # cells of all trees x (phi of each feature, value)
    base: float
    rest: Boxes  # trees with too many cells

    def look_up(self, x: np.ndarray) -> np.ndarray:
        """rows x (phi of each feature, prediction); values must not be missing."""
        width = len(self.cuts)
        out = np.zeros((len(x), width + 1))
        trees = self.place[0].shape[1]
        step = max(1, LOOK_UP // max(1, trees * (width + 1)))
        for at in range(0, len(x) if trees else 0, step):
            part = x[at : at + step]
            spot = sum(place[np.searchsorted(cuts, part[:, f], side="right")] for f, (cuts, place) in enumerate(zip(self.cuts, self.place)))
            out[at : at + step] = self.table.take(spot, axis=0).sum(axis=1)
        if len(self.rest.value):
            out += _worked_out(self.rest, x, width)
        out[:, width] += self.base
        return out


def _worked_out(boxes: Boxes, x: np.ndarray, width: int) -> np.ndarray:
    """rows x (phi of each feature, sum of the values of the leaves that a row reaches), from the boxes themselves."""
    value = np.zeros(len(x))
    step = max(1, STEP_CELLS // max(1, boxes.feature.size))
    for at in range(0, len(x), step):
        v = x[at : at + step][:, boxes.feature]
        value[at : at + step] = ((v >= boxes.low) & (v < boxes.high)).all(axis=2) @ boxes.value
    return np.column_stack([attributions(boxes, x, width), value])


def cells_of_trees(boxes: Boxes, width: int, most: int = TREE_CELLS) -> Cells:
    """Tables of all trees that have up to ``most`` cells; a row's cell follows from the places of its values between the cuts."""
    finite = lambda v: v[np.isfinite(v)]
    cuts = [np.unique(finite(np.concatenate([boxes.low[boxes.feature == f], boxes.high[boxes.feature == f]]))) for f in range(width)]
    starts = [np.concatenate([[-np.inf], c]) for c in cuts]
    tables, places, rest, used = [], [[] for _ in range(width)], [], 0
    for leaves in np.split(np.arange(len(boxes.tree)), boxes.starts[1:]):
        tree = boxes.of(leaves)
        own = [np.unique(finite(np.concatenate([tree.low[tree.feature == f], tree.high[tree.feature == f]]))) for f in range(width)]
        sizes = np.array([len(c) + 1 for c in own], float)
        if sizes.prod() > most or (used + sizes.prod()) * (width + 1) > TABLE_NUMBERS:
            rest.append(leaves)
            continue
        grid = np.meshgrid(*[np.concatenate([[-np.inf], c]) for c in own], indexing="ij")
        tables.append(_worked_out(tree, np.stack([g.ravel() for g in grid], axis=1), width))
        stride = 1
        for f in reversed(range(width)):
            first = used if f == width - 1 else 0
            places[f].append(np.searchsorted(own[f], starts[f], side="right") * stride + first)
            stride *= len(own[f]) + 1
        used += len(tables[-1])
    place = [np.stack(p, axis=1).astype(np.int32) if p else np.zeros((len(s), 0), np.int32) for p, s in zip(places, starts)]
    table = np.concatenate(tables) if tables else np.zeros((0, width + 1))
    return Cells(cuts, place, table, boxes.base, boxes.of(np.concatenate(rest) if rest else np.zeros(0, np.int64)))


def tree_shapley(df: DataFrame, forest: Forest, case_id: str) -> DataFrame:
    """(case_id, prediction, baseline, feature, value, phi); phi sums to prediction - baseline.

    Rows are scored in place, without a shuffle or a background sample; the covers of the trees stand for the data.
    """
    boxes = leaf_boxes(forest)
    width = len(forest.features)
    tables = cells_of_trees(boxes, width)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)
        out = np.empty((len(x), width + 1))
        gone = np.isnan(x).any(axis=1)
        out[~gone] = tables.look_up(x[~gone])
        if gone.any():
            out[gone] = np.column_stack([attributions(boxes, x[gone], width), forest.score(x[gone])])
        return pd.Series(list(out))

    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"_x{k}").alias("value"), F.col("_phi")[k].alias("phi"))
        for k, f in enumerate(forest.features)
    ])
    rows = df.select(col(case_id).alias("case_id"), *[col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(forest.features)])
    rows = rows.withColumn("_phi", explain(*[F.col(f"_x{k}") for k in range(width)]))
    return rows.select("case_id", F.col("_phi")[width].alias("prediction"), F.lit(boxes.expected).alias("baseline"), F.inline(cells))
