"""Second-order boosted trees: histograms of gradients, many models in one pass.

Features are binned once. A cell is a block of rows times a batch of models: bins (one byte a value), target, fold and
the models' margins. Every level of a round is one pass over the cells: each task fills (model, node, feature, bin)
sums of gradients and counts. Up to ``DRIVER_BYTES`` of them are added up on the driver in one stage; beyond that the sums
of a batch are merged in two levels, the best splits are found on the executors and only splits come to the driver.
Margins move on in place. All models of a run share the passes: the folds of a
validation, or a whole parameter grid, of which only running scores are kept. Where a batch has one block (a table of up
to ``BLOCK`` rows) there is nothing to merge, so its task goes on to the next level and round by itself.

A parameter grid has models enough to keep all cores busy, so up to ``ALONE`` rows its work is cut by models only: the
binned rows go to every task, each grows its models to the end, and nothing but their errors comes back. Cut by rows
as well, 1,215 models would send 20 MB of sums a node and block through a shuffle at every level. Rows with equal bins
take every split together and have one margin, so a task keeps one point for them (``Points``): a round counts its
sampled rows and adds up their targets once for all models of the task, and the models only see points. The final model of
a grid grows the same way, as hundreds of rounds with a few passes each would take longer than the grid.

The passes use RDD partitions. A round has as many passes as levels and there are hundreds of rounds, so planning a
query for each (0.15 s against 0.07 s for an empty pass) would cost more than the work. Cells are checkpointed every
``KEEP`` rounds, so a lost executor costs at most that many rounds.

Squared error: gradient = margin - target, hessian 1. Gain of a split = GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2); a leaf
gives -G/(H+l2) times the learning rate. Ties go to the first feature and the lowest cut. Rows and columns are sampled
by hash, so results do not depend on partitions or retries.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import col
from pathgram.functions.hashing import PRIME, lane_array, lane_start, lanes
from pathgram.functions.layout import spread
from pathgram.session import scratch_root

MAX_BINS = 256
#: Of the sketch that proposes the cuts; tables of fewer rows get exact ranks.
ACCURACY = 100_000
#: Rows of a block, models of a batch, and rounds between checkpoints.
BLOCK, BATCH, KEEP = 65_536, 32, 25
#: Rows up to which the tasks of a grid hold all of them: one model then has as many margins as a cell above.
ALONE = BLOCK * BATCH
#: Margins (models x points) that a task of a grid holds at once, and tasks a core.
MARGINS, WAVES = 1 << 24, 4
#: Points that a model of a grid looks at in one go, so that what it works out for them stays in the cache.
CHUNK = 1 << 15
#: Bytes of partial sums of a level that may come to the driver; more are merged by the executors.
DRIVER_BYTES = 64 << 20
#: Numbers that a step of the split search, or of the sampling, holds.
STEP_BINS = 1 << 15
#: Least gain of a split, least number of sampled rows in a child.
LEAST_GAIN, LEAST_ROWS = 1e-6, 1.0
ROW_STREAM, COLUMN_STREAM = 101, 207  # added to the seed; apart from the streams of parts and folds


@dataclass(frozen=True)
class Settings:
    """Of one model; the defaults are the quick settings (fixed values)."""

    max_depth: int = 3
    learning_rate: float = 0.05
    n_estimators: int = 300
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    reg_lambda: float = 5.0


# The default grid, 486 points.
GRID = {
    "max_depth": [3, 4, 5],
    "learning_rate": [0.01, 0.05, 0.1],
    "n_estimators": [200, 400],
    "subsample": [0.7, 0.8, 1.0],
    "colsample_bytree": [0.7, 0.8, 1.0],
    "reg_lambda": [1.0, 5.0, 10.0],
}


@dataclass
class Forest:
    """Trees as heaps: node k has children 2k + 1 and 2k + 2; ``feature`` -1 is a leaf."""

    features: list[str]
    base: float
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray  # rows with a value below go left
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.log2(self.feature.shape[1] + 1)) - 1 if len(self.feature) else 0

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                f = self.feature[trees, node]
                right = part[rows, np.maximum(f, 0)] >= self.cut[trees, node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            out[at : at + 4096] += self.value[trees, node].sum(axis=1)
        return out

    def predictor(self) -> Callable[[DataFrame], DataFrame]:
        """Adds ``prediction`` to any table with the feature columns."""

        @F.pandas_udf(T.DoubleType())
        def predict(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.score(np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)))

        return lambda df: df.withColumn("prediction", predict(*[col(f).cast("double") for f in self.features]))

    def gains(self) -> list[tuple[str, int, float]]:
        """(feature, splits, total gain), zero for unused features."""
        return [(f, int((self.feature == k).sum()), float(self.gain[self.feature == k].sum())) for k, f in enumerate(self.features)]

    def first(self, rounds: int) -> Forest:
        return replace(self, **{n: getattr(self, n)[:rounds] for n in ("feature", "cut", "value", "cover", "gain")})


@dataclass
class Run:
    """What all passes need to know of the models, by batch of models."""

    settings: list[Settings]
    folds: np.ndarray  # the fold a model leaves out; -1 for none
    base: np.ndarray
    bins: list[int]  # bins of each feature
    seed: int

    def columns(self, turn: int) -> np.ndarray:
        """models x features: which features the tree of a round may use."""
        d = len(self.bins)
        order = np.argsort(lane_array(np.arange(d), np.array([turn]), self.seed + COLUMN_STREAM)[:, 0], kind="stable")
        out = np.zeros((len(self.settings), d), bool)
        for m, s in enumerate(self.settings):
            out[m, order[: max(1, int(s.colsample_bytree * d + 1e-9))]] = True
        return out


@dataclass
class Cell:
    batch: int
    models: slice
    ids: np.ndarray
    bins: np.ndarray  # features x rows
    y: np.ndarray
    fold: np.ndarray  # -1 outside the training part
    margin: np.ndarray  # models x rows


@dataclass
class Trees:
    """The growing trees of all models in one round."""

    feature: np.ndarray
    bin: np.ndarray  # rows of up to this bin go left
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Trees:
        shape = (models, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), *(np.zeros(shape) for _ in range(3)))

    def of(self, models: slice) -> Trees:
        return Trees(*(getattr(self, n)[models] for n in ("feature", "bin", "value", "cover", "gain")))

    def open(self, level: int) -> bool:
        """Whether any node of a level was split."""
        return bool((self.feature[:, 2**level - 1 : 2 ** (level + 1) - 1] >= 0).any())


def _walk(trees: Trees, models: slice, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node of every row, models x rows, after at most ``levels`` steps.

    A level has few nodes, so each is compared with all rows at once; in bytes that is faster than looking nodes up by row.
    """
    feature, cut = trees.feature[models], trees.bin[models]
    m, n = feature.shape[0], bins.shape[1]
    node = np.zeros((m, n), np.uint8 if feature.shape[1] < 256 else np.int32)
    for k in range(m):
        full = True
        for level in range(levels):
            full = _step(feature[k], cut[k], bins, node[k], level, full)
            if full is None:
                break
    return node


def _step(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, spot: np.ndarray, level: int, full: bool) -> bool | None:
    """Moves the rows of a level one down, in place. ``full``: no row rests above; returned for the next level, None if nothing moves."""
    first = 2**level - 1
    split = np.flatnonzero(feature[first : 2 * first + 1] >= 0) + first
    full = full and len(split) == first + 1
    if not len(split):
        return None
    right, moves = np.zeros(len(spot), bool), np.zeros(len(spot), bool)
    for at in split.tolist():
        beyond = bins[feature[at]] > int(cut[at])
        if level:
            here = spot == at
            if not full:
                moves |= here
            beyond &= here
        right |= beyond
    if full or not level:
        spot *= 2
        spot += 1
        spot += right
    else:
        np.copyto(spot, 2 * spot + 1 + right, where=moves, casting="unsafe")
    return full


def _sampled(cell: Cell, run: Run, turn: int) -> list[np.ndarray]:
    """Rows that each model's tree of this round is grown on."""
    settings = run.settings[cell.models]
    rates = [s.subsample for s in settings]
    if min(rates) < 1:
        lane = lane_array(cell.ids, np.array([turn]), run.seed + ROW_STREAM)[:, 0] / float(PRIME)
    train, found = cell.fold >= 0, {}
    out = []
    for rate, fold in zip(rates, run.folds[cell.models].tolist()):
        if (rate, fold) not in found:
            kept = train & (cell.fold != fold)
            found[rate, fold] = np.flatnonzero(kept & (lane < rate) if rate < 1 else kept)
        out.append(found[rate, fold])
    return out


def _histogram(cell: Cell, run: Run, trees: Trees, level: int, turn: int) -> np.ndarray:
    """Sums of gradients and counts in a row: of each feature a block of 2 x models x nodes x bins."""
    m, nodes = cell.margin.shape[0], 2**level
    allowed = run.columns(turn)[cell.models]
    deep = [s.max_depth > level for s in run.settings[cell.models]]
    node = _walk(trees, cell.models, cell.bins, level) if level else None
    blocks = [np.zeros((2, m, nodes * b)) for b in run.bins]
    taken: dict[int, list[np.ndarray]] = {}  # bins of the last rows; models of a fold share their rows
    last = None
    for k, rows in enumerate(_sampled(cell, run, turn)):
        if not deep[k]:
            continue
        if rows is not last:
            last, taken = rows, {}
        whole = True
        if level:
            place = node[k][rows].astype(np.intp) - (nodes - 1)
            if not (trees.feature[cell.models.start + k, nodes // 2 - 1 : nodes - 1] >= 0).all():  # some rows rest in leaves above
                whole, reached = False, place >= 0
                rows, place = rows[reached], place[reached]
        gradient = cell.margin[k][rows]
        gradient -= cell.y[rows]
        for f, b in enumerate(run.bins):
            # The first feature also gives the totals of the nodes.
            if f and not allowed[k, f]:
                continue
            if whole:
                if f not in taken:
                    taken[f] = cell.bins[f][rows]
                at = taken[f]
            else:
                at = cell.bins[f][rows]
            if level:
                at = place * b + at
            blocks[f][0, k] = np.bincount(at, gradient, nodes * b)
            blocks[f][1, k] = np.bincount(at, minlength=nodes * b)
    return np.concatenate([x.ravel() for x in blocks])


def _splits(sums: np.ndarray, run: Run, models: slice, allowed: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Best split of each model and node: feature (-1 for none), bin, gain, G, H, left G, left H."""
    settings, nodes = run.settings[models], 2**level
    m = len(settings)
    shape = (m, nodes)
    l2 = np.array([s.reg_lambda for s in settings])[:, None, None]
    deep = np.array([s.max_depth for s in settings]) > level
    best = np.full(shape, LEAST_GAIN)
    feature, cut = np.full(shape, -1, np.int16), np.zeros(shape, np.int16)
    left = np.zeros((2, *shape))
    blocks, start = [], 0
    for b in run.bins:
        blocks.append(sums[start : start + 2 * m * nodes * b].reshape(2, m, nodes, b))
        start += 2 * m * nodes * b
    total = blocks[0].sum(axis=3)
    some = max(1, STEP_BINS // (nodes * max(run.bins)))  # models at a time, so that the work stays in the cache
    for f, block in enumerate(blocks):
        wanted = np.flatnonzero(allowed[:, f] & deep)
        if block.shape[3] < 2:
            continue
        for k in range(0, len(wanted), some):
            at = wanted[k : k + some]
            gl, hl = block[0, at, :, :-1].cumsum(axis=2), block[1, at, :, :-1].cumsum(axis=2)
            g, h, ridge = total[0, at][..., None], total[1, at][..., None], l2[at]
            right, hr = g - gl, h - hl
            none = hl < LEAST_ROWS
            none |= hr < LEAST_ROWS
            with np.errstate(divide="ignore", invalid="ignore"):
                right *= right
                hr += ridge
                right /= hr
                gain = gl * gl
                gain /= hl + ridge
                gain += right
                gain -= g * g / (h + ridge)
            np.putmask(gain, none, -np.inf)
            spot = gain.argmax(axis=2)
            pick = spot + np.arange(spot.size).reshape(spot.shape) * gain.shape[2]
            top = gain.take(pick)
            better = top > best[at] * (1 + 1e-12)
            best[at] = np.where(better, top, best[at])
            feature[at] = np.where(better, f, feature[at])
            cut[at] = np.where(better, spot, cut[at])
            for side, values in enumerate((gl, hl)):
                left[side, at] = np.where(better, values.take(pick), left[side, at])
    return feature, cut, np.where(feature >= 0, best, 0.0), total[0], total[1], left[0], left[1]


def _advanced(cell: Cell, trees: Trees, depth: int) -> Cell:
    node = _walk(trees, cell.models, cell.bins, depth)
    value = trees.value[cell.models]
    margin = cell.margin.copy()
    for k in range(len(node)):
        margin[k] += value[k].take(node[k])
    return replace(cell, margin=margin)


def _place(trees: Trees, run: Run, models: slice, level: int, splits: tuple[np.ndarray, ...]) -> None:
    """Writes the splits of a level, and the values of what is below."""
    feature, cut, gain, g, h, gl, hl = splits
    l2 = np.array([s.reg_lambda for s in run.settings[models]])[:, None]
    rate = np.array([s.learning_rate for s in run.settings[models]])[:, None]
    first, nodes = 2**level - 1, 2**level
    here, split = slice(first, first + nodes), feature >= 0
    trees.feature[models, here], trees.bin[models, here], trees.gain[models, here] = feature, cut, gain
    with np.errstate(divide="ignore", invalid="ignore"):
        if level == 0:
            trees.cover[models, 0:1] = h
            trees.value[models, 0:1] = np.where(h > 0, -g / (h + l2) * rate, 0.0)
        for side, gs, hs in ((0, gl, hl), (1, g - gl, h - hl)):
            at = slice(2 * first + 1 + side, 2 * first + 1 + 2 * nodes, 2)
            trees.cover[models, at] = np.where(split, hs, 0.0)
            trees.value[models, at] = np.where(split, -gs / (hs + l2) * rate, 0.0)


def _rounds(cell: Cell, run: Run, turn: int, count: int, keep: Sequence[int]) -> tuple[Cell, list[tuple[int, list[Trees]]]]:
    """Rounds of a batch whose rows are all in one block, and the trees of its models in ``keep``."""
    models, own = cell.models, slice(0, cell.margin.shape[0])
    run = replace(run, settings=run.settings[models], folds=run.folds[models], base=run.base[models])
    cell = replace(cell, models=own)
    kept = [(m, []) for m in keep if models.start <= m < models.stop]
    depth = max(s.max_depth for s in run.settings)
    for t in range(turn, turn + count):
        trees, allowed = Trees.empty(own.stop, depth), run.columns(t)
        for level in range(depth):
            _place(trees, run, own, level, _splits(_histogram(cell, run, trees, level, t), run, own, allowed, level))
            if not trees.open(level):
                break
        cell = _advanced(cell, trees, depth)
        for m, grown in kept:
            grown.append(trees.of(slice(m - models.start, m - models.start + 1)))
    return replace(cell, models=models), kept


def _errors(cell: Cell, run: Run) -> np.ndarray:
    """models x (n, y, y^2, squared error, absolute error) over the rows a model left out."""
    out = np.zeros((cell.margin.shape[0], 5))
    for k, fold in enumerate(run.folds[cell.models].tolist()):
        held = (cell.fold == fold) & (cell.fold >= 0)
        y, gap = cell.y[held], cell.y[held] - cell.margin[k][held]
        out[k] = held.sum(), y.sum(), (y * y).sum(), (gap * gap).sum(), np.abs(gap).sum()
    return out


def bin_cuts(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending cut values of each feature at equal shares, from one mergeable sketch."""
    shares = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)])
    row = df.agg(*[F.percentile_approx(col(f).cast("double"), shares, ACCURACY).alias(f"q{k}") for k, f in enumerate(features)],
                 *[F.min(col(f).cast("double")).alias(f"l{k}") for k, f in enumerate(features)]).first()
    out = []
    for k in range(len(features)):
        found = np.unique(np.array(row[f"q{k}"] or [], float))
        out.append(found[found > row[f"l{k}"]] if len(found) else found)  # nothing lies below the least value
    return out


def _run(df: DataFrame, target: str, cuts: list[np.ndarray], settings: Sequence[Settings], folds: Sequence[int], seed: int) -> Run:
    """The models, each with the mean of its training rows as its base."""
    by_fold = {r["fold"]: (r["n"], r["s"]) for r in df.filter("fold >= 0").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(col(target).cast("double")).alias("s")).collect()}
    sums = np.array(list(by_fold.values())).reshape(-1, 2)
    if not len(sums):
        raise ValueError("no training rows")
    base = []
    for k in folds:
        n, s = sums.sum(axis=0) - np.array(by_fold.get(k, (0, 0.0)))
        base.append(s / n if n else 0.0)
    return Run(list(settings), np.array(list(folds)), np.array(base), [len(c) + 1 for c in cuts], seed)


def _columns_of(pdf: pd.DataFrame, features: Sequence[str], target: str, case_id: str, cuts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """ids, bins, y, fold of some rows."""
    bins = np.stack([np.searchsorted(c, pdf[f].to_numpy(dtype=float), side="right") for f, c in zip(features, cuts)])
    bins = bins.astype(np.uint8 if max(len(c) for c in cuts) < 256 else np.int32)
    return pdf[case_id].to_numpy(dtype=np.int64), bins, pdf[target].to_numpy(dtype=float), pdf["fold"].to_numpy(dtype=np.int32)


def _rows_of(df: DataFrame, features: Sequence[str], target: str, case_id: str) -> DataFrame:
    return df.select(col(case_id).cast("long").alias(case_id), *[col(f).cast("double").alias(f) for f in features], col(target).cast("double").alias(target), "fold")


@dataclass
class Points:
    """All rows of a table, those with equal bins as one point."""

    bins: np.ndarray  # features x points
    start: np.ndarray  # of the rows' random numbers, see ``lane_start``; rows are sorted by point and fold
    high: np.ndarray | None
    y: np.ndarray
    fold: np.ndarray
    point: np.ndarray  # of each row
    starts: np.ndarray  # the first row of each part: the rows of a point in a fold
    place: np.ndarray  # fold x points + point of each part
    folds: int

    @classmethod
    def of(cls, ids: np.ndarray, bins: np.ndarray, y: np.ndarray, fold: np.ndarray, seed: int) -> Points:
        """``fold``: 0 or more."""
        order = np.lexsort((ids, fold, *bins))
        ids, bins, y, fold = ids[order], bins[:, order], y[order], fold[order]
        new = np.ones(len(ids), bool)
        new[1:] = (bins[:, 1:] != bins[:, :-1]).any(axis=0)
        part = new.copy()
        part[1:] |= fold[1:] != fold[:-1]
        first = np.flatnonzero(new)
        # By their least ids: sums over runs of one bin are slower than over mixed ones.
        order = np.argsort(np.minimum.reduceat(ids, first), kind="stable")
        rank = np.empty(len(order), np.intp)
        rank[order] = np.arange(len(order))
        bins, point = np.ascontiguousarray(bins[:, first[order]]), rank[np.cumsum(new) - 1]
        order = np.argsort(point, kind="stable")
        ids, y, fold, point, starts = ids[order], y[order], fold[order], point[order], np.flatnonzero(part[order])
        return cls(bins, *lane_start(ids, seed + ROW_STREAM), y, fold, point, starts, fold[starts] * bins.shape[1] + point[starts], int(fold.max()) + 1)

    def drawn(self, rate: float, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """folds and their sum x points: numbers of rows and sums of targets among the rows that a round samples."""
        if rate < 1:
            n = np.empty(len(self.y))
            for k in range(0, len(n), STEP_BINS):  # what stays in the cache is faster
                at = slice(k, k + STEP_BINS)
                n[at] = lanes(self.start[at], None if self.high is None else self.high[at], np.array([turn]))[:, 0] / float(PRIME) < rate
            y = n * self.y
        else:
            n, y = np.ones(len(self.y)), self.y
        size = self.bins.shape[1]
        out = np.zeros((2, (self.folds + 1) * size))
        for k, values in enumerate((n, y)):
            out[k, self.place] = np.add.reduceat(values, self.starts)
        n, y = out.reshape(2, self.folds + 1, size)
        for x in (n, y):
            x[:-1].sum(axis=0, out=x[-1])
        return n, y


@dataclass
class Drawn:
    """The points that the models of one fold use in a round."""

    at: np.ndarray | None  # None: all of them
    n: np.ndarray | None  # rows of each; None: one
    y: np.ndarray
    bins: np.ndarray
    counts: list[np.ndarray]  # rows by bin, for each feature

    @classmethod
    def of(cls, points: Points, n: np.ndarray, y: np.ndarray, fold: int, widths: list[int]) -> Drawn:
        """``n`` and ``y`` by fold; the last rows hold the sums of all folds."""
        bins, at = points.bins, None
        n, y = (x[-1] - x[fold] if 0 <= fold < points.folds else x[-1] for x in (n, y))
        used = np.flatnonzero(n)
        if len(used) < 0.9 * len(n):
            at, n, y, bins = used, n[used], y[used], bins[:, used]
        if len(n) and n.min() == n.max() == 1:
            n = None
        return cls(at, n, y, bins, [np.bincount(x, n, b) for x, b in zip(bins, widths)])

    def gradient(self, margin: np.ndarray) -> np.ndarray:
        out = margin.copy() if self.at is None else margin[self.at]
        if self.n is not None:
            out *= self.n
        out -= self.y
        return out


def _point_sums(drawn: list[Drawn], gradients: list[np.ndarray], run: Run, node: np.ndarray, full: list[bool | None], level: int,
                allowed: np.ndarray) -> np.ndarray:
    """The sums of ``_histogram``, from points."""
    nodes = 2**level
    blocks = [np.zeros((2, len(drawn), nodes * b)) for b in run.bins]
    short = nodes * max(run.bins) <= 1 << 16 and all(d.bins.dtype == np.uint8 for d in drawn)
    kind = np.uint16 if short else np.intp  # places are worked out faster in two bytes
    for k, (d, gradients_of) in enumerate(zip(drawn, gradients)):
        if full[k] is None or run.settings[k].max_depth <= level:
            continue
        used = [f for f in range(len(run.bins)) if not f or allowed[k, f]]  # the first feature also gives the totals of the nodes
        for chunk in _chunks(len(gradients_of)):
            gradient, bins, n = gradients_of[chunk], d.bins[:, chunk], None if d.n is None else d.n[chunk]
            if level:
                place = node[k][chunk if d.at is None else d.at[chunk]]
                if not full[k]:  # some points rest in leaves above
                    reached = np.flatnonzero(place >= nodes - 1)
                    place, gradient, bins, n = place[reached], gradient[reached], bins[:, reached], None if n is None else n[reached]
                place = (place - (nodes - 1)).astype(kind)
            for f in used:
                b = run.bins[f]
                if not level:
                    blocks[f][0, k] += np.bincount(bins[f], gradient, b)
                    continue
                at = place * kind(b)
                at += bins[f]
                at = at.astype(np.intp)
                blocks[f][0, k] += np.bincount(at, gradient, nodes * b)
                blocks[f][1, k] += np.bincount(at, n, nodes * b)
        if not level:
            for f in used:
                blocks[f][1, k] = d.counts[f]
    return np.concatenate([x.ravel() for x in blocks])


def _chunks(size: int) -> Iterator[slice]:
    return (slice(k, min(k + CHUNK, size)) for k in range(0, size, CHUNK))


def _grow_points(points: Points, run: Run, ends: Sequence[int], keep: bool = False) -> Iterator[tuple[int, np.ndarray, list[Trees]]]:
    """Errors of all models of a run after each number of rounds, and with ``keep`` the trees since the last one.

    Their settings have one share of sampled rows.
    """
    m, size = len(run.settings), points.bins.shape[1]
    rate, own, turn = run.settings[0].subsample, slice(0, m), 0
    depth = max(s.max_depth for s in run.settings)
    margin = np.repeat(run.base[:, None], size, axis=1)
    groups: dict[int, Drawn] = {}
    kept: list[Trees] = []
    for end in ends:
        for turn in range(turn, end):
            if rate < 1 or not groups:
                n, y = points.drawn(rate, turn)
                groups = {k: Drawn.of(points, n, y, k, run.bins) for k in dict.fromkeys(run.folds.tolist())}
            drawn = [groups[k] for k in run.folds.tolist()]
            gradients = [d.gradient(x) for d, x in zip(drawn, margin)]
            trees, allowed = Trees.empty(m, depth), run.columns(turn)
            node = np.zeros((m, size), np.uint8 if trees.feature.shape[1] < 256 else np.int32)
            full: list[bool | None] = [True] * m
            for level in range(depth):
                _place(trees, run, own, level, _splits(_point_sums(drawn, gradients, run, node, full, level, allowed), run, own, allowed, level))
                for k in range(m):
                    if full[k] is not None:
                        full[k] = [_step(trees.feature[k], trees.bin[k], points.bins[:, c], node[k, c], level, full[k]) for c in _chunks(size)][-1]
                if not trees.open(level):
                    break
            for k in range(m):
                margin[k] += trees.value[k].take(node[k])
            if keep:
                kept.append(trees)
        turn = end
        errors = np.zeros((m, 5))
        for k, fold in enumerate(run.folds.tolist()):
            held = points.fold == fold
            y = points.y[held]
            gap = y - margin[k][points.point[held]]
            errors[k] = len(y), y.sum(), (y * y).sum(), (gap * gap).sum(), np.abs(gap).sum()
        yield end, errors, kept
        kept = []


def _dealt(settings: Sequence[Settings], tasks: int) -> list[list[int]]:
    """The models of each task: of one depth and one share of sampled rows, the deepest first."""
    kinds: dict[tuple[int, float], list[int]] = {}
    for k, s in enumerate(settings):
        kinds.setdefault((s.max_depth, s.subsample), []).append(k)
    each = -(-tasks // len(kinds))
    out = []
    for kind in sorted(kinds, key=lambda k: (-k[0], k[1])):
        models = kinds[kind]
        size = -(-len(models) // each)
        out += [models[k : k + size] for k in range(0, len(models), size)]
    return out


def _grow_alone(df: DataFrame, features: Sequence[str], target: str, case_id: str, cuts: list[np.ndarray], run: Run, ends: Sequence[int],
                keep: bool = False) -> tuple[dict[int, np.ndarray], list[Trees]]:
    """Errors (models x 5, see ``Booster.errors``) after each number of rounds; every task has all training rows and some of the models.

    With ``keep`` also the trees of a run of one model.
    """
    batches, features = _dealt(run.settings, WAVES * df.sparkSession.sparkContext.defaultParallelism), list(features)
    parts = len(batches)

    def binned(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            piece = _columns_of(batch.to_pandas(), features, target, case_id, cuts)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(piece, 5)], pa.binary())], names=["piece"])

    def grown(part: int, pieces: Iterator[bytes]) -> Iterator[tuple]:
        columns = list(zip(*(pickle.loads(p) for p in pieces)))
        if not columns:  # more partitions than were asked for
            return
        points = Points.of(*(np.concatenate(c, axis=-1) for c in columns), run.seed)
        del columns
        some = max(1, MARGINS // points.bins.shape[1])
        for k in range(0, len(batches[part]), some):
            models = batches[part][k : k + some]
            own = replace(run, settings=[run.settings[m] for m in models], folds=run.folds[models], base=run.base[models])
            for end, errors, trees in _grow_points(points, own, ends, keep):
                yield end, models, errors, trees

    pieces = _rows_of(df.filter("fold >= 0"), features, target, case_id).mapInArrow(binned, "piece binary").rdd
    dealt = pieces.flatMap(lambda r: ((k, bytes(r[0])) for k in range(parts))).partitionBy(parts, lambda k: k)
    out, kept = {end: np.zeros((len(run.settings), 5)) for end in ends}, []
    for end, models, errors, trees in dealt.values().mapPartitionsWithIndex(grown).collect():
        out[end][models] = errors
        kept += trees
    return out, kept


class Booster:
    """Grows the models of a run over cells of a table (case id, features, target, fold)."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, case_id: str, cuts: list[np.ndarray],
                 settings: Sequence[Settings], folds: Sequence[int], seed: int = 42, block: int = BLOCK, batch: int = BATCH):
        """``df``: the training part with a column ``fold``; more rows may carry fold -1."""
        self.features, self.cuts = list(features), cuts
        spark = df.sparkSession
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(scratch_root(spark))
        self.run = _run(df, target, cuts, settings, folds, seed)
        batches = [slice(k, min(k + batch, len(settings))) for k in range(0, len(settings), batch)]
        starts, bases = self.cuts, self.run.base

        def binned(frames):
            for pdf in frames:
                for at in range(0, len(pdf), block):
                    part = pdf.iloc[at : at + block]
                    ids, bins, y, fold = _columns_of(part, features, target, case_id, starts)
                    for b, models in enumerate(batches):
                        yield Cell(b, models, ids, bins, y, fold, np.repeat(bases[models][:, None], len(ids), axis=1))

        rows = _rows_of(df, features, target, case_id)
        self.blocks = -(-rows.count() // block)
        cores = spark.sparkContext.defaultParallelism
        if self.blocks <= cores:  # few rows: whole blocks, so that no pass has more tasks than it needs
            rows = rows.repartition(max(1, self.blocks))
        else:
            rows = spread(rows)  # every pass waits for the longest task

        def packed(batches_in):
            held, size = [], 0
            for b in batches_in:
                held.append(b)
                size += b.num_rows
                if size >= block:
                    frame = pa.Table.from_batches(held).to_pandas()
                    held, size = [], 0
                    for cell in binned([frame]):
                        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(cell, 5)], pa.binary())], names=["cell"])
            if size:
                for cell in binned([pa.Table.from_batches(held).to_pandas()]):
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(cell, 5)], pa.binary())], names=["cell"])

        cells = rows.mapInArrow(packed, "cell binary").rdd.map(lambda r: pickle.loads(r[0]))
        if len(batches) > 1 and self.blocks <= cores:
            # One by one: a plain repartition would move pickled batches of cells.
            parts = min(len(batches) * self.blocks, 8 * cores)
            cells = cells.map(lambda c: (c.batch + int(c.ids[0]), c)).partitionBy(parts, lambda k: k).values()
        self.cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks = self.cells.map(lambda c: c.batch == 0).sum()
        self.turn, self.saved, self._older = 0, None, None

    def _pass(self, trees: Trees, level: int, allowed: np.ndarray) -> list:
        run, turn = self.run, self.turn

        def local(cells):
            sums: dict[int, tuple[slice, np.ndarray]] = {}
            for cell in cells:
                part = _histogram(cell, run, trees, level, turn)
                if cell.batch in sums:
                    sums[cell.batch][1].__iadd__(part)
                else:
                    sums[cell.batch] = cell.models, part
            return list(sums.items())

        def best(item):
            _, (models, sums) = item
            return models, _splits(sums, run, models, allowed[models], level)

        sums = self.cells.mapPartitions(local)
        parts = self.cells.getNumPartitions()
        size = 16 * len(run.settings) * 2**level * sum(run.bins)
        if self.blocks > 1 and parts * size <= DRIVER_BYTES:  # few and small: one stage, added up in the order of the tasks
            held: dict[int, tuple[slice, np.ndarray]] = {}
            for b, (models, part) in sums.collect():
                if b in held:
                    held[b][1].__iadd__(part)
                else:
                    held[b] = models, part
            return [best(item) for item in held.items()]
        if self.blocks > 1:  # two levels: some tasks' sums meet first, then those of a batch
            near = max(1, int(parts**0.5))
            add = lambda a, b: (a[0], a[1] + b[1])
            sums = sums.mapPartitionsWithIndex(lambda k, items: (((b, k % near), v) for b, v in items))
            sums = sums.reduceByKey(add, max(1, min(parts, near * 4))).map(lambda x: (x[0][0], x[1])).reduceByKey(add, max(1, min(parts, 8)))
        return sums.map(best).collect()

    def round(self) -> Trees:
        """Grows one tree for every model, level by level over all blocks, and moves the margins on."""
        run = self.run
        depth = max(s.max_depth for s in run.settings)
        trees = Trees.empty(len(run.settings), depth)
        allowed = run.columns(self.turn)
        for level in range(depth):
            for models, splits in self._pass(trees, level, allowed):
                _place(trees, run, models, level, splits)
            if not trees.open(level):
                break
        before = self.cells
        self.cells = before.map(lambda cell: _advanced(cell, trees, depth)).persist(StorageLevel.MEMORY_AND_DISK)
        self.turn += 1
        if self.turn % KEEP == 0:
            self._checkpoint(before)
        elif self.turn % KEEP > 1:
            self._older.unpersist()
        self._older = before
        return trees

    def grow(self, rounds: int, keep: Sequence[int] = ()) -> list[list[Trees]]:
        """More rounds for all models; the new trees of the models named in ``keep``."""
        kept: list[list[Trees]] = [[] for _ in keep]
        end = self.turn + rounds
        while self.turn < end:
            if self.blocks > 1:
                trees = self.round()
                for k, m in enumerate(keep):
                    kept[k].append(trees.of(slice(m, m + 1)))
                continue
            run, turn, step, before = self.run, self.turn, min(KEEP, end - self.turn), self.cells
            grown = before.map(lambda cell: _rounds(cell, run, turn, step, keep)).persist(StorageLevel.MEMORY_AND_DISK)
            for m, trees in grown.flatMap(lambda x: x[1]).collect():
                kept[keep.index(m)] += trees
            self.cells = grown.map(lambda x: x[0]).persist(StorageLevel.MEMORY_AND_DISK)
            self._checkpoint(before)
            grown.unpersist()
            self.turn += step
        return kept

    def _checkpoint(self, before) -> None:
        self.cells.checkpoint()
        self.cells.count()
        saved = self.cells.getCheckpointFile()
        self._forget()
        self.saved = saved
        before.unpersist()

    def _forget(self) -> None:
        if self.saved:
            context = self.cells.context
            place = context._jvm.org.apache.hadoop.fs.Path(self.saved)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
            self.saved = None

    def errors(self) -> np.ndarray:
        """models x (n, y, y^2, squared error, absolute error) on the fold that a model left out."""
        run = self.run
        parts = self.cells.map(lambda c: (c.batch, (c.models, _errors(c, run)))).reduceByKey(lambda a, b: (a[0], a[1] + b[1])).values().collect()
        out = np.zeros((len(run.settings), 5))
        for models, sums in parts:
            out[models] = sums
        return out

    def close(self) -> None:
        self.cells.unpersist()
        if self._older is not None:
            self._older.unpersist()
        self._forget()

    def forest(self, grown: Sequence[Trees], model: int) -> Forest:
        return _forest(self.features, self.cuts, self.run, grown, model)


def _forest(features: Sequence[str], cuts: list[np.ndarray], run: Run, grown: Sequence[Trees], model: int) -> Forest:
    """What the kept trees of a model amount to."""
    nodes = 2 ** (run.settings[model].max_depth + 1) - 1
    pick = lambda n: np.stack([getattr(t, n)[0, :nodes] for t in grown]) if grown else np.zeros((0, nodes))
    feature, bins = pick("feature").astype(np.int64), pick("bin").astype(np.int64)
    cut = np.zeros(feature.shape)
    for f, values in enumerate(cuts):
        here = feature == f
        cut[here] = values[bins[here]] if len(values) else 0.0
    return Forest(list(features), float(run.base[model]), feature, cut, pick("value"), pick("cover"), pick("gain"))


def fold_scores(errors: np.ndarray) -> np.ndarray:
    """models x (r2, rmse, mae) from sums over held-out rows; no r2 without spread."""
    n, y, yy, sse, sae = errors.T
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = yy - y * y / n
        r2 = np.where(spread > 0, 1 - sse / spread, np.nan)
        return np.stack([r2, np.sqrt(sse / n), sae / n], axis=1)


def boost(df: DataFrame, features: Sequence[str], target: str, case_id: str, settings: Settings, folds: int, seed: int = 42,
          max_bins: int = MAX_BINS) -> tuple[Forest, np.ndarray]:
    """The forest on all training rows, and (fold, r2, rmse, mae) of the models that leave a fold out; one run for all."""
    cuts = bin_cuts(df.filter("fold >= 0"), features, max_bins)
    booster = Booster(df, features, target, case_id, cuts, [settings] * (folds + 1), [-1, *range(folds)], seed)
    grown = booster.grow(settings.n_estimators, [0])[0]
    scores = fold_scores(booster.errors())[1:]
    forest = booster.forest(grown, 0)
    booster.close()
    return forest, scores


def fit_point(df: DataFrame, features: Sequence[str], target: str, case_id: str, settings: Settings, seed: int = 42, max_bins: int = MAX_BINS) -> Forest:
    """The forest of ``boost``, for the point that a grid has chosen: up to ``ALONE`` rows it grows in one task, without passes."""
    train = df.filter("fold >= 0")
    if train.count() > ALONE:
        return boost(df, features, target, case_id, settings, 0, seed, max_bins)[0]
    cuts = bin_cuts(train, features, max_bins)
    run = _run(train, target, cuts, [settings], [-1], seed)
    _, grown = _grow_alone(train, features, target, case_id, cuts, run, [settings.n_estimators], keep=True)
    return _forest(features, cuts, run, grown, 0)


def search_grid(df: DataFrame, features: Sequence[str], target: str, case_id: str, points: Sequence[Settings], folds: int,
                seed: int = 42, max_bins: int = MAX_BINS) -> np.ndarray:
    """points x (r2, rmse, mae), means over folds. Points that differ in the number of trees only share a model."""
    train = df.filter("fold >= 0")  # the other rows have no part in a validation
    cuts = bin_cuts(train, features, max_bins)
    kinds = list(dict.fromkeys(replace(p, n_estimators=0) for p in points))
    kinds.sort(key=lambda s: -s.max_depth)  # models of one depth share batches; the longest start first
    ends = sorted({p.n_estimators for p in points})
    models, left_out = [k for k in kinds for _ in range(folds)], [f for _ in kinds for f in range(folds)]
    found: dict[tuple[Settings, int], np.ndarray] = {}

    def scored(end: int, errors: np.ndarray) -> None:
        for kind, rows in zip(kinds, fold_scores(errors).reshape(len(kinds), folds, 3)):
            found[kind, end] = rows.mean(axis=0)

    if train.count() <= ALONE:
        run = _run(train, target, cuts, models, left_out, seed)
        for end, errors in _grow_alone(train, features, target, case_id, cuts, run, ends)[0].items():
            scored(end, errors)
    else:
        booster = Booster(train, features, target, case_id, cuts, models, left_out, seed)
        for end in ends:
            booster.grow(end - booster.turn)
            scored(end, booster.errors())
        booster.close()
    return np.array([found[replace(p, n_estimators=0), p.n_estimators] for p in points])
