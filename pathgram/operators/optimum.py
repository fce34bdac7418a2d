"""Response optimum of a predictor in the observed box: exact for trees, a population search for formulas.

Trees. A forest is constant on the cells between its cuts. Boxes of cells are bounded by the best leaf that each tree
could still give; tasks search their boxes best first for a bounded number of steps and hand back what is open and
their best point; the next generation starts from all open boxes that can still win. It ends when none is left, so the
result is exact for any width.

Formulas. First every setting of up to ``strength`` features at their ends, over three settings of the others, and
low-discrepancy points: jumps that need several features at once are met for any number of features. Then a population:
each generation's children are rows of a DataFrame, mixed and mutated by hash, with steps that shrink.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathgram.functions.columns import col
from pathgram.operators.boosting import Forest
from pathgram.operators.boxes import Boxes, leaf_boxes
from pathgram.operators.sensitivity import WIDTH, alphas, box, low_discrepancy
from pathgram.operators.trees import Predictor
from pathgram.session import discard, materialise

#: Best points that one generation hands to the next, and the shrinking of its steps.
ELITE, SHRINK = 24, 0.62
GENERATIONS = 36
#: Boxes that a task splits at a time, and how often, before it hands back what is open.
SPLIT, STEPS = 256, 60
Ends = list[tuple[float, float, bool]]


def search_box(df: DataFrame, features: Sequence[str], whole: bool = True) -> Ends:
    """(low, high, whole-numbered). A whole-numbered feature keeps to whole numbers inside its range."""
    out = []
    for low, high, is_whole in box(df, features):
        first, last = float(math.ceil(low)), float(math.floor(high))
        out.append((first, last, True) if whole and is_whole and first <= last else (low, high if high > low else low + WIDTH, False))
    return out


# --- trees


def cells_of(boxes: Boxes, ends: Ends) -> list[np.ndarray]:
    """For each feature a value in every cell between the forest's cuts, ascending; cells without a value are left out."""
    out = []
    for f, (low, high, whole) in enumerate(ends):
        here = boxes.feature == f
        cuts = np.unique(np.concatenate([boxes.low[here], boxes.high[here]]))
        cuts = cuts[(cuts > low) & (cuts <= high)]
        starts = np.concatenate([[low], cuts])
        stops = np.concatenate([cuts, [np.inf]])
        values = np.ceil(starts) if whole else starts
        out.append(values[(values < stops) & (values <= high)])
    return out


class Bounds:
    """What a forest can give on boxes of cells."""

    def __init__(self, boxes: Boxes, cells: list[np.ndarray], sign: float):
        self.feature, self.value, self.starts, self.base = boxes.feature, sign * boxes.value, boxes.starts, sign * boxes.base
        self.first, self.last = np.zeros(boxes.feature.shape, np.int64), np.zeros(boxes.feature.shape, np.int64)
        for f, values in enumerate(cells):
            here = boxes.feature == f
            self.first[here] = np.searchsorted(values, boxes.low[here], side="left")
            self.last[here] = np.searchsorted(values, boxes.high[here], side="left") - 1
        self.sizes = np.array([len(v) for v in cells])
        used = np.bincount(boxes.feature.ravel(), np.where(np.isfinite(boxes.low) | np.isfinite(boxes.high), np.abs(boxes.value)[:, None], 0).ravel(), len(cells))
        self.weight = used / np.maximum(self.sizes, 1)

    def most(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.full(len(low), self.base)
        if not len(self.value):
            return out
        for at in range(0, len(low), 64):
            a, b = low[at : at + 64], high[at : at + 64]
            met = np.ones((len(a), len(self.value)), bool)
            for s in range(self.feature.shape[1]):
                f = self.feature[:, s]
                met &= (a[:, f] <= self.last[:, s]) & (b[:, f] >= self.first[:, s])
            out[at : at + 64] += np.maximum.reduceat(np.where(met, self.value, -np.inf), self.starts, axis=1).sum(axis=1)
        return out

    def split(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves of boxes along the feature that matters most; single cells give nothing."""
        room = (high - low) * self.weight[None, :] + np.where(high > low, 1e-9, 0) * (high - low)
        f, rows = room.argmax(axis=1), np.arange(len(low))
        open_ = high[rows, f] > low[rows, f]
        low, high, f = low[open_], high[open_], f[open_]
        rows = np.arange(len(low))
        middle = (low[rows, f] + high[rows, f]) // 2
        left_high, right_low = high.copy(), low.copy()
        left_high[rows, f], right_low[rows, f] = middle, middle + 1
        return np.concatenate([low, right_low]), np.concatenate([left_high, high])


def _search(batches, bounds: Bounds, best: float, split: int, steps: int):
    width = len(bounds.sizes)
    slack = 1e-9 * max(1.0, abs(best))
    for batch in batches:
        rows = batch.to_pylist()
        low, high = (np.array([r[c] for r in rows], np.int64).reshape(-1, width) for c in ("low", "high"))
        most = np.array([r["most"] for r in rows], float)
        found, at = best, None
        for _ in range(steps):
            live = most > found + slack
            low, high, most = low[live], high[live], most[live]
            if not len(low):
                break
            order = np.argsort(-most, kind="stable")
            top, rest = order[:split], order[split:]
            a, b = bounds.split(low[top], high[top])
            middle = (a + b) // 2
            value = bounds.most(middle, middle)
            if len(value) and value.max() > found:
                found, at = float(value.max()), middle[int(value.argmax())]
            low, high = np.concatenate([low[rest], a]), np.concatenate([high[rest], b])
            most = np.concatenate([most[rest], bounds.most(a, b)])
        live = most > found + slack
        out = [(lo, hi, m, False) for lo, hi, m in zip(low[live].tolist(), high[live].tolist(), most[live].tolist())]
        if at is not None:
            out.append((at.tolist(), at.tolist(), found, True))
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["low", "high", "most", "point"])


def tree_optimum(df: DataFrame, forest: Forest, whole: bool = True, split: int = SPLIT, steps: int = STEPS) -> DataFrame:
    """(goal, value, features...): smallest and largest prediction of a forest, exact.

    Of the points with the best value the first that was found is given; its features stand at the lower ends of their cells.
    """
    spark, features = df.sparkSession, forest.features
    ends = search_box(df, features, whole)
    boxes = leaf_boxes(forest)
    cells = cells_of(boxes, ends)
    rows = []
    for goal, sign in (("min", -1.0), ("max", 1.0)):
        bounds = Bounds(boxes, cells, sign)
        low, high = np.zeros((1, len(cells)), np.int64), (bounds.sizes - 1)[None, :]
        tries = np.random.default_rng(0).integers(0, bounds.sizes, (2048, len(cells)))
        values = bounds.most(tries, tries)
        best, at = float(values.max()), tries[int(values.argmax())]
        schema = "low array<long>, high array<long>, most double, point boolean"
        start = [(low[0].tolist(), high[0].tolist(), float(bounds.most(low, high)[0]), False)]
        frontier = materialise(spark.createDataFrame(start, schema), "optimum-boxes")
        while True:
            known = best
            tasks = max(1, min(frontier.count() // 8, 4 * spark.sparkContext.defaultParallelism) or 1)
            dealt = frontier.repartition(tasks, F.xxhash64("low", "high"))
            after = materialise(dealt.mapInArrow(lambda batches, b=bounds, k=known: _search(batches, b, k, split, steps), schema), "optimum-boxes")
            discard(frontier)
            point = after.filter("point").orderBy(F.col("most").desc(), "low").limit(1).collect()
            if point:
                best, at = point[0]["most"], np.array(point[0]["low"])
            frontier = after.filter(~F.col("point") & (F.col("most") > F.lit(best + 1e-9 * max(1.0, abs(best)))))
            if frontier.isEmpty():
                discard(after)
                break
            frontier.scratch_path = after.scratch_path
        spot = [float(v[k]) for v, k in zip(cells, at)]
        rows.append((goal, float(forest.score(np.array([spot]))[0]), *spot))
    return spark.createDataFrame(rows, "goal string, value double, " + ", ".join(f"`{f}` double" for f in features))


# --- formulas


def _kept(value: Column, low: float, high: float, whole: bool) -> Column:
    inside = F.least(F.lit(high), F.greatest(F.lit(low), value))
    return F.rint(inside) if whole else inside


def corner_sets(spark, features: Sequence[str], ends: Ends, strength: int) -> DataFrame:
    """Every setting of up to ``strength`` features at their ends, the others low, in the middle or high."""
    d = len(features)
    s = min(strength, d)
    ids = spark.range(d**s).select("id", *[F.expr(f"cast((id div {d**k}) % {d} as int)").alias(f"p{k}") for k in range(s)])
    for k in range(s - 1):  # one order of each choice; repeats are smaller choices
        ids = ids.filter(F.col(f"p{k}") <= F.col(f"p{k + 1}"))
    ids = ids.withColumn("pattern", F.explode(F.sequence(F.lit(0), F.lit(2**s - 1)))).withColumn("others", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    columns = []
    for f, (name, (low, high, whole)) in enumerate(zip(features, ends)):
        share = F.col("others")
        for k in range(s):
            share = F.when(F.col(f"p{k}") == f, F.shiftright("pattern", k).bitwiseAND(1).cast("double")).otherwise(share)
        columns.append(_kept(F.lit(low) + share * F.lit(high - low), low, high, whole).alias(name))
    return ids.select(*columns)


def scattered(spark, features: Sequence[str], ends: Ends, points: int) -> DataFrame:
    steps = alphas(len(features))
    return spark.range(points).select(*[
        _kept(F.lit(low) + low_discrepancy(F.col("id"), a) * F.lit(high - low), low, high, whole).alias(f)
        for f, a, (low, high, whole) in zip(features, steps, ends)])


def _mixed(ids: np.ndarray, *key: int) -> np.ndarray:
    """Uniform numbers of (id, key), the same in any task: rounds of multiply and shift over 64 bits."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)
        for k in key:
            x = (x ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def children(spark, features: Sequence[str], ends: Ends, elite: list[list[float]], turn: int, count: int, seed: int) -> DataFrame:
    """A generation: parents with a step along the difference of two others, and hashed moves of some features.

    Numbers come from the row's id, so they do not depend on partitions or retries.
    """
    reach, held = SHRINK**turn, np.array(elite, float)
    low, high = (np.array([e[k] for e in ends]) for k in (0, 1))
    whole = np.array([e[2] for e in ends])
    d = len(ends)

    def born(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own, one, two = (held[(_mixed(ids, seed, turn, 1, k) * len(held)).astype(int)] for k in range(3))
            draw = lambda kind: np.stack([_mixed(ids, seed, turn, 2 + kind, f) for f in range(d)], axis=1)
            bell = (draw(0) + draw(1) + draw(2) - 1.5) / 1.5  # the sum of three draws
            moved = (draw(3) < 0.3) | (ids[:, None] % d == np.arange(d))
            step = np.where(moved, bell * (high - low) * reach, 0.0)
            step = np.where(whole & moved & (np.abs(step) < 1), np.sign(bell), step)  # whole numbers keep moving by one
            style, pull = _mixed(ids, seed, turn, 8)[:, None], _mixed(ids, seed, turn, 9)[:, None]
            value = own + step + np.where(style < 0.4, pull * (one - two), 0.0)
            value = np.where((style > 0.95) & moved, low + draw(4) * (high - low), value)
            value = np.clip(np.where(whole, np.rint(value), value), low, high)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(value[:, f])) for f in range(d)], names=list(features))

    return spark.range(count).mapInArrow(born, ", ".join(f"`{f}` double" for f in features))


def formula_optimum(df: DataFrame, features: Sequence[str], predictor: Predictor, points: int = 4096, strength: int = 4,
                    generations: int = GENERATIONS, whole: bool = True, seed: int = 42) -> DataFrame:
    """(goal, value, features...): smallest and largest prediction found.

    Ends of up to ``strength`` features are tried together (their number grows with that power of the features); jumps
    away from the ends are met only if a point of the search falls on them.
    """
    spark, features = df.sparkSession, list(features)
    ends = search_box(df, features, whole)
    rows = []
    first = materialise(predictor(corner_sets(spark, features, ends, strength).unionByName(scattered(spark, features, ends, points))), "optimum-start")
    for goal, sign in (("min", 1.0), ("max", -1.0)):
        order = [F.col("prediction") * sign, *[col(f) for f in features]]
        sound = F.col("prediction").isNotNull() & ~F.isnan("prediction")

        def best(table: DataFrame) -> list[list[float]]:
            kept = table.filter(sound).select("prediction", *[col(f) for f in features]).dropDuplicates(features)
            return [[float(v) for v in r] for r in kept.orderBy(*order).limit(ELITE).collect()]

        top = best(first)
        if not top:
            rows.append((goal, None, *[None] * len(features)))
            continue
        count = 2048 + 128 * len(features)
        for turn in range(generations):
            born = best(predictor(children(spark, features, ends, [r[1:] for r in top], turn, count, seed)))
            # The few elites of both generations meet on the driver.
            top = sorted({tuple(r) for r in (*top, *born)}, key=lambda r: (sign * r[0], r[1:]))[:ELITE]
        rows.append((goal, *top[0]))
    discard(first)
    return spark.createDataFrame(rows, "goal string, value double, " + ", ".join(f"`{f}` double" for f in features))


def response_optimum(df: DataFrame, features: Sequence[str], predictor: Predictor | Forest, **settings) -> DataFrame:
    """(goal, value, features...) of a forest (exact) or of any other predictor (searched)."""
    if isinstance(predictor, Forest):
        return tree_optimum(df, predictor, **settings)
    return formula_optimum(df, features, predictor, **settings)


__all__ = ["formula_optimum", "response_optimum", "tree_optimum"]
