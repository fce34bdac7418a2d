"""Exact top-k by inner product over a pivot-distance index.

The index. Pivots are spread over a bounded sample. Every vector is keyed by its nearest pivot and its distance from
it; rows are range-sorted by that key and cut into annuli: up to ``ANNULUS`` neighbours of one pivot, packed in the
fewest bytes, with their least and largest distance and their largest norm. A pivot with a third of all vectors, or
copies of one vector, merely has more annuli.

The search. Queries are blocks of neighbours in the same order. A block first visits the annuli that its own queries
lie in, which gives every query a threshold. Blocks then meet pages of the annuli's directory; by the triangle
inequality, |q - c| is at least the gap between |q - p| and the annulus, so <q, c> is at most
(|q|^2 + max |c|^2 - gap^2) / 2, and at most <q, p> + |q| far and |q| max |c|. Annuli that no query of the block can gain from are
left out; the others are visited by growing gap, in cells of at most 64, each query stopping at the bound of its own
threshold. Thresholds only skip what cannot enter the result, so the result is exact for any pivots.

Rules: integer components are floor(scale * x). Vectors that are null or hold null, NaN or infinity take no part, nor
do those whose integer norm reaches 2 ** 31 (their products would not fit a long). A shorter vector counts as padded with zeros. A query
is one row; other rows with its id are candidates. Equal scores go by ascending id, null last. Only the named columns
are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathgram.session import discard, materialise

TOP = 20
SCALE = 64
#: Rows (by hash) from which the pivots are chosen, and the most pivots; both only matter for speed.
SAMPLE, MOST_PIVOTS = 2000, 256
#: Vectors of an annulus, queries of a block, annuli of a directory page and of a cell.
ANNULUS, QUERIES, PAGE, CELL = 2048, 512, 1024, 64
LOWEST = np.iinfo(np.int64).min
PACKED = "kind int, id long, pivot int, n int, near double, far double, top double, names binary, known binary, rows binary, m binary, homes array<long>"
HIT = "query long, row long, name long, score long"


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(row, name, v, square): valid vectors in integers with a row number, as a written table."""
    x = F.col("raw")
    sound = F.forall(x, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    rows = df.select(F.col(key).cast("long").alias("name"), F.col(vector).alias("raw")).filter(F.col("raw").isNotNull() & sound)
    rows = rows.select("name", v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    rows = rows.withColumn("square", square).filter(F.col("square") < 2.0**62)
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "name", "v", "square"), "pivot-vectors")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, in the narrowest arithmetic that keeps them exact."""
    most = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0))
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
    return np.rint(a.astype(kind) @ b.astype(kind).T).astype(np.int64) if kind != np.int64 else a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots, right to a millionth of the larger norm."""
    a, p = a.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * a @ p.T))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each pivot is the sample vector farthest from those before it."""
    chosen = [0]
    far = distances(sample, sample[:1])[:, 0]
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, short rows padded with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    cells = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[cells] = vectors.flatten().to_numpy()
    return out


def _pack(m: np.ndarray) -> bytes:
    most = int(np.abs(m).max(initial=0))
    kind = next(k for k, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1), ("<i8", 2**63 - 1)) if most <= top)
    return kind[2:].encode() + m.astype(kind).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).reshape(n, -1)


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _keyed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column(2)
        away = distances(matrix(v, pivots.shape[1]), pivots)
        near = away.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near]), v],
                                         names=["row", "name", "asks", "pivot", "away", "v"])


def _cut(batches: Iterator[pa.RecordBatch], width: int, annulus: int, queries: int) -> Iterator[pa.RecordBatch]:
    """Annuli (kind 0) and blocks of queries (kind 1) of a sorted range."""
    from pyspark import TaskContext

    context = TaskContext.get()
    serial = (context.partitionId() if context else 0) << 28
    held: list[tuple] = []  # (row, name, known, asks, pivot, away, vector) column pieces
    size = 0
    asking: list[tuple] = []
    waiting = 0

    def columns(pieces):
        return [np.concatenate(c) for c in zip(*pieces)]

    def ring():
        nonlocal held, size, serial, waiting
        row, name, known, asks, pivot, away, m = columns(held)
        held, size = [], 0
        order = np.lexsort((row, name, ~known))
        top = float(np.sqrt((m.astype(float) ** 2).sum(1).max()))
        serial += 1
        if asks.any():
            asking.append((row[asks], name[asks], m[asks], np.full(int(asks.sum()), serial)))
            waiting += int(asks.sum())
        return (0, serial, int(pivot[0]), len(row), float(away.min()), float(away.max()), top, name[order].astype("<i8").tobytes(),
                known[order].astype("u1").tobytes(), row[order].astype("<i8").tobytes(), _pack(m[order]), None)

    def blocks(least):
        nonlocal asking, waiting, serial
        out = []
        while waiting >= least and waiting:
            row, name, m, home = columns(asking)
            take = min(queries, len(row))
            serial += 1
            out.append((1, serial, None, take, None, None, None, name[:take].astype("<i8").tobytes(), None, row[:take].astype("<i8").tobytes(),
                        _pack(m[:take]), np.unique(home[:take]).tolist()))
            asking, waiting = [(row[take:], name[take:], m[take:], home[take:])], len(row) - take
        return out

    for batch in batches:
        row, pivot, away = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
        known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        name = batch.column(1).fill_null(0).to_numpy()
        asks = batch.column(2).to_numpy(zero_copy_only=False)
        m = matrix(batch.column(5), width)
        start, out = 0, []
        while start < len(row):
            if held and held[-1][4][0] != pivot[start]:
                out.append(ring())
            stop = min(start + annulus - size, int(np.searchsorted(pivot, pivot[start], side="right")))
            held.append(tuple(c[start:stop] for c in (row, name, known, asks, pivot, away, m)))
            size, start = size + stop - start, stop
            if size == annulus:
                out.append(ring())
        out += blocks(queries)
        if out:
            yield _table(PACKED, out)
    out = [ring()] if held else []
    out += blocks(1)
    if out:
        yield _table(PACKED, out)


class Best:
    """The best candidates of each query of a block; ``floor`` is the least score that can still enter."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.score = np.full((queries, k), LOWEST)
        self.name, self.row = np.zeros((queries, k), np.int64), np.full((queries, k), -1)
        self.known = np.zeros((queries, k), bool)

    def add(self, at: np.ndarray, score: np.ndarray, name: np.ndarray, known: np.ndarray, row: np.ndarray) -> None:
        """``score``: queries ``at`` by the annulus's vectors, which stand in the order of ties."""
        hit = score >= self.floor[at][:, None]
        some = hit.any(axis=1)
        at, score = at[some], np.where(hit[some], score[some], LOWEST)
        if not len(at):
            return
        n = score.shape[1]
        take = min(self.k, n)
        place = np.broadcast_to(np.arange(n), score.shape)
        if take == n:
            cols = place
        elif np.abs(score[score > LOWEST]).max() < 2**62 // n:
            rank = np.where(score > LOWEST, score * n + (n - 1 - place), LOWEST)
            cols = np.argpartition(rank, n - take, axis=1)[:, n - take :]
        else:
            cols = np.lexsort((place, -score), axis=1)[:, :take]
        found = np.take_along_axis(score, cols, axis=1)
        merged = [np.concatenate(x, axis=1) for x in ((self.score[at], found), (self.name[at], name[cols]), (self.known[at], known[cols]),
                                                      (self.row[at], np.where(found > LOWEST, row[cols], -1)))]
        order = np.lexsort((merged[3], merged[1], ~merged[2], -np.maximum(merged[0], -(2**62))), axis=1)[:, : self.k]
        for held, values in zip((self.score, self.name, self.known, self.row), merged):
            held[at] = np.take_along_axis(values, order, axis=1)
        self.floor[at] = np.maximum(self.floor[at], self.score[at, -1])

    def hits(self, queries: np.ndarray) -> pa.RecordBatch:
        real = self.row >= 0
        who = np.broadcast_to(queries[:, None], real.shape)[real]
        name = pa.array(self.name[real], mask=~self.known[real])
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(self.row[real]), name, pa.array(self.score[real])], names=["query", "row", "name", "score"])


class Block:
    """Queries, and bounds on what they can gain from annuli."""

    def __init__(self, row: dict, pivots: np.ndarray):
        self.m = _unpack(row["m"], row["n"])
        self.rows = np.frombuffer(row["rows"], "<i8")
        self.away = distances(self.m, pivots)
        self.norm = np.sqrt((self.m.astype(float) ** 2).sum(1))
        self.along = self.m.astype(float) @ pivots.T.astype(float)

    def bounds(self, pivot: np.ndarray, near: np.ndarray, far: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest possible product and gap, queries by annuli; a hair on the safe side."""
        d = self.away[:, pivot]
        gap = np.maximum(0.0, np.maximum(near[None, :] - d, d - far[None, :]) - 2e-6 * (1 + d + far[None, :] + top[None, :]))
        most = (self.norm[:, None] ** 2 + top[None, :] ** 2 - gap**2) / 2
        most = np.minimum(most, self.along[:, pivot] + self.norm[:, None] * (far[None, :] * (1 + 1e-6) + 2e-6 * (1 + top[None, :])))
        most = np.minimum(most, self.norm[:, None] * top[None, :])
        return most + np.abs(most) * 1e-9 + 1e-3, gap

    def visit(self, best: Best, ring: dict, pivots: np.ndarray) -> None:
        most, _ = self.bounds(*(np.array([ring[c]]) for c in ("pivot", "near", "far", "top")))
        at = np.flatnonzero(most[:, 0] >= best.floor)
        if not len(at):
            return
        rows, names = np.frombuffer(ring["rows"], "<i8"), np.frombuffer(ring["names"], "<i8")
        score = products(self.m[at], _unpack(ring["m"], ring["n"]))
        score[self.rows[at][:, None] == rows[None, :]] = LOWEST
        best.add(at, score, names, np.frombuffer(ring["known"], "u1") > 0, rows)


def _visited(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Cells one after another: a block, then its annuli by growing gap."""
    block = best = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 1:
                if best is not None:
                    yield best.hits(block.rows)
                block = Block(row, pivots)
                floor = np.frombuffer(row["floor"], "<i8") if row["floor"] else np.full(row["n"], LOWEST + 1)
                best = Best(row["n"], k, floor)
            else:
                block.visit(best, row, pivots)
    if best is not None:
        yield best.hits(block.rows)


def _open_cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, cell, gap, ring): the annuli of a directory page that a query of the block may gain from."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            block = Block(row, pivots)
            rings = [r for r in row["rings"] if r["id"] not in set(row["homes"])]
            if not rings:
                continue
            most, gap = block.bounds(*(np.array([r[c] for r in rings]) for c in ("pivot", "near", "far", "top")))
            floor = np.frombuffer(row["floor"], "<i8") if row["floor"] else np.full(row["n"], LOWEST + 1)
            useful = most >= floor[:, None]
            live = np.flatnonzero(useful.any(axis=0))
            least = np.where(useful, gap, np.inf).min(axis=0)[live]
            live = live[np.argsort(least, kind="stable")]
            cells = -(-len(live) // CELL)
            out += [(row["id"], row["page"] * PAGE + place % cells, float(place // cells + 1), rings[r]["id"]) for place, r in enumerate(live.tolist())]
        yield _table("block long, cell long, turn double, ring long", out)


def _streamed(pairs: DataFrame, blocks: DataFrame, rings: DataFrame, parts: int) -> DataFrame:
    """Cells as runs of rows: the block, then its annuli in turn."""
    cells = pairs.select("block", "cell").distinct().join(blocks.withColumnRenamed("id", "block"), "block")
    cells = cells.withColumn("turn", F.lit(0.0))
    rows = pairs.join(rings.withColumnRenamed("id", "ring"), "ring").drop("ring")
    return cells.unionByName(rows, allowMissingColumns=True).repartition(parts, "block", "cell").sortWithinPartitions("block", "cell", "turn")


def top_products(df: DataFrame, key: str = "vec_id", vector: str = "embedding", asks: Column | None = None, k: int = TOP, scale: int = SCALE,
                 annulus: int = ANNULUS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer products of every query row with all other rows.

    ``asks``: which rows are queries, a condition on the column ``name`` (the id).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = integer_vectors(df, key, vector, scale)
    count, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    drawn = vectors.select("v").orderBy(F.xxhash64("v"), "row").limit(SAMPLE).collect()
    sample = np.array([list(r.v) + [0] * (width - len(r.v)) for r in drawn], np.int64).reshape(len(drawn), width)
    pivots = spread_pivots(np.unique(sample, axis=0), max(1, min(MOST_PIVOTS, int(count**0.5 / 4))))
    asks = F.coalesce(F.col("name") % 20 == 0 if asks is None else asks, F.lit(False))
    keyed = vectors.select("row", "name", "v", asks.alias("asks")).mapInArrow(
        lambda batches: _keyed(batches, pivots), "row long, name long, asks boolean, pivot int, away double, v array<long>")
    keyed = materialise(keyed, "pivot-keys")
    order = ["pivot", "away", "row"]
    ranges = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    index = materialise(ranges.mapInArrow(lambda batches: _cut(batches, width, annulus, queries), PACKED), "pivot-index")
    discard(vectors, keyed)
    rings = index.filter("kind = 0").drop("homes")
    blocks = index.filter("kind = 1").select("kind", "id", "n", "names", "rows", "m", "homes")

    # The annuli that the queries lie in.
    seeds = blocks.select(F.col("id").alias("block"), F.lit(0).cast("long").alias("cell"), F.posexplode("homes").alias("turn", "ring"))
    seeds = seeds.withColumn("turn", (F.col("turn") + 1).cast("double"))
    plain = blocks.drop("homes").withColumn("floor", F.lit(None).cast("binary"))
    first = _streamed(seeds, plain, rings, parts).select("kind", "n", "pivot", "near", "far", "top", "names", "known", "rows", "m", "floor")
    first = materialise(first.mapInArrow(lambda batches: _visited(batches, pivots, k), HIT), "pivot-first")

    # The k-th best so far is a query's threshold; fewer leave it open.
    best = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("name").asc_nulls_last(), "row")
    kth = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    each = blocks.select("id", "rows").mapInArrow(_members, "id long, place int, query long")
    floors = each.join(kth, "query", "left").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("kth", F.lit(int(LOWEST) + 1)).alias("kth")))).alias("kth"))  # the queries of a block
    floors = floors.select("id", F.col("kth.kth").alias("kth"))
    floors = floors.mapInArrow(_as_bytes, "id long, floor binary")
    floored = materialise(blocks.join(floors, "id"), "pivot-blocks")

    # All other annuli, by pages of their directory.
    pages = index.filter("kind = 0").count() // PAGE + 1
    listed = rings.select("id", "pivot", "near", "far", "top", F.pmod(F.xxhash64("id"), F.lit(pages)).alias("page"))
    listed = listed.groupBy("page").agg(F.collect_list(F.struct("id", "pivot", "near", "far", "top")).alias("rings"))  # some PAGE annuli
    asked = floored.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
    pairs = asked.join(listed, "page").select("id", "n", "rows", "m", "homes", "floor", "page", "rings").mapInArrow(
        lambda batches: _open_cells(batches, pivots), "block long, cell long, turn double, ring long")
    pairs = materialise(pairs, "pivot-pairs")
    rest = _streamed(pairs, floored.drop("homes"), rings, parts).select("kind", "n", "pivot", "near", "far", "top", "names", "known", "rows", "m", "floor")
    rest = rest.mapInArrow(lambda batches: _visited(batches, pivots, k), HIT)

    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = blocks.select("names", "rows").mapInArrow(_named, "of long, query_id long")
    return ranked.join(named, F.col("query") == F.col("of")).select("query_id", "rank", F.col("name").alias("vec_id"), "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rows = np.frombuffer(row["rows"], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), row["id"])), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows)], names=["id", "place", "query"])


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _table("id long, floor binary", [(row["id"], np.array(row["kth"], "<i8").tobytes()) for row in batch.to_pylist()])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], "<i8")) for c in ("rows", "names")], names=["of", "query_id"])
