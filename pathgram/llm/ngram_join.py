"""Exact Jaccard join of documents on word shingles, with signature trees.

Rows whose sets are equal form one class, and only classes are compared. Two classes can only be
similar enough if they share one of the rarest shingles of each (the prefix of its set under one
global order), so classes that share a prefix shingle form a block. The first shingle that two classes
share has all others behind it, so its place in a set bounds the size of what the set may link to in that
block (its reach). What a block's classes may link to is found in three steps, none of which lists all pairs of a block:

* Blocks of two are candidate pairs. In larger blocks every class is first paired with the most central one,
  and with the most central one that is not linked to it.
* Confirmed links give components; members that meet no other component of about their size in a block are done.
* In the blocks that are left, classes that reach another one go into a signature tree. A node holds the OR of its
  members' token bitmaps, their range of sizes, their fewest bits and their farthest reach. Two trees are traversed
  together: a pair of nodes is dropped when neither sizes nor reach let them meet, or when the largest overlap
  that the bitmaps allow is below the overlap needed. What reaches the leaves is a candidate pair.

Candidates are confirmed on the full sets. Blocks above ``BLOCK`` classes are split into chunks that
meet pair by pair, so no task holds a whole one. The order of shingles puts frequent ones last; their
frequencies come from counters over all documents, summed over all tasks, and only steer the work: any order is
exact. A counter stands out by the square root of its load, so blocks of frequent shingles grow slower than the input.

A null or empty text, or one without words, has an empty set and links with nothing. Equal rows are one
class. A row with a null id takes part; its component is named by the smallest id in it, null if there is none. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathgram.llm.common import small, whole
from pathgram.llm.components import components
from pathgram.llm.shingles import mix, shingle_sets
from pathgram.session import discard, materialise

WIDTH = 5
PERCENT = 80
#: Counters of shingle frequencies (a power of two), and how many of them make a row.
COUNTERS = 1 << 18
RUN = 1 << 14
#: Times above the usual load up to which a shingle still counts as rare: a block of so few classes is cheap.
FEW = 64
#: Bits of a token bitmap: a power of two, at least twice the size of the set, within these bounds.
BITS = (64, 1 << 16)
#: Classes that one tree holds, and children of a tree node.
BLOCK = 512
FAN = 8
#: Rounds in which two members of each block (first the most central ones, then others) are compared with the rest of it.
STARS = 2


def _slices(batch: pa.RecordBatch, column: str, size: int = 512) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part, part[column]


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Token bitmap of a set. A bit's place is the hash modulo the width, so halves can be folded together."""
    width = min(max(BITS[0], 1 << (2 * len(values) - 1).bit_length()), BITS[1]) if len(values) else BITS[0]
    bits = np.zeros(width, np.uint8)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) made narrower, to ``words`` 64-bit words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Written table of two kinds of rows: documents (doc_id, code, n, node, bits) and a task's counters (run, times)."""
    schema = "doc_id long, code long, n int, node long, bits binary, run int, times binary"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                n, node, bits = [], [], []
                for values in shingle_sets(texts, width):
                    n.append(len(values))
                    node.append(_node(values))
                    bits.append(bitmap(values).tobytes())
                    np.add.at(counts, _slot(values), 1)
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["code"], pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                    names=names,
                )
        runs = [(k, c) for k, c in enumerate(counts.reshape(-1, RUN)) if c.any()]
        size = len(runs)
        times = [c.astype(np.min_scalar_type(c.max())).tobytes() for _, c in runs]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.array([k for k, _ in runs], pa.int32()), pa.array(times, pa.binary())],
            names=names,
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("code"), whole("text").alias("text"))
    return materialise(rows.mapInArrow(task, schema), "join-described")


def levels(counters: DataFrame) -> bytes:
    """For each counter how far it stands out, as a power of two; ``counters`` has run, times of all tasks.

    Runs are summed in tasks, so the driver gets ``COUNTERS`` numbers, whatever the input.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch["run"].to_pylist(), batch["times"], strict=True):
                b = b.as_buffer()
                own = sums.setdefault(k, np.zeros(RUN, np.int64))
                own += np.frombuffer(b, f"u{b.size // RUN}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["run", "times"])

    total = np.zeros((COUNTERS // RUN, RUN), np.int64)
    for run, times in counters.repartition(COUNTERS // RUN, "run").mapInArrow(task, "run int, times binary").collect():
        total[run] = np.frombuffer(times, np.int64)
    usual = np.median(total)
    over = np.maximum(0, total.ravel() - usual - max(FEW, 3 * math.sqrt(usual)))
    return np.ceil(np.log2(1 + over)).astype(np.uint8).tobytes()


def _node(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def prefixes(docs: DataFrame, width: int, percent: int, levels: bytes, place: bool = False) -> DataFrame:
    """The prefix shingles of every class: token, node, n, and with ``place`` at, the token's place in the order.

    Sets are made from all texts where they lie, and prefixes are shuffled, as texts are several times as long.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels, np.uint8)
        for batch in batches:
            for _, texts in _slices(batch, "text"):
                nodes, sizes, tokens = [], [], []
                for values in shingle_sets(texts, width):
                    n = len(values)
                    if not n:
                        continue
                    rank = level[_slot(values)]
                    spread = mix(values)  # slots use the upper bits, so order by fresh ones
                    best = np.lexsort((spread, rank))[: n - -(-percent * n // 100) + 1]
                    nodes.append(_node(values))
                    sizes.append(n)
                    tokens.append(values[best])
                ends = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
                flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "n", "tokens"])

    rows = docs.select(whole("text").alias("text")).mapInArrow(task, "node long, n int, tokens array<long>")
    found = rows.dropDuplicates(["node"]).select(F.posexplode("tokens").alias("at", "token"), "node", "n")
    return found.select("token", "node", "n", *["at"] * place)


def reach(percent: int) -> Column:
    """The largest set that one of ``n`` shingles can be similar to if the first shingle they share is its ``at``-th, from 0."""
    return F.expr(f"cast((cast(n as long) - at) * {100 + percent} div {percent} - n as int)")


class Tree:
    """A signature tree over some classes, sorted by size; level 0 has the classes themselves."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, far: np.ndarray):
        fewest = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, fewest, far)]
        while len(self.levels[-1][1]) > FAN:
            b, low, high, few, far = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(few, at), np.maximum.reduceat(far, at)))


def _possible(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether members of the node pairs (i, j) can still be similar enough."""
    (lb, ll, lh, lf, lr), (rb, rl, rh, rf, rr) = left, right
    near = (lr[i] >= rl[j]) & (rr[j] >= ll[i])
    out = near.copy()
    i, j = i[near], j[near]
    shared = np.bitwise_count(lb[i] & rb[j]).sum(axis=1).astype(np.int64)
    # Bits of a member that no member of the other node has are shingles that do not match.
    over_l, over_r = lh[i] - np.maximum(0, lf[i] - shared), rh[j] - np.maximum(0, rf[j] - shared)
    most = np.minimum(over_l, over_r)
    out[near] = most * (100 + percent) >= percent * (ll[i] + rl[j])
    return out


def traverse(left: Tree, right: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that the dual traversal cannot rule out. Trees of unlike height descend in turn."""
    a, b = len(left.levels) - 1, len(right.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left.levels[a][1])), np.arange(len(right.levels[b][1])), indexing="ij"))
    while True:
        ok = _possible(left.levels[a], right.levels[b], i, j, percent)
        i, j = i[ok], j[ok]
        if (a == 0 and b == 0) or not len(i):
            return i, j
        if a >= b:
            a -= 1
            i, j = (i[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(j, FAN)
            i, j = i[i < len(left.levels[a][1])], j[i < len(left.levels[a][1])]
        else:
            b -= 1
            i, j = np.repeat(i, FAN), (j[:, None] * FAN + np.arange(FAN)).ravel()
            i, j = i[j < len(right.levels[b][1])], j[j < len(right.levels[b][1])]


def similar_trees(n: np.ndarray, bits: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``) that trees cannot rule out; ``far`` is their reach, else sizes set it.

    Classes are put into trees by the width of their bitmaps. Sets that differ twofold in size cannot be
    similar, so only equal and neighbouring widths meet, the wider folded.
    """
    width = np.array([len(b) for b in bits])
    far = 100 * n // percent if far is None else far
    out_l, out_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def tree(side: np.ndarray, own: int, words: int) -> tuple[np.ndarray, Tree | None]:
        at = side[width[side] == own]
        at = at[np.lexsort((at, n[at]))]
        return at, Tree(n[at], fold(np.stack([bits[k] for k in at]), words), far[at]) if len(at) else None

    for own in np.unique(width[left]):
        for other in (own // 2, own, own * 2):
            (a, one), (b, two) = tree(left, own, min(own, other)), tree(right, other, min(own, other))
            if one and two:
                i, j = traverse(one, two, percent)
                out_l.append(a[i])
                out_r.append(b[j])
    return np.concatenate(out_l), np.concatenate(out_r)


def _by_chunks(blocks: DataFrame, work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work`` on each pair of chunks (block, low, high): its rows, and the places of either chunk's (both: all, if one meets itself)."""
    keys = ["block", "low", "high"]

    def done(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        low, high, mine = t["low"][0].as_py(), t["high"][0].as_py(), t["mine"].to_numpy()
        return work(t, np.flatnonzero(mine == low), np.flatnonzero(mine == high)).to_batches()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            cols = [batch[k].to_numpy() for k in keys]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = tuple(c[a] for c in cols)
                if key != last and held:
                    yield from done(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from done(held)

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


def reaching(blocks: DataFrame) -> DataFrame:
    """The rows whose sizes and reach allow a link to another component; rows are block, low, high, mine, node, n, reach, root."""

    def work(t: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.Table:
        n, far, root = (t[c].to_numpy() for c in ("n", "reach", "root"))
        meet = (n[right] <= far[left, None]) & (n[left, None] <= far[right]) & (root[left, None] != root[right])
        keep = np.zeros(len(n), bool)
        keep[left] |= meet.any(axis=1)
        keep[right] |= meet.any(axis=0)
        return t.filter(pa.array(keep))

    names = ["block", "low", "high", "mine", "node", "n", "reach", "root"]
    return _by_chunks(blocks.select(*names), work, "block long, low int, high int, mine int, node long, n int, reach int, root long")


def tree_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of blocks; rows are block, low, high (chunk pair), mine (own chunk), node, n, reach, root, bits."""

    def work(t: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.Table:
        node, n, far, root = (t[c].to_numpy() for c in ("node", "n", "reach", "root"))
        bits = [np.frombuffer(b, np.uint64) for b in t["bits"].to_pylist()]
        x, y = similar_trees(n.astype(np.int64), bits, left, right, percent, far.astype(np.int64))
        same = t["low"][0] == t["high"][0]
        keep = (root[x] != root[y]) & ((node[x] < node[y]) if same else True)
        x, y = x[keep], y[keep]
        return pa.table({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])})

    return _by_chunks(blocks, work, "a long, b long").distinct()


def screen(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Written table of the pairs (a, b) that sizes and bitmaps allow; ``maps`` has node, n, bits.

    Only the bitmaps of classes that are in a pair are moved.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy().astype(np.int64), batch["n_b"].to_numpy().astype(np.int64)
            keep = []
            for x, y, p, q in zip(batch["bits_a"], batch["bits_b"], n_a, n_b, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                x, y = fold(x, words), fold(y, words)
                shared = int(np.bitwise_count(x & y).sum())
                most = min(p - int(np.bitwise_count(x).sum()), q - int(np.bitwise_count(y).sum())) + shared
                keep.append(most * (100 + percent) >= percent * (p + q))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs, "join-pairs")
    nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "join-nodes")
    wanted = materialise(maps.join(small(nodes), "node", "left_semi"), "join-wanted")
    side = lambda c: wanted.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    out = materialise(rows.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(task, "a long, b long"), "join-screened")
    discard(pairs, nodes, wanted)
    return out


def confirm(pairs: DataFrame, chosen: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that are similar enough; sets are made anew from the texts involved."""
    pairs = materialise(pairs, "join-candidates")
    nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "join-nodes")
    texts = materialise(chosen.join(nodes, "node"), "join-texts")
    written = materialise(_texts(docs, small(texts)).mapInArrow(_set_task(width), "node long, items binary"), "join-sets")
    sets = written.dropDuplicates(["node"]) if written.count() > nodes.count() else written
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialise(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(task, "a long, b long"), "join-links")
    discard(pairs, nodes, texts, written)
    return links


def _set_task(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, "text", 256):
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], names=["node", "items"])

    return task


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of the chosen rows: node, text."""
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__code"), whole("text").alias("text"))
    return rows.join(chosen, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__code") == F.col("code"))).select("node", "text")


def _open(members: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Members, with their roots, that may still link to another component of their block, going by sizes.

    Sizes fall into bands in which similar sets are at most one apart. Who drops out stays out, as components only grow.
    """
    placed = members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    step = math.log(100 / percent) + 1e-3  # a little more than the ratio, so rounding cannot put a pair two apart
    placed = placed.withColumn("band", F.floor(F.log("n") / step).cast("int"))
    spans = placed.groupBy("block", "band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    around = spans.select("block", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "r1", "r2")
    mixed = around.groupBy("block", "band").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2")).filter("r1 <> r2").select("block", "band")
    return materialise(placed.join(mixed, ["block", "band"]).drop("band"), "join-open")


def _star(placed: DataFrame, turn: int = 0) -> DataFrame:
    """For each block the pairs (a, b) of one member with all members of other components whose sizes and reach allow a link.

    The member is the most central one outside the component of the block's most central one; in a block
    without links that is the second most central, so both of them are paired. Later turns take other members, by hash.
    """
    rank = F.col("score") if turn == 0 else F.xxhash64("node", F.lit(turn)).alias("score")
    head = F.max(F.struct(rank, "node", "root", "n", "reach"))
    first = placed.groupBy("block").agg(head.alias("first"))
    others = placed.join(first, "block").filter("root <> first.root")
    second = others.groupBy("block").agg(head.alias("second"))
    both = placed.join(first.join(second, "block"), "block")
    both = both.select("node", "root", "n", "reach", F.explode(F.array("first", "second")).alias("head")).filter("root <> head.root")
    both = both.filter("n <= head.reach and head.n <= reach")
    return both.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, code (hash of the text), n_shingles, component_id, root.

    ``root`` tells components apart (null for empty sets); ids do not, as they may repeat or be null.
    """
    described = describe(docs, width)
    rows = described.filter("node IS NOT NULL")
    steps = levels(described.filter("run IS NOT NULL").select("run", "times"))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "code"))
    classes = materialise(rows.filter("n > 0").groupBy("node").agg(first.alias("first")).select("node", "first.doc_id", "first.code"), "join-classes")
    same = classes.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"), F.col("code").alias("__code"))
    match = (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("code") == F.col("__code"))
    maps = materialise(rows.join(same, match, "left_semi").dropDuplicates(["node"]).select("node", "n", "bits"), "join-maps")
    entries = materialise(prefixes(docs, width, percent, steps, place=True).drop("n"), "join-prefixes")

    tokens = entries.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("low"), F.max("node").alias("high"))
    tokens = materialise(tokens.filter("low <> high"), "join-tokens")
    two = tokens.filter("members = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    many = materialise(tokens.filter("members > 2").select("token", "members", "low"), "join-many")
    every = materialise(entries.join(many, "token"), "join-entries")
    discard(entries)
    # Tokens with the same members need looking at once, at the first of them: all members have them in one order.
    mark = F.xxhash64("node")
    marks = every.groupBy("token", "members", "low").agg(F.bit_xor(mark).alias("mark"), F.bit_xor(F.xxhash64(mark, "node")).alias("mark2"), F.min_by("at", "node").alias("at"))
    blocks = marks.groupBy("members", "mark", "mark2", "low").agg(F.min_by("token", "at").alias("token")).select("token")
    # Who shares most of its prefix stands in the middle of its family.
    scores = every.groupBy("node").agg(F.count(F.lit(1)).alias("score")).join(maps.select("node", "n"), "node")
    members = every.join(blocks, "token", "left_semi").join(scores, "node").select(F.col("token").alias("block"), "members", "node", "n", reach(percent).alias("reach"), "score")
    members = materialise(members, "join-members")
    size = lambda c: maps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    sized = two.distinct().join(size("a"), "a").join(size("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = materialise(sized.select("a", "b"), "join-pairs")
    discard(every, many, tokens)
    screened = screen(pairs, maps, percent)
    links = confirm(screened, classes, docs, width, percent)
    discard(screened)
    open_blocks = members
    for turn in range(STARS):
        before, open_blocks = open_blocks, _open(open_blocks.drop("root"), links, percent)
        discard(before)
        star = _star(open_blocks, turn).join(pairs, ["a", "b"], "left_anti")
        star = materialise(star, "join-star")
        screened = screen(star, maps, percent)
        links = materialise(links.union(confirm(screened, classes, docs, width, percent)), "join-links")
        pairs = materialise(pairs.union(star), "join-pairs")
        discard(star, screened)

    chunks = F.ceil(F.col("members") / BLOCK).cast("int")
    before, open_blocks = open_blocks, _open(open_blocks.drop("root"), links, percent)
    discard(before)
    placed = open_blocks.withColumn("mine", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    placed = placed.select("block", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "n", "reach", "root")
    placed = materialise(reaching(placed), "join-reaching")
    more = tree_pairs(placed.join(maps.select("node", "bits"), "node"), percent).join(pairs, ["a", "b"], "left_anti")
    links = materialise(links.union(confirm(more, classes, docs, width, percent)), "join-every")
    roots = components(links)

    named = classes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialise(named.select("node", "root").join(smallest, "root").select("node", "component_id", "root"), "join-named")
    linked = rows.filter("n > 0").join(named, "node").select("doc_id", "code", F.col("n").cast("long").alias("n_shingles"), "component_id", "root")
    result = materialise(linked.union(rows.filter("n = 0").select("doc_id", "code", F.lit(0).cast("long"), "doc_id", F.lit(None).cast("long"))), "join-result")
    discard(described, classes, maps, pairs, links, named, open_blocks, placed)
    return result


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component."""
    found = ngram_components(docs, width, percent).filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "code")
    keepers = found.groupBy("root").agg(F.min(order).alias("first"))
    again = found.join(keepers, "root")
    drop = again.filter(~order.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__id"), F.col("code").alias("__code")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__code"))
    kept = docs.join(small(materialise(drop, "join-drop")), same, "left_anti")
    # Rows that repeat as a whole: the same id and text more than once among those that stay.
    twice = found.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("__id"), F.col("code").alias("__code"))
    twice = materialise(twice, "join-twice")
    if not twice.limit(1).count():
        return kept
    once = kept.join(small(twice), same, "left_semi").withColumn("__code", F.xxhash64("text")).dropDuplicates(["doc_id", "__code"]).drop("__code")
    return kept.join(small(twice), same, "left_anti").unionByName(once)
