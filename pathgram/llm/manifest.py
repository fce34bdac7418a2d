"""Merkle manifest of a table: a leaf for each row, a 16-ary tree for each source, a tree over the sources.

Rows are numbered within their source by range partitions, so a leaf's superblock (16 ** 3 neighbours) is known.
Upwards, superblocks are reduced to one node each, round by round, until every tree has one node. Downwards, the
nodes of a superblock meet the path of siblings above it (``cogroup``): the task finishes the local levels, joins the
outer path to the local one and folds. A superblock holds at most 4,096 nodes whatever the size of a source.

Rules: leaves ascend by key, null first, equal keys by leaf hash; rows equal in every hashed field are interchangeable.
Null fields are ``-``; an empty text is ``0:``. A null key is never tampered with. An empty table gives no rows.
Only the named fields are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathgram.llm.common import ranked, small
from pathgram.session import discard, materialise

FAN = 16
#: Levels that one superblock spans.
LEVELS = 3
SPAN = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTER = "tree long, idx long, left array<string>, right array<string>, subroot string, root string"
PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(values: Sequence[Column]) -> Column:
    """Hash of a row: each value as its UTF-8 length, a colon and itself, null as a dash."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def every_fifth(key: Column) -> Column:
    """Whether 5 divides the checksum of the decimal key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with tree (number of the source), idx (place in its source) and total (leaves of the source).

    Sources run over many range partitions; a place is that in the partition's run of a source plus the source's
    rows in earlier partitions. One count per partition and source is all that is gathered.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("salt")]
    placed = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    placed = placed.sortWithinPartitions(*order).drop("salt").withColumn("mid", F.monotonically_increasing_id())
    placed = materialise(placed, "manifest-order")
    placed = placed.select("*", F.shiftright("mid", 33).alias("part"), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    runs = materialise(placed.groupBy("part", "source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "manifest-runs")
    trees = ranked(runs.groupBy("source").agg(F.sum("n").alias("total")), [F.col("source").asc_nulls_first()], "tree", "manifest-sources")
    trees = trees.withColumnRenamed("source", "of")
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    runs = runs.join(small(trees), F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("part").alias("run_part"), F.col("of"), "shift", "tree", "total")
    runs = materialise(runs, "manifest-places")
    same = (F.col("part") == F.col("run_part")) & F.col("source").eqNullSafe(F.col("of"))
    return placed.join(small(runs), same).select(
        "doc_id", "leaf", "changed", F.col("tree").cast("long").alias("tree"), (F.col("place") + F.col("shift")).alias("idx"), "total")


def levels(hashes: list[str], total: int) -> tuple[list[list[str]], str]:
    """The levels of one superblock below its top node, and that node. ``total``: nodes of the tree on the lowest level."""
    out = []
    for _ in range(LEVELS):
        if total == 1:
            break
        out.append(hashes)
        hashes = [digest("".join(hashes[k : k + FAN])) for k in range(0, len(hashes), FAN)]
        total = -(-total // FAN)
    return out, hashes[0]


def siblings(local: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node in its run, level by level."""
    left, right = [], []
    for nodes in local:
        start = place // FAN * FAN
        left.append("".join(nodes[start:place]))
        right.append("".join(nodes[place + 1 : start + FAN]))
        place //= FAN
    return left, right


def fold(node: str, left: Sequence[str], right: Sequence[str]) -> str:
    for a, b in zip(left, right):
        node = digest(a + node + b)
    return node


def block() -> Column:
    return F.expr(f"idx div {SPAN}")


def reduced(nodes: DataFrame) -> DataFrame:
    """(tree, idx, leaf, total): the top nodes of the superblocks."""

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        total = int(pdf["total"].iloc[0])
        return pd.DataFrame([(pdf["tree"].iloc[0], pdf["idx"].iloc[0] // SPAN, levels(list(pdf["leaf"]), total)[1], -(-total // SPAN))],
                            columns=["tree", "idx", "leaf", "total"])

    schema = "tree long, idx long, leaf string, total long"
    return nodes.select("tree", "idx", "leaf", "total").groupBy("tree", block()).applyInPandas(top, schema)


def upwards(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The nodes at the borders of superblocks, round by round, up to one node a tree."""
    rounds = [nodes]
    total = nodes.agg(F.max("total")).first()[0] or 1
    while True:
        rounds.append(materialise(reduced(rounds[-1]), label))
        total = -(-total // SPAN)
        if total <= 1:
            return rounds


def downwards(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The path of siblings of every node, from those of the superblocks' top nodes."""

    def join(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(inner):
            inner = inner.sort_values("idx")
            up = above.iloc[0]
            local, _ = levels(list(inner["leaf"]), int(inner["total"].iloc[0]))
            for place, (tree, idx) in enumerate(zip(inner["tree"], inner["idx"])):
                left, right = siblings(local, place)
                rows.append((tree, idx, left + list(up["left"]), right + list(up["right"]), up["subroot"], up["root"]))
        return pd.DataFrame(rows, columns=["tree", "idx", "left", "right", "subroot", "root"])

    inner = nodes.select("tree", "idx", "leaf", "total").groupBy("tree", block())
    return inner.cogroup(outer.groupBy("tree", "idx")).applyInPandas(join, OUTER)


def proven(leaves: DataFrame, outer: DataFrame) -> DataFrame:
    """Every leaf with its proof and the root that its (perhaps tampered) row folds to."""

    def prove(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(inner):
            inner = inner.sort_values("idx")
            up = above.iloc[0]
            local, _ = levels(list(inner["leaf"]), int(inner["total"].iloc[0]))
            above_left, above_right = list(up["left"]), list(up["right"])
            tail = "".join(a + b for a, b in zip(above_left, above_right))
            for place, (key, leaf, changed) in enumerate(zip(inner["doc_id"], inner["leaf"], inner["changed"])):
                left, right = siblings(local, place)
                proof = digest("".join(a + b for a, b in zip(left, right)) + tail)
                root = fold(fold(changed if isinstance(changed, str) else leaf, left, right), above_left, above_right)
                rows.append((None if pd.isna(key) else int(key), leaf, up["subroot"], up["root"], proof, root, root == up["root"]))
        out = pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return out.astype({"doc_id": "Int64", "verified": "bool"})

    # A key beyond 2 ** 53 would not outlive a nullable column of pandas, so it travels as text.
    inner = leaves.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("tree", block())
    return inner.cogroup(outer.groupBy("tree", "idx")).applyInPandas(prove, PROVEN)


def manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``changed_text`` is the text as found when the proof is checked, null for the text itself; it is an expression over
    the fields. By default every row whose key's checksum is divisible by five is found lower-cased.
    """
    rows = docs.select(*FIELDS)
    head, text = [F.col(c) for c in FIELDS[:-1]], F.col("text")
    if changed_text is None:
        changed = F.when(every_fifth(F.col("doc_id")), leaf_hash([*head, lower_ascii(text)]))
    else:
        changed = F.when(changed_text.isNotNull(), leaf_hash([*head, changed_text]))
    hashed = materialise(rows.select("doc_id", "source", leaf_hash([*head, text]).alias("leaf"), changed.alias("changed")), "manifest-leaves")
    leaves = materialise(numbered(hashed), "manifest-numbered")
    discard(hashed)
    inside = upwards(leaves, "manifest-nodes")
    roots = inside[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "leaf")
    roots = materialise(roots.withColumn("total", F.lit(roots.count()).cast("long")), "manifest-subroots")
    over = upwards(roots, "manifest-tops")
    none = F.array().cast("array<string>")
    outer = over[-1].select("tree", "idx", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("leaf").alias("root"))
    for nodes in reversed(over[:-1]):
        outer = downwards(nodes, outer)
    # A path over the sources is that of one tree's root.
    names = inside[-1].select(F.col("tree").alias("of"), F.col("leaf").alias("name"))
    outer = outer.join(small(names, limit=10_000), F.col("idx") == F.col("of")).select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), "left", "right", F.col("name").alias("subroot"), "root")
    for nodes in reversed(inside[1:-1]):
        outer = downwards(nodes, outer)
    return proven(leaves, materialise(outer, "manifest-outer"))
