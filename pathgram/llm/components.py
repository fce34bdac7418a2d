"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathgram.session import materialise


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a, b. Returns (node, root) for every linked node but the roots themselves.

    Each round points nodes at the smallest neighbour, first from below, then from above. Links never
    grow in number, and the rounds grow with the logarithm of the longest chain. Minima are taken
    before the shuffle, so a hub is no group in one task. Every round is a written table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "links")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = edges.union(edges.select("v", "u"))
        low = _lowest(both).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        low = _lowest(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
