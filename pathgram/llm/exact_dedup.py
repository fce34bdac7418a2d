"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Two texts are equal when they are identical after every run of ASCII white space has become one
space. A null text counts as empty. Of equal texts the row with the smallest id stays (a null id
comes after all others); of rows that share text and id exactly one stays. An empty table gives an
empty result. Other columns are not read, so their names do not matter.

The first pass keeps a length and a prefix hash per row. Lengths, then pairs of length and prefix
hash, that occur once are settled by counting. The second pass computes full hashes of the rows
that are left; texts never move between machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathgram.llm.common import SPACES, small, whole
from pathgram.session import materialise

PREFIX_CHARS = 128


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(whole(text), SPACES, " ")


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    flat = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("flat"))
    return flat.select("doc_id", "flat", F.length("flat").alias("len"), F.xxhash64(F.substring("flat", 1, PREFIX_CHARS)).alias("head"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept (and text_sha256 with ``digest``).

    ``digest`` asks for the SHA-256 of every normalised text in the result, also of those that
    the first two steps have settled.
    """
    sized = _sized(docs, id_col, text_col)
    narrow = materialise(sized.select("len", "head"), "exact-narrow")
    pairs = narrow.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n"))
    lengths = pairs.groupBy("len").agg(F.sum("n").alias("all")).filter("all > 1").select("len")
    heads = pairs.join(lengths, "len", "left_semi")
    heads = materialise(heads.filter("n > 1").select(F.col("len").alias("len2"), F.col("head").alias("head2")), "exact-heads")
    open_heads = small(heads)

    match = (F.col("len") == F.col("len2")) & (F.col("head") == F.col("head2"))
    if open_heads is heads:  # many: rows must move, so they carry the hash in place of the text
        rows = sized.withColumn("sha", F.sha2("flat", 256)).drop("flat").join(heads, match, "left")
        full, sha = F.when(F.col("len2").isNotNull(), F.col("sha")), F.col("sha")
    else:
        rows = sized.join(open_heads, match, "left")
        sha = F.sha2("flat", 256)
        full = F.when(F.col("len2").isNotNull(), sha)
    rows = rows.select("doc_id", full.alias("full"), *([sha.alias("text_sha256")] if digest else []))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "exact-hashed")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    groups = rows.filter("full IS NOT NULL").groupBy("full").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select(F.col("full").alias("full2"), "first", "n")
    out = ["text_sha256"] if digest else []
    settled = rows.filter("full IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *out)
    compared = rows.filter("full IS NOT NULL").join(groups, F.col("full") == F.col("full2"), "left")
    alone = F.col("n").isNull()
    compared = compared.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        *out,
    )
    return settled.unionByName(compared)
