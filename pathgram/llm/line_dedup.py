"""Removing line passages that repeat across the corpus, by content-defined chunks of lines.

Lines are hashed; a rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is
divisible by ``DIVISOR``, so the same passage is cut alike wherever it stands. A line of at least
``LONG_LINE`` characters (a paragraph) is a chunk of its own. Chunks of several lines, and long
lines, that occur more than once anywhere are compared byte by byte; the first occurrence (smallest
id, then place) stays and the others are removed. Single short lines are never removed.

A null text counts as empty. Rows that share id and text count as one and are treated alike. A null
id comes before all others. A text whose lines all go becomes empty; the row stays. An empty table
gives an empty result. Other columns pass through.

Chunk keys and removals grow with the corpus, so they are never broadcast: texts are shuffled once to
their keys and once to their removals, at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathgram.llm.common import whole
from pathgram.session import discard, materialise

WINDOW = 2
DIVISOR = 2
LONG_LINE = 150
#: Shorter chunks are not worth a removal.
MIN_CHARS = 40
_PLACE = "%09d"


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunk_rows(docs: DataFrame) -> DataFrame:
    """The chunks worth comparing: doc_id, code (hash of the text), first, last (lines), body."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("code"), F.split(whole("text"), "\n", -1).alias("lines"))
    lines = F.col("lines")
    rows = rows.select("doc_id", "code", "lines", F.transform(lines, _line_hash).alias("hashes"), F.transform(lines, F.length).alias("sizes"))
    size, code = (lambda i: F.get(F.col("sizes"), i)), (lambda i: F.get(F.col("hashes"), i))
    rolled = lambda i: sum((code(i - k) * 31**k for k in range(1, WINDOW)), code(i))
    cut = lambda i: (
        (size(i) >= LONG_LINE) | F.coalesce(size(i + 1) >= LONG_LINE, F.lit(True)) | F.when(i >= WINDOW - 1, F.pmod(rolled(i), F.lit(DIVISOR)) == 0).otherwise(F.lit(False))
    )
    rows = rows.select("doc_id", "code", "lines", F.filter(F.sequence(F.lit(0), F.size(lines) - 1), cut).alias("ends"))
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("ends"), k - 1) + 1)
    body = lambda a, b: F.array_join(F.slice(lines, a + 1, b - a + 1), "\n")
    chunks = F.transform("ends", lambda e, k: F.struct(start(k).alias("first"), e.alias("last"), body(start(k), e).alias("body")))
    # There is always a chunk. A plain explode would infer a filter on the array and compute it once more, unshared.
    rows = rows.select("doc_id", "code", chunks.alias("chunks")).select("doc_id", "code", F.explode_outer("chunks").alias("c"))
    rows = rows.select("doc_id", "code", "c.first", "c.last", "c.body")
    return rows.filter((F.length("body") >= MIN_CHARS) & ((F.col("last") > F.col("first")) | (F.length("body") >= LONG_LINE)))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Line ranges to remove: doc_id, code, ranges (array of first, last)."""
    place = F.struct("doc_id", "code", "first")
    found = chunk_rows(docs).withColumn("key", F.xxhash64("body"))
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("key2"))
    keys = materialise(keys, "lines-keys")
    found = found.join(keys.hint("merge"), F.col("key") == F.col("key2"), "left_semi")
    found = materialise(found, "lines-found")
    # Grouping by the text itself compares the bytes.
    firsts = found.groupBy("key", "body").agg(F.min(place).alias("keep")).select(F.col("key").alias("key3"), F.col("body").alias("body3"), "keep")
    again = found.join(firsts, (F.col("key") == F.col("key3")) & (F.col("body") == F.col("body3")))
    again = again.filter(~place.eqNullSafe(F.col("keep")))
    ranges = materialise(again.groupBy("doc_id", "code").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "lines-ranges")
    discard(keys, found)
    return ranges


def remove_repeated_lines(docs: DataFrame, report: bool = False) -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text`` (and ``n_chars`` set anew if there).

    ``report`` adds n_lines and n_removed.
    """
    ranges = repeated_lines(docs).select(
        F.col("doc_id").alias("__id"), F.col("code").alias("__code"), F.col("ranges").alias("__ranges")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__code"))
    # Each line gets its place in front, so a set difference removes exactly the lines meant, in linear time.
    marked = F.transform(F.split(whole("text"), "\n", -1), lambda line, i: F.concat(F.format_string(_PLACE, i), line))
    rows = docs.join(ranges.hint("merge"), same, "left").withColumn("__marked", marked)
    # The marked lines are named several times below, so that Spark keeps them as a column of their own.
    gone = F.flatten(F.transform("__ranges", lambda r: F.slice("__marked", r["first"] + 1, r["last"] - r["first"] + 1)))
    left = F.transform(F.array_except("__marked", gone), lambda x: F.substr(x, F.lit(10)))
    text = F.when(F.col("__ranges").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    removed = F.aggregate("__ranges", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    extra = [F.size("__marked").cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed")] if report else []
    rows = rows.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *extra)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(whole("text")).cast(docs.schema["n_chars"].dataType))
    return rows
