"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathgram.session import materialise

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Rows up to which a derived table counts as small; its rows are a few numbers each.
SMALL_TABLE = 100_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; empty for an empty text."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_count(text: Column) -> Column:
    """Number of such runs, as a long."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def small(df: DataFrame, limit: int = SMALL_TABLE) -> DataFrame:
    """A materialised table of short rows, marked for broadcasting if it is counted to be small.

    A larger one comes back unmarked, and Spark shuffles the join.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ranked(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df`` with the 0-based position in a global order, without a window over all rows.

    Rows are range-partitioned and sorted; a position is the row's place in its partition
    plus the rows of the partitions before it. Only one count per partition meets in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("__mid", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("__part", F.shiftright("__mid", 33))
    before = running(placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), "__part", "__n", "__before")
    place = F.col("__before") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "__part").withColumn(name, place).drop("__part", "__mid", "__before")


def running(per_part: DataFrame, part: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the smaller parts. One row per partition of a job, so one task may hold them."""
    from pyspark.sql import Window

    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(part, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias(name))
