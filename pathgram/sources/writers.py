"""Sinks: cleaned data and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathgram.operators.prepare import coerce


def write_cleaned(df: DataFrame, columns: Sequence[str], path: str, fmt: str = "csv", keep: Sequence[str] = ()) -> None:
    """The coerced numeric table; a directory of part files, written in parallel."""
    writer = coerce(df, columns, keep).write.mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_results(metrics: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """Every result table of a run is a slice of the long metric table; runs are partitions."""
    writer = metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
