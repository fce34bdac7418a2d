"""Delimited text and parquet sources."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import to_number
from pathgram.spec import clean_name

DELIMITERS = (",", ";", "\t", "|")
FALLBACK_ENCODING = "ISO-8859-1"
BYTE_ORDER_MARK = 0xFEFF


def unique_names(headers: Iterable[object]) -> tuple[list[str], list[str]]:
    """Cleaned headers; a repeat gets the first free ``name_k`` and a warning."""
    names: list[str] = []
    warnings: list[str] = []
    for raw in headers:
        base = name = clean_name(raw)
        k = 1 + sum(1 for n in names if n == base)
        while name in names:
            name = f"{base}_{max(k, 2)}"
            k = max(k, 2) + 1
        if name != base:
            warnings.append(f"duplicate column '{base}' renamed to '{name}'")
        names.append(name)
    return names, warnings


def normalise_headers(df: DataFrame) -> tuple[DataFrame, list[str]]:
    names, warnings = unique_names(df.columns)
    return df.toDF(*names), warnings


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).filter(F.length(F.trim("value")) > 0).first()
    return row[0].translate({BYTE_ORDER_MARK: None}) if row else ""


def sniff_delimiter(line: str) -> str:
    counts = {d: line.count(d) for d in DELIMITERS}
    best = max(counts, key=counts.get)
    return best if counts[best] else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None,
                   encoding: str | None = None) -> tuple[DataFrame, list[str]]:
    """Header row, all columns as text. Unless given, the delimiter is found from the first line and the encoding from all lines."""
    line = _first_line(spark, path)
    if encoding is None:
        unreadable = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
        encoding = FALLBACK_ENCODING if unreadable else "UTF-8"
        if encoding != "UTF-8":
            line = spark.read.option("encoding", encoding).option("lineSep", "\n").csv(path, sep="\x01").first()[0]
    sep = sep or sniff_delimiter(line)
    names, warnings = unique_names(next(csv.reader([line], delimiter=sep), []))
    if not names:
        return spark.createDataFrame([], T.StructType([])), ["no column found"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (
        spark.read.schema(schema)
        .options(header=True, sep=sep, encoding=encoding, multiLine=False)
        .csv(path)
    )
    return df, warnings


def read_numbers(spark: SparkSession, path: str, sep: str, decimal: str = ",") -> DataFrame:
    """Explicit separator and decimal mark; columns whose every entry is a number become double.

    One scan decides the types, so the decision holds for the whole file.
    """
    text, _ = read_delimited(spark, path, sep)
    lost = text.agg(*[
        (F.count(F.col(f"`{c}`")) - F.count(to_number(F.col(f"`{c}`"), decimal))).alias(f"x{k}")
        for k, c in enumerate(text.columns)
    ]).first()
    return text.select(*[
        (to_number(F.col(f"`{c}`"), decimal) if not bad else F.col(f"`{c}`")).alias(c)
        for c, bad in zip(text.columns, lost)
    ])
