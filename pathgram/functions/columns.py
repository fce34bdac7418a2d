"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.spec import ModelError, clean_name

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType, T.BooleanType))


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def to_number(value: Column, decimal: str = ",") -> Column:
    """Text to double: trimmed, decimal mark made a point, anything unreadable is missing."""
    text = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    text = F.replace(text, F.lit(decimal), F.lit(".")) if decimal != "." else text
    return finite(F.when(text.rlike(NUMBER), text.try_cast("double")))


def numeric(df: DataFrame, name: str, decimal: str = ",") -> Column:
    """The analysis value of a column: double, missing as NULL."""
    field = df.schema[name]
    if is_numeric(field):
        return finite(col(name).cast("double")).alias(name)
    if isinstance(field.dataType, T.StringType):
        return to_number(col(name), decimal).alias(name)
    return F.lit(None).cast("double").alias(name)  # dates and nested values are not numbers


def resolve(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """Requested name -> actual column, by the header rule. First column wins."""
    actual: dict[str, str] = {}
    for c in df.columns:
        actual.setdefault(clean_name(c), c)
    wanted = [clean_name(n) for n in dict.fromkeys(names)]
    absent = [n for n in wanted if n not in actual]
    if absent:
        raise ModelError("columns not in the data: " + ", ".join(absent))
    return {n: actual[n] for n in wanted}


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., variable, value) with NULL for missing; one output row per cell."""
    typed = df.select(*[col(k) for k in keep], *[numeric(df, c) for c in columns])
    return typed.unpivot([col(k) for k in keep], [col(c) for c in columns], "variable", "value")


def band(value: Column, steps: list[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for test, label in steps:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)
