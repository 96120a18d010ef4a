"""Schema enforcement and whole-frame column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.functions import parse_date, text_to_int


def cast_column(c: Column, source: T.DataType, target: str) -> Column:
    """Cast one column; values that do not fit the target become NULL."""
    if isinstance(source, T.StringType):
        if target == "int":
            return text_to_int(c)
        if target == "date":
            return parse_date(c)
    return c.try_cast(target)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns in one projection and keep all others as they are."""
    kinds = {field.name: field.dataType for field in df.schema.fields}
    missing = [name for name in types if name not in kinds]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.withColumns(
        {name: cast_column(F.col(f"`{name}`"), kinds[name], kind) for name, kind in types.items()}
    )


def fill_all_numeric(df: DataFrame, value: float = 0) -> DataFrame:
    """Replace NULL (and NaN) in every numeric column; text and dates stay."""
    return df.na.fill(value)


def is_complete(df: DataFrame) -> Column:
    """True where no column is NULL or NaN."""
    tests = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        tests.append(c.isNotNull())
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            tests.append(~F.isnan(c))
    return reduce(and_, tests)


def drop_any_null(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL or NaN in any column."""
    return df.na.drop("any")


def prefixed_columns(df: DataFrame, prefix: str = "fe_") -> list[str]:
    return [name for name in df.columns if name.startswith(prefix)]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, T.NumericType) and field.name not in skip
    ]


def common_numeric_columns(left: DataFrame, right: DataFrame, exclude: Iterable[str]) -> list[str]:
    """Numeric columns two tables share, keys left out, in the left table's order."""
    theirs = set(numeric_columns(right, exclude))
    return [name for name in numeric_columns(left, exclude) if name in theirs]
